"""Column expressions: ids, labels, spectral indices, rasters, hashing."""
