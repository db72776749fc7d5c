"""Guarded division and spectral indices, over one row per pixel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def guarded(den: Column) -> Column:
    """A denominator under EPS in size becomes +EPS, whatever its sign."""
    return F.when(F.abs(den) < EPS, F.lit(EPS)).otherwise(den)


def safe_div(num: Column, den: Column) -> Column:
    return num / guarded(den)


def normalised_difference(a: Column, b: Column) -> Column:
    return safe_div(a - b, a + b)


# The normalised differences by name.
DIFFERENCES = {"NDVI": ("B08", "B04"), "NDWI": ("B03", "B08"), "MNDWI": ("B03", "B11"), "NDMI": ("B08", "B11"), "NDBI": ("B11", "B08"), "NBR": ("B08", "B12"), "NDRE1": ("B08", "B05"), "NDRE2": ("B08", "B06"), "NDRE3": ("B08", "B07")}


def _all_indices(b: dict, divide) -> dict:
    """The thirteen indices by name, of columns or arrays alike."""
    red, nir, blue, swir = b["B04"], b["B08"], b["B02"], b["B11"]
    out = {name: divide(b[x] - b[y], b[x] + b[y]) for name, (x, y) in DIFFERENCES.items()}
    out["EVI"] = 2.5 * divide(nir - red, nir + 6 * red - 7.5 * blue + 1)
    out["SAVI"] = 1.5 * divide(nir - red, nir + red + 0.5)
    out["BSI"] = divide((swir + red) - (nir + blue), (swir + red) + (nir + blue))
    out["CIre"] = divide(b["B07"], b["B05"]) - 1
    return out


def indices(band: dict[str, Column]) -> dict[str, Column]:
    """The thirteen indices by name, from raw digital numbers (no scaling to reflectance)."""
    return _all_indices({k: c.cast("double") for k, c in band.items()}, safe_div)


def index_values(band: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The same over arrays."""
    return _all_indices(band, lambda num, den: num / np.where(np.abs(den) < EPS, EPS, den))


def legacy_index(a: Column, b: Column) -> Column:
    """The older form: reflectance scale and an additive guard."""
    x, y = a / 10000.0, b / 10000.0
    return (x - y) / (x + y + 1e-6)
