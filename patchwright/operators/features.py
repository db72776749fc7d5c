"""Features of a patch: statistics of bands and indices over its pixels, in one aggregation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import raster
from ..functions.spectral import index_values, indices

STATS = ("mean", "std", "p10", "p50", "p90", "iqr")


def band_statistics(name: str, value: Column, weight: Column | None = None) -> list[Column]:
    """Six statistics of a column: mean, population std, exact percentiles 10, 50, 90, and the interquartile range.

    weight: how often a native pixel stands on the common grid (percentiles take it as a frequency)."""
    v = value.cast("double")
    points = F.array(*(F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)))
    q = F.percentile(v, points) if weight is None else F.percentile(v, points, weight)
    if weight is None:
        mean, std = F.avg(v), F.stddev_pop(v)
    else:
        mean = F.sum(v * weight) / F.sum(weight)
        std = F.sqrt(F.greatest(F.sum(v * v * weight) / F.sum(weight) - mean * mean, F.lit(0.0)))
    return [mean.alias(f"{name}_mean"), std.alias(f"{name}_std"), q[0].alias(f"{name}_p10"), q[2].alias(f"{name}_p50"), q[4].alias(f"{name}_p90"), (q[3] - q[1]).alias(f"{name}_iqr")]


def index_statistics(name: str, value: Column) -> list[Column]:
    return [F.avg(value).alias(f"{name}_mean"), F.stddev_pop(value).alias(f"{name}_std")]


def patch_features(pixels: DataFrame, bands: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """Band and index statistics per patch from one row per pixel: one shuffle for all of them."""
    found = indices(bands)
    named = pixels.select(*keys, *(c.cast("double").alias(b) for b, c in bands.items()), *(c.alias(n) for n, c in found.items()))
    return named.groupBy(*keys).agg(*(s for b in bands for s in band_statistics(b, F.col(b))), *(s for n in found for s in index_statistics(n, F.col(n))))


def texture(name: str, a: Column, n: int) -> list[Column]:
    """Std and 90th percentile of 3x3 variance, 7x7 variance and Sobel magnitude of a raster."""
    maps = {"var3x3": raster.local_variance(a, n, 3), "var7x7": raster.local_variance(a, n, 7), "sobel": raster.sobel(a, n)}
    out = []
    for k, m in maps.items():
        both = raster.bind(m, lambda x: F.struct(raster.array_std(x).alias("std"), raster.array_percentile(x, 0.9).alias("p90")))
        out += [both["std"].alias(f"{name}_{k}_std"), both["p90"].alias(f"{name}_{k}_p90")]
    return out


def numbered(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """The features as FLOAT columns f_000, f_001, ... in the order of their names; and which is which."""
    names = sorted(c for c in df.columns if c not in keys)
    codes = {f"f_{i:03d}": c for i, c in enumerate(names)}
    return df.select(*keys, *(F.col(f"`{c}`").cast("float").alias(k) for k, c in codes.items())), codes


def _percentiles(a: np.ndarray, points: Sequence[float]) -> list[np.ndarray]:
    """Percentiles along the last axis by linear interpolation, from one partial sort."""
    place = [(a.shape[-1] - 1) * p for p in points]
    low = [int(x) for x in place]
    high = [min(x + 1, a.shape[-1] - 1) for x in low]
    part = np.partition(a, sorted({*low, *high}), axis=-1)
    return [part[..., lo] + (part[..., hi] - part[..., lo]) * (x - lo) for x, lo, hi in zip(place, low, high, strict=True)]


def _band_values(name: str, a: np.ndarray) -> dict[str, np.ndarray]:
    p10, p25, p50, p75, p90 = _percentiles(a, (0.1, 0.25, 0.5, 0.75, 0.9))
    return dict(zip((f"{name}_{s}" for s in STATS), (a.mean(axis=-1), a.std(axis=-1), p10, p50, p90, p75 - p25), strict=True))


def _texture_values(name: str, grid: np.ndarray) -> dict[str, np.ndarray]:
    """grid: patches x n x n."""
    out = {}
    for k, m in (("var3x3", raster.variance_of(grid, 3)), ("var7x7", raster.variance_of(grid, 7)), ("sobel", raster.sobel_of(grid))):
        flat = m.reshape(len(m), -1)
        out |= {f"{name}_{k}_std": flat.std(axis=-1), f"{name}_{k}_p90": _percentiles(flat, (0.9,))[0]}
    return out


def patch_values(grids: dict[str, np.ndarray], textured: Sequence[str]) -> dict[str, np.ndarray]:
    """All features of some patches: band -> patches x n x n, float64, on one grid."""
    flat = {b: g.reshape(len(g), -1) for b, g in grids.items()}
    out: dict[str, np.ndarray] = {}
    for b, a in flat.items():
        out |= _band_values(b, a)
    for name, a in index_values(flat).items():
        out |= {f"{name}_mean": a.mean(axis=-1), f"{name}_std": a.std(axis=-1)}
    for b in textured:
        out |= _texture_values(b, grids[b])
    return out


#: Patches computed together: their rasters fit the processor's caches.
TOGETHER = 4


def _in_arrow(rasters: DataFrame, columns: Sequence[str], keys: Sequence[str], names: Sequence[str], compute) -> DataFrame:
    """(keys, names) by compute(columns as patches x cells) -> name -> patches, map side, in Arrow batches. A row without one of its rasters has nulls."""
    schema = StructType([*(rasters.schema[k] for k in keys), *(StructField(n, DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(len(keys) + k) for k in range(len(columns))]
            whole = np.flatnonzero(np.all([np.asarray(c.is_valid()) for c in own], axis=0))
            out = {n: np.full(batch.num_rows, np.nan) for n in names}
            for i in range(0, len(whole), TOGETHER):
                rows = whole[i : i + TOGETHER]
                taken = [c.take(pa.array(rows)) for c in own]
                for n, v in compute({b: c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1) for b, c in zip(columns, taken, strict=True)}).items():
                    out[n][rows] = v
            none = np.ones(batch.num_rows, bool)
            none[whole] = False
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(out[n], mask=none) for n in names)], names=[*keys, *names])

    return rasters.select(*keys, *columns).mapInArrow(run, schema)


def textures(rasters: DataFrame, columns: dict[str, str], n: int, keys: Sequence[str]) -> DataFrame:
    """(keys, texture features) of n x n rasters; columns maps a name to an array column."""
    names = [f"{b}_{k}_{s}" for b in columns for k in ("var3x3", "var7x7", "sobel") for s in ("std", "p90")]

    def compute(cells: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for b, c in columns.items():
            out |= _texture_values(b, cells[c].reshape(-1, n, n))
        return out

    return _in_arrow(rasters, [*columns.values()], keys, names, compute)


def composite(rasters: DataFrame, bands: dict[str, tuple[str, int]], size: int, keys: Sequence[str], textured: Sequence[str] = ("B08", "B04")) -> DataFrame:
    """All features of a patch from native rasters: bands maps a band to (array column, native edge length).

    All work on a patch is inside its row, so the job is one map-side pass: neither cells as rows nor a shuffle."""
    one = patch_values({b: np.ones((1, size, size)) for b in bands}, textured)  # for the names
    at = {b: np.asarray(raster.nearest_index(n, size)) for b, (_, n) in bands.items()}

    def compute(cells: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        grids = {b: cells[c].reshape(-1, n, n)[:, at[b]][:, :, at[b]] for b, (c, n) in bands.items()}
        return patch_values(grids, textured)

    return _in_arrow(rasters, [*dict.fromkeys(c for c, _ in bands.values())], keys, [*one], compute)
