"""Spatial autocorrelation on a grid of places: Moran's I with rook neighbours, and its p by permutation.

Neighbours meet by an equi-join on (keys, gx, gy), each link once, so no key's places meet in one task. For the
permutations, a key's places are dealt to blocks of at most BLOCK in hash order; in a block each place gets for every
permutation the value of a place so many steps on. A place then carries the numbers of all permutations as one array, so
the join for links is the same one, with as many rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialise
from .sampling import hash_rank

BLOCK = 4096


def steps(seed: int, permutations: int, rows: int) -> np.ndarray:
    """How many places on the value of each permutation comes from: from 1 to rows - 1."""
    draws = [int(hashlib.md5(f"{seed}:{d}".encode()).hexdigest()[:8], 16) for d in range(permutations)]
    return np.array([1 + h % (rows - 1) if rows > 1 else 0 for h in draws], np.int64)


def morans_grid(places: DataFrame, keys: Sequence[str], value: str, permutations: int = 99, seed: int = 42, gx: str = "gx", gy: str = "gy") -> DataFrame:
    """(keys, n, links, moran, expected, p): places of one position count with their mean value; null values and positions are left out.

    moran: n / links * sum over links of z z' / sum of z^2, null without links or variance. p: the share of permutations,
    the observed one included, with at least the observed sum (positive autocorrelation), null where moran is."""
    keys = list(keys)
    kinds = dict(places.dtypes)
    grid = places.where(F.col(value).isNotNull() & F.col(gx).isNotNull() & F.col(gy).isNotNull())
    grid = grid.groupBy(*keys, F.col(gx).cast("bigint").alias("x"), F.col(gy).cast("bigint").alias("y")).agg(F.avg(value).alias("v"))
    grid = grid.withColumn("place", F.concat_ws(":", "x", "y"))
    ranked = hash_rank(grid, keys, seed, [*keys, "place"]).withColumn("block", F.floor((F.col("_rank") - 1) / BLOCK).cast("bigint")).drop("_h")
    names = ", ".join(f"`{c}` {kinds[c]}" for c in keys)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_rank", "ascending")])
        v, m = t.column("v").to_numpy(), t.num_rows
        at = (np.arange(m)[:, None] + steps(seed, permutations, m)[None, :]) % m
        moved = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * (permutations + 1), pa.int32()), pa.array(np.concatenate([v[:, None], v[at]], axis=1).ravel()))
        return pa.table([*(t.column(c) for c in (*keys, "x", "y")), moved], names=[*keys, "x", "y", "w"])

    cells = materialise(ranked.groupBy(*keys, "block").applyInArrow(run, f"{names}, x bigint, y bigint, w array<double>"), "grid")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in keys]
    own = F.get("w", 0)
    mean = cells.groupBy(*keys).agg(F.avg(own).alias("mean"), F.count("*").alias("n"), F.var_pop(own).alias("spread"))
    link = F.explode(F.array(*(F.struct((F.col("x") + dx).cast("bigint").alias("x"), (F.col("y") + dy).cast("bigint").alias("y")) for dx, dy in ((1, 0), (0, 1)))))
    ends = cells.select(*keys, "w", link.alias("to")).alias("a")
    on = _all([*same("a", "b"), F.col("a.to.x") == F.col("b.x"), F.col("a.to.y") == F.col("b.y")])
    pairs = ends.join(cells.alias("b"), on).select(*(F.col(f"a.{c}").alias(c) for c in keys), F.col("a.w").alias("p"), F.col("b.w").alias("q"))
    # sum (p - mean)(q - mean) = sum pq - mean * sum (p + q) + links * mean^2, for each permutation
    sums = [F.sum(f(F.get("p", k), F.get("q", k))).alias(f"{name}{k}") for k in range(permutations + 1) for name, f in (("pq", lambda a, b: a * b), ("pp", lambda a, b: a + b))]
    summed = pairs.groupBy(*keys).agg(F.count("*").alias("links"), *sums)
    both = mean.alias("m").join(summed.alias("s"), _all(same("m", "s")), "left").select(*(F.col(f"m.{c}").alias(c) for c in keys), "mean", "n", "spread", F.coalesce("links", F.lit(0)).alias("links"), *(f"{a}{k}" for k in range(permutations + 1) for a in ("pq", "pp")))
    of = lambda k: F.round((F.col(f"pq{k}") - F.col("mean") * F.col(f"pp{k}") + F.col("links") * F.col("mean") ** 2) / F.col("links") / F.col("spread"), 9)
    some = (F.col("links") > 0) & (F.col("spread") > 0)
    beyond = sum((of(k) >= of(0)).cast("int") for k in range(1, permutations + 1)) + 1
    return both.select(*keys, "n", "links", F.when(some, of(0)).alias("moran"), F.when(F.col("n") > 1, -1.0 / (F.col("n") - 1)).alias("expected"), F.when(some, beyond / (permutations + 1.0)).alias("p"))


def _all(conditions):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
