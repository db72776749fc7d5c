"""Four split regimes of rising strictness, and their audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded


def exact_random(patches: DataFrame, seed: int, name: str = "s1_split", patch: str = "patch_id") -> DataFrame:
    """An exact 50/25/25 cut of the patches in the order of a seeded hash.

    A global rank without a single-task window: ranks within hash ranges, plus the sizes of the ranges before."""
    ordered = patches.select(patch, seeded(seed, F.col(patch)).alias("h")).withColumn("bucket", F.substring("h", 1, 2))
    sizes = ordered.groupBy("bucket").agg(F.count("*").alias("n"))
    before = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))  # 256 rows at most
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("h", patch))
    placed = ordered.withColumn("in_bucket", rank).join(F.broadcast(before), "bucket")
    at = F.col("before") + F.col("in_bucket")
    train, validation = F.bround(F.col("total") * 0.5), F.bround(F.col("total") * 0.25)
    cut = F.when(at <= train, "train").when(at <= train + validation, "validation").otherwise("test")
    return placed.select(patch, cut.alias(name))


def lpt_folds(sizes: DataFrame, key: str, size: str, folds: int) -> DataFrame:
    """(key, fold, n): largest first into the lightest fold, the lowest of equals; groups of equal size by key.

    Sequential by nature, over one row per group (tiles, not patches): a fold inside one array."""
    start = F.struct(F.array(*(F.lit(0).cast("bigint") for _ in range(folds))).alias("load"), F.array().cast("array<struct<k:string,n:bigint,fold:bigint>>").alias("out"))

    def place(s: Column, g: Column) -> Column:
        at = F.array_position(s["load"], F.array_min(s["load"]))
        load = F.transform(s["load"], lambda x, i: F.when(i + 1 == at, x + g["n"]).otherwise(x))
        return F.struct(load.alias("load"), F.concat(s["out"], F.array(F.struct(g["k"].alias("k"), g["n"].alias("n"), (at - 1).alias("fold")))).alias("out"))

    groups = F.array_sort(F.collect_list(F.struct((-F.col(size)).alias("minus"), F.col(key).cast("string").alias("k"), F.col(size).cast("bigint").alias("n"))))
    one = sizes.agg(F.aggregate(groups, start, place, lambda s: s["out"]).alias("out"))
    return one.select(F.inline("out")).select(F.col("k").alias(key), "fold", "n")


def leave_tile_out(patches: DataFrame, folds: int = 5, tile: str = "tile") -> DataFrame:
    """The patches with s3_fold."""
    sizes = patches.groupBy(tile).agg(F.count("*").alias("n"))
    fold = lpt_folds(sizes, tile, "n", folds).select(tile, F.col("fold").alias("s3_fold"))
    return patches.join(F.broadcast(fold), tile)


def roles_list() -> Column:
    """The (regime, fold, role) of every evaluated cell of a patch with s1_split, s2_split, s3_fold, s4_fold, as an array."""
    plain = F.array(*(F.struct(F.lit(r).alias("regime"), F.lit("all").alias("fold"), F.col(f"{r}_split").alias("role")) for r in ("s1", "s2")))
    own = F.array(F.struct(F.lit("s3").alias("regime"), F.col("s3_fold").cast("string").alias("fold"), F.lit("test").alias("role")), F.struct(F.lit("s4").alias("regime"), F.col("s4_fold").alias("fold"), F.lit("test").alias("role")))
    return F.concat(plain, own)


def all_roles(patches: DataFrame, s3_folds: int = 5) -> DataFrame:
    """(patch_id, regime, fold, role) of every evaluated cell: one frame for all regimes. patches: s1_split, s2_split, s3_fold, s4_fold."""
    return patches.select("patch_id", F.inline(roles_list()))


def validity(roles: DataFrame, all_patches: DataFrame, patch: str = "patch_id", role: str = "role") -> DataFrame:
    """One row: patches in several roles, without a role, and not among the patches."""
    each = roles.groupBy(patch).agg(F.count_distinct(role).alias("roles"), F.count(role).alias("filled"))
    out = all_patches.select(patch, F.lit(1).alias("known")).join(each, patch, "full")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    return out.agg(count(F.col("roles") > 1).alias("n_overlap"), count(F.coalesce("filled", F.lit(0)) == 0).alias("n_missing"), count(F.col("known").isNull()).alias("n_foreign"))


def fold_positives(long_labels: DataFrame, fold: str, cls: str = "class") -> DataFrame:
    """(fold, class, test_pos, train_pos) by leave one fold out: the total less the fold, in one pass."""
    cells = long_labels.groupBy(fold, cls).agg(F.sum("label").alias("test_pos"))
    total = F.sum("test_pos").over(Window.partitionBy(cls))
    return cells.withColumn("train_pos", total - F.col("test_pos"))


def coverage_violations(long_labels: DataFrame, fold: str, cls: str = "class") -> DataFrame:
    """The (fold, class) whose training part has no positive."""
    return fold_positives(long_labels, fold, cls).where("train_pos = 0")


def fold_spread(long_labels: DataFrame, fold: str, rarest: int, cls: str = "class") -> DataFrame:
    """(class, n_pos, n_folds) of the rarest classes: in how many folds each occurs."""
    pos = long_labels.where("label = 1").groupBy(cls).agg(F.count("*").alias("n_pos"), F.count_distinct(fold).alias("n_folds"))
    return pos.orderBy("n_pos", cls).limit(rarest)


def shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of values, absolute and as a share of all."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(*columns, "n", (F.col("n") / F.col("total")).alias("share"))  # one row
