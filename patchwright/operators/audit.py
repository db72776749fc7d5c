"""Comparing regimes: class-major means, gaps, imputed cells, paired regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_major(cells: DataFrame, value: str, regime: str = "regime", cls: str = "class", exclude: Sequence = ()) -> DataFrame:
    """(regime, macro, n_classes, n_cells): mean over folds within a class, then over classes; undefined cells are skipped."""
    used = cells.where(~F.col(cls).isin(list(exclude))) if exclude else cells
    per_class = used.groupBy(regime, cls).agg(F.avg(value).alias("mean"), F.count(value).alias("cells"))
    return per_class.groupBy(regime).agg(F.avg("mean").alias("macro"), F.count("mean").alias("n_classes"), F.sum("cells").alias("n_cells"))


def imputed(cells: DataFrame, stand_ins: DataFrame, on: Sequence[str], value: str = "ap") -> DataFrame:
    """The cells with undefined values replaced by the stand-in of the same cell, where there is one. stand_ins: on, stand_in."""
    return cells.join(F.broadcast(stand_ins), list(on), "left").withColumn(value, F.coalesce(value, "stand_in")).drop("stand_in")


def gaps(macros: DataFrame, pairs: Sequence[tuple[str, str]], value: str = "macro", regime: str = "regime") -> DataFrame:
    """(gap, points): 100 times the difference of two regimes."""
    one = macros.agg(*(F.max(F.when(F.col(regime) == r, F.col(value))).alias(r) for r in sorted({x for p in pairs for x in p})))
    return one.select(F.inline(F.array(*(F.struct(F.lit(f"{a}-{b}").alias("gap"), ((F.col(a) - F.col(b)) * 100).alias("points")) for a, b in pairs))))


def paired(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of both sides by key with both scores. Sides: on, true_label, score."""
    b = right.select(*on, F.col("true_label").alias("true_b"), F.col("score").alias("score_b"))
    return left.select(*on, "true_label", "score").join(b, list(on))


def pairing_faults(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: keys on one side only, keys twice on a side, and pairs whose labels differ. All 0 for a one-to-one pairing."""
    a = left.groupBy(*on).agg(F.count("*").alias("n_a"), F.max("true_label").alias("true_a"))
    b = right.groupBy(*on).agg(F.count("*").alias("n_b"), F.max("true_label").alias("true_b"))
    both = a.join(b, list(on), "full")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    return both.agg(count(F.col("n_a").isNull() | F.col("n_b").isNull()).alias("unpaired"), count((F.col("n_a") > 1) | (F.col("n_b") > 1)).alias("repeated"), count(F.col("true_a") != F.col("true_b")).alias("label_differs"))


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))).alias("weighted_mean"))
