"""Gates: one-row aggregates of checks that stop a pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nan_inf(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_null, n_nan, n_inf) of every column, in one pass."""
    def cells(c: str):
        x = F.col(c).cast("double")
        n = lambda b: F.sum(F.coalesce(b, F.lit(False)).cast("bigint"))
        return F.struct(F.lit(c).alias("column"), n(x.isNull()).alias("n_null"), n(F.isnan(x)).alias("n_nan"), n(F.abs(x) == float("inf")).alias("n_inf"))

    return df.agg(F.array(*(cells(c) for c in columns)).alias("cells")).select(F.inline("cells"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, rows beyond the first of their key."""
    each = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def rate_deviation(part: DataFrame, whole: DataFrame, cls: str = "class") -> DataFrame:
    """(class, part_rate, whole_rate, deviation). Frames: class, rate."""
    a, b = part.select(cls, F.col("rate").alias("part_rate")), whole.select(cls, F.col("rate").alias("whole_rate"))
    return a.join(b, cls, "full").withColumn("deviation", F.abs(F.coalesce("part_rate", F.lit(0.0)) - F.coalesce("whole_rate", F.lit(0.0))))


def gate(**checks: DataFrame) -> DataFrame:
    """(check, passed) of several one-row frames with one boolean, and whether all passed."""
    out = None
    for name, frame in checks.items():
        row = frame.toDF("passed").select(F.lit(name).alias("check"), F.coalesce("passed", F.lit(False)).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out.unionByName(out.agg(F.lit("all").alias("check"), F.bool_and("passed").alias("passed")))


def require(report: DataFrame) -> None:
    """Stops with the names of the checks that failed."""
    failed = [r["check"] for r in report.where("NOT passed").collect()]
    if failed:
        raise ValueError(f"gate failed: {failed}")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys on both sides, on the left only, on the right only."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    both = a.join(b, key, "full")
    return both.agg(F.count(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1)).alias("n_both"), F.count(F.when(F.col("r").isNull(), 1)).alias("n_left_only"), F.count(F.when(F.col("l").isNull(), 1)).alias("n_right_only"))
