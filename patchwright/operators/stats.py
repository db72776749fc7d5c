"""Rank statistics: average ranks, Spearman, the exact Wilcoxon signed-rank test."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialise
from .metrics import cumulated

MAX_PAIRS = 200  # the exact test counts up to n (n + 1) rank sums


def value_ranks(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """counts (keys, score, n: rows of each distinct score, further columns) with `rank`: from the smallest up, ties share the mean of their ranks.

    Ranks come from running sums in balanced ranges of the scores, so neither a key nor the whole is one task."""
    down = cumulated(counts, keys, {"_k": "n"})
    sizes = counts.groupBy(*(F.col(c).alias(f"_of_{c}") for c in keys)).agg(F.sum("n").alias("_size"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    joined = down.join(sizes, reduce(lambda a, b: a & b, same)) if keys else down.crossJoin(F.broadcast(sizes))  # no keys: one row
    return joined.select(*counts.columns, (F.col("_size") - F.col("_k") + (F.col("n") + 1) / 2.0).alias("rank"))


def with_rank(df: DataFrame, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """df with the average rank of each row's value, which must not be null."""
    ranks = value_ranks(df.groupBy(*keys, F.col(value).alias("score")).agg(F.count("*").alias("n")), keys)
    ranks = ranks.select(*(F.col(c).alias(f"_in_{c}") for c in keys), F.col("score").alias("_score"), F.col("rank").alias(out))
    same = [F.col(value) == F.col("_score"), *(F.col(c).eqNullSafe(F.col(f"_in_{c}")) for c in keys)]
    return df.join(ranks, reduce(lambda a, b: a & b, same)).select(*(F.col(f"`{c}`") for c in df.columns), out)


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, rho, p_value); rho is null under two rows, p under three."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = with_rank(with_rank(both, x, "_x", keys), y, "_y", keys)
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("*") >= 2, F.corr("_x", "_y")).alias("rho"))
    df_ = F.col("n") - 2
    t = F.col("rho") * F.sqrt(df_ / (1 - F.col("rho") * F.col("rho")))
    p = F.when(F.abs("rho") >= 1, 0.0).when(df_ >= 1, student_p(t, df_))
    return out.withColumn("p_value", p)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t on a whole number of degrees of freedom, by the finite sum of its distribution function."""
    angle = F.atan2(F.abs(t), F.sqrt(df.cast("double")))
    cos2 = F.cos(angle) * F.cos(angle)
    odd = df % 2 == 1
    # terms 1, 2/3 cos^2, 2/3 4/5 cos^4, ... (odd) or 1, 1/2 cos^2, 1/2 3/4 cos^4, ... (even)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    count = F.floor((df - F.when(odd, 3).otherwise(2)) / 2).cast("int")

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * cos2 * F.when(odd, 2.0 * k / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    terms = F.when(count >= 1, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(terms, start, step, lambda s: s["total"])
    inside = F.when(df == 1, 2 / math.pi * angle).when(odd, 2 / math.pi * (angle + F.sin(angle) * F.cos(angle) * total)).otherwise(F.sin(angle) * total)
    return F.greatest(F.lit(0.0), 1 - inside)


def wilcoxon(df: DataFrame, delta: str) -> DataFrame:
    """One row (n, w_plus, w_minus, statistic, p_value, method): two-sided signed ranks, zeros left out.

    Up to MAX_PAIRS pairs the test is exact: the sign patterns with each rank sum are counted, rank by rank (sums are whole
    numbers of halves). Beyond, it is the normal approximation with the correction for ties; `method` says which."""
    some = df.where(F.col(delta).isNotNull() & (F.col(delta) != 0)).select(F.col(delta).alias("d"))
    counts = some.groupBy(F.abs("d").alias("score")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("plus"))
    ranked = materialise(value_ranks(counts), "ranks")
    r, n, plus = F.col("rank"), F.col("n"), F.col("plus")
    one = ranked.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n"), F.sum(plus * r).alias("w_plus"), F.sum((n - plus) * r).alias("w_minus"), F.sum(n * r * r).alias("squares"))
    one = one.where("n > 0").withColumn("statistic", F.least("w_plus", "w_minus"))
    # few rows: no more than MAX_PAIRS ranks, each at most MAX_PAIRS + 1 times, are listed; more are not used
    repeated = F.array_repeat((2 * r).cast("int"), F.least(n, F.lit(MAX_PAIRS + 1)).cast("int"))
    small = ranked.limit(MAX_PAIRS + 1).agg(F.sort_array(F.flatten(F.collect_list(repeated))).alias("ranks"))
    one = one.crossJoin(F.broadcast(small))
    size = (2 * (F.col("w_plus") + F.col("w_minus"))).cast("int")

    def shifted(ways: Column, r: Column) -> Column:
        return F.zip_with(ways, F.concat(F.array_repeat(F.lit(0.0), r), F.slice(ways, F.lit(1), F.size(ways) - r)), lambda a, b: a + b)

    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), size))
    ways = F.aggregate("ranks", start, shifted)
    below = F.aggregate(F.slice(ways, F.lit(1), (2 * F.col("statistic")).cast("int") + 1), F.lit(0.0), lambda s, x: s + x)
    exact = 2 * below / F.pow(F.lit(2.0), F.col("n"))
    # mean and variance of the rank sum under the hypothesis: half, and a quarter of the sum of squared ranks (ties included)
    z = (F.col("statistic") - (F.col("w_plus") + F.col("w_minus")) / 2) / F.sqrt(F.col("squares") / 4)
    approximate = 2 * normal_tail(-z)
    few = F.col("n") <= MAX_PAIRS
    p = F.least(F.lit(1.0), F.when(few, exact).otherwise(approximate))
    return one.select("n", "w_plus", "w_minus", "statistic", p.alias("p_value"), F.when(few, "exact").otherwise("normal").alias("method"))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z of 0 or more: the series of the error function below 6, the leading terms of its tail beyond."""
    def step(s: Column, k: Column) -> Column:
        term = s["term"] * z * z / (2.0 * k + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    start = F.struct(z.alias("term"), z.alias("total"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, step, lambda s: s["total"])
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    far = density / z * (1 - 1 / (z * z) + 3 / (z * z * z * z))
    return F.when(z < 5, F.greatest(F.lit(0.0), 0.5 - density * total)).otherwise(far)


def summary(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*keys).agg(F.count(value).alias("n"), q[1].alias("median"), q[0].alias("q1"), q[2].alias("q3"), (q[2] - q[0]).alias("iqr"))
