"""Ranking and threshold metrics over long predictions.

Predictions are rows (keys..., true_label, score). Every metric groups by keys: regimes, folds and
classes are grouping keys, never loops. Scores are first reduced to one row per distinct value,
so the window behind a curve sorts distinct scores within one key, after a partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialise


def score_counts(pred: DataFrame, keys: Sequence[str], label: str = "true_label", score: str = "score", weight: str | None = None) -> DataFrame:
    """(keys, score, pos, n): weights at each distinct score."""
    w = F.lit(1) if weight is None else F.col(weight)
    return pred.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(w * F.col(label)).alias("pos"), F.sum(w).alias("n"))


#: A range of scores within a key has about so many rows; a task holds some of them.
RANGE_ROWS = 500_000


def score_ranges(df: DataFrame, keys: Sequence[str], out: str = "_range", score: str = "score", rows: int = RANGE_ROWS) -> DataFrame:
    """df with the number of the range that its score is in, from 0 for the highest scores; a key's ranges have about as many rows each.

    The borders are quantiles of a key's scores from a mergeable sketch, a row a key, written, as two runs of a sketch may
    differ. There are as many ranges as the largest key needs; equal scores share one. NaN counts as highest, null as lowest. df is read twice: pass a written table."""
    largest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = -(-largest // rows)
    value = F.col(score).cast("double")
    if parts <= 1:
        return df.withColumn(out, F.when(value.isNull(), 1).otherwise(0))
    cuts = [k / parts for k in range(1, parts)]
    sketch = df.where(value.isNotNull() & ~F.isnan(value)).groupBy(*keys).agg(F.percentile_approx(value, cuts, 50 * parts).alias("_cuts"))
    named = materialise(sketch.select(*(F.col(c).alias(f"_k_{c}") for c in keys), "_cuts"), "cuts")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]
    joined = df.join(named, reduce(lambda a, b: a & b, same), "left") if keys else df.crossJoin(F.broadcast(named))  # no keys: one row
    above = F.size(F.filter("_cuts", lambda c: c > value))
    number = F.when(value.isNull(), parts).when(F.col("_cuts").isNull() | F.isnan(value), 0).otherwise(above)
    return joined.withColumn(out, number.cast("int")).drop("_cuts", *(f"_k_{c}" for c in keys))


def cumulated(counts: DataFrame, keys: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """counts with running sums from the highest score down; sums maps the new name to the column.

    Sums run within balanced ranges of the score, to which the totals of the ranges above are added: a key with many distinct
    scores is spread over its ranges. counts are written once."""
    ranged = score_ranges(materialise(counts, "counts"), keys)
    totals = ranged.groupBy(*keys, "_range").agg(*(F.sum(c).alias(f"_{name}") for name, c in sums.items()))
    above = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    own = [F.col(c).alias(f"_k_{c}") for c in (*keys, "_range")]
    totals = totals.select(*own, *(F.coalesce(F.sum(f"_{name}").over(above), F.lit(0)).alias(f"_above_{name}") for name in sums))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*keys, "_range")]
    down = Window.partitionBy(*keys, "_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(totals, reduce(lambda a, b: a & b, same))
    return joined.select(*counts.columns, *((F.sum(c).over(down) + F.col(f"_above_{name}")).alias(name) for name, c in sums.items()))


def curve(pred: DataFrame, keys: Sequence[str], **columns) -> DataFrame:
    """(keys, score, pos, n, tp, k): weights at each distinct score, and cumulated from the highest score down."""
    return cumulated(score_counts(pred, keys, **columns), keys, {"tp": "pos", "k": "n"})


def rank_sums(pos: str = "pos", n: str = "n", tp: str = "tp", k: str = "k") -> tuple[Column, Column]:
    """(ap, auroc) of a curve, as aggregates."""
    pos, n, tp, k = F.col(pos), F.col(n), F.col(tp), F.col(k)
    gain = F.sum(pos * (tp / F.nullif(k.cast("double"), F.lit(0.0))))
    below = F.sum((n - pos) * (tp - pos / 2.0))
    positive, negative = F.sum(pos).cast("double"), (F.sum(n) - F.sum(pos)).cast("double")
    return gain / F.nullif(positive, F.lit(0.0)), below / F.nullif(positive * negative, F.lit(0.0))


def ranking(pred: DataFrame, keys: Sequence[str], **columns) -> DataFrame:
    """(keys, n, n_pos, ap, auroc). ap: step-wise average precision, null without positives; auroc: ties count half, null with one class."""
    ap, auroc = rank_sums()
    return curve(pred, keys, **columns).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("pos").alias("n_pos"), ap.alias("ap"), auroc.alias("auroc"))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    """F1, 0 where nothing is true or predicted."""
    return F.coalesce(2.0 * tp / F.nullif((2.0 * tp + fp + fn).cast("double"), F.lit(0.0)), F.lit(0.0))


def confusion(pred: DataFrame, keys: Sequence[str], threshold: Column, label: str = "true_label", score: str = "score") -> DataFrame:
    """(keys, tp, fp, fn, tn) at an inclusive threshold, a column of the rows."""
    hit, true = F.col(score) >= threshold, F.col(label) == 1
    count = lambda c: F.sum(c.cast("bigint"))
    return pred.groupBy(*keys).agg(count(hit & true).alias("tp"), count(hit & ~true).alias("fp"), count(~hit & true).alias("fn"), count(~hit & ~true).alias("tn"))


def macro(cells: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means that skip undefined cells, each with the number of cells used."""
    return cells.groupBy(*keys).agg(*(f for v in values for f in (F.avg(v).alias(f"{v}_macro"), F.count(v).alias(f"{v}_used"))))


def hamming_subset(pred: DataFrame, keys: Sequence[str], threshold: Column, patch: str = "patch_id") -> DataFrame:
    """(keys, hamming, subset_accuracy): the share of wrong cells, and of patches without one."""
    wrong = ((F.col("score") >= threshold) != (F.col("true_label") == 1)).cast("bigint")
    each = pred.groupBy(*keys, patch).agg(F.sum(wrong).alias("wrong"), F.count("*").alias("cells"))
    return each.groupBy(*keys).agg((F.sum("wrong") / F.sum("cells")).alias("hamming"), F.avg((F.col("wrong") == 0).cast("double")).alias("subset_accuracy"))


def macro_micro(pred: DataFrame, keys: Sequence[str], threshold: Column, cls: str = "class") -> DataFrame:
    """One row per key: AP, AUROC and F1 macro and micro, and the classes used; all from one reduction of the cells to counts by score.

    Micro ranking pools only classes whose own cell is defined; micro F1 pools all."""
    counts = materialise(score_counts(pred, [*keys, cls]), "counts")  # all below comes from this
    hit = F.col("score") >= threshold
    count = lambda c, x: F.sum(F.when(c, x).otherwise(0))
    ap, auroc = rank_sums()
    wrong = {"tp": count(hit, F.col("pos")), "fp": count(hit, F.col("n") - F.col("pos")), "fn": count(~hit, F.col("pos"))}
    cells = cumulated(counts, [*keys, cls], {"tp": "pos", "k": "n"}).groupBy(*keys, cls)
    cells = materialise(cells.agg(ap.alias("ap"), auroc.alias("auroc"), *(v.alias(f"n_{c}") for c, v in wrong.items())), "cells")
    f1 = f1_of(F.col("n_tp"), F.col("n_fp"), F.col("n_fn"))
    used = [f for v in ("ap", "auroc") for f in (F.avg(v).alias(f"{v}_macro"), F.count(v).alias(f"{v}_used"))]
    out = cells.groupBy(*keys).agg(*used, F.avg(f1).alias("f1_macro"), f1_of(F.sum("n_tp"), F.sum("n_fp"), F.sum("n_fn")).alias("f1_micro"))
    # pooled over the classes that are defined for each of both metrics
    defined = cells.select(*keys, cls, F.col("ap").isNotNull().alias("has_ap"), F.col("auroc").isNotNull().alias("has_auroc"))
    sums = [count(F.col(f"has_{m}"), F.col(c)).alias(f"{c}_{m}") for m in ("ap", "auroc") for c in ("pos", "n")]
    pooled = counts.join(defined, [*keys, cls]).groupBy(*keys, "score").agg(*sums)
    pooled = cumulated(pooled, keys, {f"{t}_{m}": f"{c}_{m}" for m in ("ap", "auroc") for t, c in (("tp", "pos"), ("k", "n"))})
    micro = {m: rank_sums(*(f"{c}_{m}" for c in ("pos", "n", "tp", "k")))[i] for i, m in enumerate(("ap", "auroc"))}
    return out.join(pooled.groupBy(*keys).agg(*(v.alias(f"{m}_micro") for m, v in micro.items())), list(keys), "left")


def bundle(pred: DataFrame, keys: Sequence[str], threshold: Column, cls: str = "class", patch: str = "patch_id") -> DataFrame:
    """macro_micro with Hamming loss and subset accuracy."""
    return macro_micro(pred, keys, threshold, cls).join(hamming_subset(pred, keys, threshold, patch), list(keys))


def pr_points(pred: DataFrame, keys: Sequence[str], **columns) -> DataFrame:
    """(keys, threshold, precision, recall, f1) at each distinct score."""
    total = F.sum("pos").over(Window.partitionBy(*keys))
    c = curve(pred, keys, **columns).withColumn("all_pos", total)
    f1 = f1_of(F.col("tp"), F.col("k") - F.col("tp"), F.col("all_pos") - F.col("tp"))
    return c.select(*keys, F.col("score").alias("threshold"), (F.col("tp") / F.col("k")).alias("precision"), (F.col("tp") / F.nullif(F.col("all_pos").cast("double"), F.lit(0.0))).alias("recall"), f1.alias("f1"), "all_pos")


def tune_threshold(validation: DataFrame, keys: Sequence[str], default: float, **columns) -> DataFrame:
    """(keys, threshold, val_f1): the lowest threshold of the greatest F1, the default at F1 0 without positives. Sees validation rows only."""
    points = pr_points(validation, keys, **columns)
    best = points.groupBy(*keys).agg(F.max(F.struct("f1", (-F.col("threshold")).alias("low"))).alias("best"), F.max("all_pos").alias("all_pos"))
    some = F.col("all_pos") > 0
    return best.select(*keys, F.when(some, -F.col("best.low")).otherwise(F.lit(default)).alias("threshold"), F.when(some, F.col("best.f1")).otherwise(0.0).alias("val_f1"))


def common_matrix(pred: DataFrame, keys: Sequence[str], n_classes: int, cls: str = "class", patch: str = "patch_id") -> DataFrame:
    """The rows of patches that every class has scored: relational division by one count."""
    full = pred.groupBy(*keys, patch).agg(F.count_distinct(cls).alias("n")).where(F.col("n") == n_classes).select(*keys, patch)
    return pred.join(full, [*keys, patch], "left_semi")
