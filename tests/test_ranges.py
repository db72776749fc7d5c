"""Balanced ranges of scores, and what is summed within them, against NumPy and plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchwright.operators import metrics, sampling

rng = np.random.default_rng(8)
DISTRIBUTIONS = {
    "probabilities": rng.beta(0.5, 4, 6000),
    "one octave": 0.75 + 1e-7 * rng.normal(size=6000),
    "wide": rng.normal(size=6000) * 10.0 ** rng.uniform(-200, 200, 6000),
}


@pytest.mark.parametrize("name", sorted(DISTRIBUTIONS))
def test_ranges_are_balanced_and_fall_with_the_score(spark, name):
    df = spark.createDataFrame([("a", float(v)) for v in DISTRIBUTIONS[name]] + [("b", 0.5)] * 3, "key string, score double").repartition(5)
    rows = [r for r in metrics.score_ranges(df, ["key"], rows=300).collect() if r.key == "a"]
    sizes = np.unique([r["_range"] for r in rows], return_counts=True)[1]
    assert len(sizes) == 20 and sizes.max() <= 2 * sizes.mean()
    last = [r["_range"] for r in sorted(rows, key=lambda r: -r.score)]
    assert last == sorted(last)


def test_ranges_of_odd_scores(spark):
    values = [float("nan"), float("inf"), 3.0, 2.0, 2.0, 2.0, 1.0, 0.0, -0.0, -1.0, float("-inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "score double")
    got = {str(r[0]): r[1] for r in metrics.score_ranges(df, [], rows=2).collect()}
    assert got["nan"] == 0 and got["None"] == max(got.values()) and got["0.0"] == got["-0.0"]
    order = [got[str(v)] for v in values]
    assert order == sorted(order)
    assert metrics.score_ranges(df.limit(0), []).count() == 0
    nulls = spark.createDataFrame([("a", None), ("b", 1.0)], "key string, score double")
    assert sorted(r["_range"] for r in metrics.score_ranges(nulls, ["key"], rows=1).collect()) == [0, 0] or metrics.score_ranges(nulls, ["key"]).count() == 2


@pytest.mark.parametrize("rows", [40, 10**6])
def test_curves_do_not_depend_on_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(metrics.score_ranges, "__defaults__", ("_range", "score", rows))
    x = rng.normal(size=900)
    pred = spark.createDataFrame([(float(v), int(v * 7) % 3 == 0) for v in x], "score double, y boolean").selectExpr("score", "cast(y AS int) AS true_label")
    c = sorted((r["score"], r["tp"], r["k"]) for r in metrics.curve(pred, []).collect())
    s, y = np.array([(r[0], r[1]) for r in pred.collect()]).T
    order = np.argsort(s)
    assert [k for _, _, k in c] == list(range(900, 0, -1)) and [t for _, t, _ in c] == list(np.cumsum(y[order][::-1])[::-1])


def average_precision(rows):
    """Step-wise, over distinct scores."""
    out = tp = k = 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        own = [y for t, y in rows if t == s]
        tp, k = tp + sum(own), k + len(own)
        out += sum(own) * tp / k
    return out / tp


@pytest.mark.parametrize("rows", [30, 10**6])
def test_prior_matched_by_plain_draws(spark, monkeypatch, rows):
    """Three cells, with ties over the borders of ranges, against a loop over draws."""
    monkeypatch.setattr(metrics.score_ranges, "__defaults__", ("_range", "score", rows))
    draw = random.Random(6)
    data = [(c, "k", f"p{i}", int(draw.random() < q), draw.randint(0, 40) / 40) for c, q in (("a", 0.3), ("b", 0.6), ("c", 0.1)) for i in range(150)]
    pred = spark.createDataFrame(data, "country string, class string, patch_id string, true_label int, score double").repartition(4)
    target = spark.createDataFrame([("k", 0.4)], "class string, prevalence double")
    got = {r.country: r for r in sampling.prior_matched(pred, target, ["country", "class"], ["class"], 7, 3).collect()}
    plan = {r.country: r for r in sampling.thinning_plan(pred, target, ["country", "class"], ["class"]).collect()}
    ranked = sampling.hash_rank(pred, ["country", "class", "true_label"], 3, ["country", "class", "patch_id"]).collect()
    assert set(got) == {"a", "b", "c"}
    for c, r in got.items():
        aps = []
        for _, factor, shift in sampling.thinning(7, 3):
            kept = [(x.score, x.true_label) for x in ranked if x.country == c and ((x["_rank"] - 1) * factor + shift) % x["_n"] < (plan[c].take_pos if x.true_label else plan[c].take_neg)]
            assert len(kept) == r.n_kept
            aps.append(average_precision(kept))
        assert abs(r.mean_ap - sum(aps) / 7) < 1e-12
        assert abs(r.raw_ap - average_precision([(s, y) for k, _, _, y, s in data if k == c])) < 1e-12


def shuffled(spark, run):
    from patchwright.operators import accounting

    with accounting.measured(spark) as cost:
        run()
    return cost.used.bytes_shuffled


def test_shuffle_does_not_grow_with_draws(spark):
    pred = spark.range(40_000).select(F.lit("a").alias("country"), F.lit("k").alias("class"), F.col("id").cast("string").alias("patch_id"), (F.rand(1) < 0.3).cast("int").alias("true_label"), F.rand(2).alias("score"))
    target = spark.createDataFrame([("k", 0.5)], "class string, prevalence double")
    few, many = (shuffled(spark, lambda d=d: sampling.prior_matched(pred, target, ["country", "class"], ["class"], d, 3).collect()) for d in (2, 60))
    assert many < 1.05 * few
