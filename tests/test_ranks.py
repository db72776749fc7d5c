"""Average ranks from balanced ranges, and what is made of them, against pandas; both forms of the bootstrap."""

import numpy as np
import pandas as pd
import pytest

from patchwright.operators import sampling, stats


def test_ranks_with_ties_and_null_keys(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(v), float(w)) for k, v, w in zip(rng.choice(["a", "b", ""], 300), rng.integers(-9, 9, 300), rng.normal(size=300), strict=True)]
    df = spark.createDataFrame([(k or None, v, w) for k, v, w in rows], "key string, v double, w double")
    got = stats.with_rank(df, "v", "r", ["key"]).toPandas().fillna({"key": ""})
    assert len(got) == 300 and got["r"].tolist() == got.groupby("key")["v"].rank().tolist()
    whole = stats.with_rank(df, "v", "r").toPandas()
    assert whole["r"].tolist() == whole["v"].rank().tolist() and stats.with_rank(df.limit(0), "v", "r").count() == 0
    plain = pd.DataFrame(rows, columns=["key", "v", "w"])
    want = {k: g["v"].rank().corr(g["w"].rank()) for k, g in plain.groupby("key")}
    for r in stats.spearman(df, "v", "w", ["key"]).collect():
        assert r["rho"] == pytest.approx(want[r["key"] or ""])


def test_signed_ranks_of_many_ties(spark):
    d = np.random.default_rng(5).choice([-2.0, -1.0, 0.0, 1.0, 2.0, 3.0], 3000)
    r = stats.wilcoxon(spark.createDataFrame([(float(v),) for v in d], "d double"), "d").first()
    some = pd.Series(d[d != 0])
    ranks = some.abs().rank()
    assert r["n"] == len(some) and r["method"] == "normal" and 0 <= r["p_value"] < 1e-6
    assert (r["w_plus"], r["w_minus"]) == (ranks[some > 0].sum(), ranks[some < 0].sum())


def test_bootstrap_forms_agree(spark):
    """Above its bound on counts the bootstrap joins; what it returns does not change."""
    rng = np.random.default_rng(6)
    rows = [(f"t{i % 11}", f"c{i % 3}", int(rng.integers(0, 2)), float(rng.integers(0, 20))) for i in range(400)]
    pred = spark.createDataFrame(rows, "tile string, class string, true_label int, score double")
    few, many = (sampling.bootstrap_many(pred, "tile", 12, 3, max_counts=m).toPandas().sort_values("replicate") for m in (10**6, 10))
    for c in ("replicate", "ap_macro", "auroc_macro"):
        assert np.allclose(few[c].astype(float), many[c].astype(float), atol=1e-12)


def test_blocked_bootstrap(spark, monkeypatch):
    """Many clusters in blocks, draws over several tasks: the values of the joins, and no row a draw."""
    rng = np.random.default_rng(8)
    rows = [(i % 150, f"c{i % 3}", int(rng.integers(0, 2)), float(rng.integers(0, 20))) for i in range(700)]
    pred = spark.createDataFrame(rows, "patch bigint, class string, true_label int, score double")
    small = pred.groupBy("patch", "class", "score").agg({"true_label": "sum", "*": "count"}).toDF("patch", "class", "score", "a", "b")
    small = small.selectExpr("patch", "class", "score", "double(least(a, b)) pos", "double(greatest(a, b)) n")
    want = sampling.cluster_bootstrap(pred, [], "patch", 9, 3).toPandas().sort_values("replicate")
    for how in ({"block": 40, "drawn": 64}, {"max_cells": 5}):
        got = sampling.blocked_bootstrap(small, "patch", 9, 3, "class", **how).toPandas().sort_values("replicate")
        for c in ("replicate", "ap_macro", "auroc_macro"):
            assert np.allclose(got[c].astype(float), want[c].astype(float), atol=1e-12)
    monkeypatch.setattr(sampling, "cluster_bootstrap", None)  # beyond the bound on counts no row is a draw
    assert sampling.bootstrap_many(pred, "patch", 9, 3, max_counts=10).count() == 9
