"""Permutation importance against NumPy."""

import hashlib

import numpy as np

from patchwright.operators import ablation, multilabel

LABELS = ["a", "b"]


def average_precision(y, s):
    out = tp = 0
    for v in np.unique(s)[::-1]:
        own = y[s == v].sum()
        tp += own
        out += own * tp / (s >= v).sum()
    return out / y.sum()


def test_importance_by_hand(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    y = np.column_stack([x[:, 0] + 0.3 * rng.normal(size=500) > 0, x[:, 1] + 0.3 * rng.normal(size=500) > 0]).astype(float)
    rows = [(f"p{i}", "test", x[i].tolist(), y[i].tolist(), -1) for i in range(500)]
    schema = "patch_id string, role string, x array<double>, y array<double>, fold int"
    coefficients = np.array([[[3.0, 0, 0, 0.1]], [[0, 2.0, 0, -0.1]]])
    model = multilabel.Layers((multilabel.Layer(("a", "b"), coefficients),), 1)
    groups = {"first": [0], "rest": [1, 2], "unused": [2]}
    df = spark.createDataFrame(rows, schema)
    out = ablation.permuted(df.repartition(6), model, LABELS, groups, 7, 120)
    got = {r.group: (r.ap_macro, r.ap_drop) for r in ablation.importance(out, LABELS).collect()}
    h = lambda *k: hashlib.md5(":".join(map(str, k)).encode()).hexdigest()
    block = np.array([int(h(7, "block", f"p{i}")[:8], 16) % 5 for i in range(500)])

    def ap(z):
        p = 1 / (1 + np.exp(-(z @ coefficients[:, 0, :3].T + coefficients[:, 0, 3])))
        return np.mean([average_precision(y[:, k], np.round(p[:, k], 9)) for k in (0, 1)])

    base = ap(x)
    for name, columns in groups.items():
        z = x.copy()
        for b in range(5):
            own = sorted(np.flatnonzero(block == b), key=lambda i: (h(7, f"p{i}"), f"p{i}"))
            step = 1 + int(h(7, name)[:8], 16) % (len(own) - 1)
            z[np.ix_(own, columns)] = x[np.ix_(np.roll(own, -step), columns)]
        assert abs(got[name][0] - ap(z)) < 1e-9 and abs(got[name][1] - (base - ap(z))) < 1e-9
    assert got["first"][1] > 0.1 and abs(got["unused"][1]) < 1e-12
    again = ablation.permuted(df.coalesce(1), model, LABELS, groups, 7, 120)
    key = lambda d: sorted((r.patch_id, r.group, r.donor or "") for r in d.collect())
    assert key(out) == key(again)
    lone = ablation.permuted(df.limit(1), model, LABELS, groups, 7, 120).where("group <> ''").collect()
    assert len(lone) == 3 and all(r.donor == r.patch_id for r in lone)
    assert ablation.permuted(df.limit(0), model, LABELS, groups).count() == 0
