"""Rankings of packed scores against the plain ones, and what is scored and fitted beside each other against each alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchwright.operators import ablation, metrics, ml, multilabel, packed
from patchwright.plans import QUERIES
from patchwright.plans import multilabel as plans
from patchwright.sources.storage import materialise

LABELS = ["a", "b", "c"]


def close(x, y):
    return x == y or (x is not None and y is not None and abs(x - y) < 1e-9)


def table(spark, n=600, folds=3):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 3)) * [1, 20, 0.1]
    z = x / [1, 20, 0.1]
    y = np.column_stack([z[:, 0] + rng.normal(size=n) > 0, z[:, 1] - z[:, 0] + rng.normal(size=n) > 0.5, rng.random(n) < 0.1]).astype(float)
    role = np.where(np.arange(n) % 4 < 2, "train", np.where(np.arange(n) % 4 == 2, "validation", "test"))
    rows = [(f"p{i}", str(role[i]), x[i].tolist(), y[i].tolist(), int(i * 7 % folds) if role[i] == "train" else -1) for i in range(n)]
    return spark.createDataFrame(rows, "patch_id string, role string, x array<double>, y array<double>, fold int").repartition(5, "patch_id")


@pytest.mark.parametrize("rows", [37, 10_000])
def test_ranking_of_pieces(spark, rows):
    """Ties within and over pieces, keys of one class, a key whose scores are all equal; in one range and in many."""
    rng = np.random.default_rng(1)
    found = []
    for key, n in ((0, 900), (1, 1), (2, 300), (3, 200)):
        p = np.full(n, 0.25) if key == 2 else np.round(rng.random(n), 2 if key == 0 else 9)
        y = np.zeros(n) if key == 3 else (rng.random(n) < p).astype(int)
        found += [(key, float(a), int(b)) for a, b in zip(p, y, strict=True)]
    df = spark.createDataFrame(found, "key int, score double, true_label int")
    of = lambda part: list(packed.gather(((k, packed.numbers(np.array([s]), np.array([t]), 9)) for k, s, t in part), 90))
    pieces = spark.createDataFrame([tuple(r.values()) for part in (found[::2], found[1::2]) for b in of(part) for r in b.to_pylist()], packed.PIECES)
    want = {r.key: (r.n, r.n_pos, r.ap, r.auroc) for r in metrics.ranking(df, ["key"]).collect()}
    got = {r.key: (r.n, r.n_pos, r.ap, r.auroc) for r in packed.ranking(pieces, [(k,) for k in range(4)], ["key"], rows).collect()}
    assert got.keys() == want.keys() and all(close(a, b) for k in want for a, b in zip(got[k], want[k], strict=True))
    cuts = packed.borders(pieces, rows)
    assert (len(cuts[0]) > 10) == (rows == 37) and len(cuts[2]) <= 1


def test_models_beside_each_other(spark, monkeypatch):
    """The values of each model alone, in as many passes as the longest takes; then their scores, long and packed."""
    data = table(spark)
    models = [[LABELS], [LABELS, LABELS], [["a"], ["b"], ["c"]], [["a"], ["c"], ["b"]]]
    calls, summed = [], multilabel.summed
    monkeypatch.setattr(multilabel, "summed", lambda *a: calls.append(1) or summed(*a))
    together = multilabel.fit_many(data, LABELS, models, 3)
    passes = len(calls)
    for model, layers in zip(together, models, strict=True):
        calls.clear()
        alone = multilabel.fit(data, LABELS, layers, 3)
        assert [la.labels for la in model.layers] == [la.labels for la in alone.layers]
        assert all(np.allclose(la.coefficients[:, -1], lb.coefficients[:, -1], atol=1e-6) for la, lb in zip(model.layers, alone.layers, strict=True))
    assert passes <= len(calls) + 6
    score, roles, names = multilabel.values(together, LABELS), ["validation", "test"], ["r", "s", "c", "d"]
    long = multilabel.beside(data, score, names, LABELS, LABELS, roles)
    one = {(r.patch_id, r.label_name): r.probability for r in multilabel.predictions(data, together[2], LABELS, LABELS, roles).collect()}
    two = {(r.patch_id, r.label_name): r.probability for r in long.where("model = 'c'").collect()}
    assert one.keys() == two.keys() and all(abs(v - two[k]) < 1e-12 for k, v in one.items())
    want = {r[:3]: r[3:] for r in metrics.ranking(long.withColumn("score", F.round("probability", 6)), ["model", "role", "label_name"]).collect()}
    pieces = multilabel.score_pieces(data, score, roles)
    got = {r[:3]: r[3:] for r in packed.ranking(pieces, [(m, r, c) for m in names for r in roles for c in LABELS], ["model", "role", "label_name"], 40).collect()}
    assert got.keys() == want.keys() and all(close(a, b) for k in want for a, b in zip(got[k], want[k], strict=True))


def test_penalties_share_their_passes(spark):
    data = table(spark)
    for model, reg in zip(multilabel.fit_penalties(data, LABELS, ["c", "a"], [0.001, 0.1]), [0.001, 0.1], strict=True):
        alone = multilabel.fit(data, LABELS, [["c", "a"]], 1, reg)
        assert np.allclose(model.layers[0].coefficients, alone.layers[0].coefficients, atol=1e-7)


def test_layered_meets_no_scores_by_a_shuffle(spark, small, monkeypatch):
    monkeypatch.setattr(multilabel, "averaged", lambda *a: pytest.fail("a row a score of each chain"))
    monkeypatch.setattr(metrics, "ranking", lambda *a, **k: pytest.fail("a row a score"))
    assert QUERIES["layered_ap"](spark, small).count() == 8


def test_ablation_hands_on_no_row_a_score(spark):
    data, groups = table(spark), {"one": [0], "two": [1, 2]}
    model = multilabel.fit(data, LABELS, [LABELS], 1)
    held = data.where("role <> 'train'")
    want = {r.group: r for r in ablation.importance(ablation.permuted(held, model, LABELS, groups, 7, 60), LABELS).collect()}
    pieces = materialise(ablation.score_pieces(held, model, LABELS, groups, 0, 7, 60), "pieces")
    cells = packed.ranking(pieces, [(g, c) for g in ("", *groups) for c in LABELS], ["group", "label"], 50)
    got = {r.group: r for r in ablation.losses(cells).collect()}
    assert got.keys() == want.keys() == {"one", "two"}
    assert all(close(got[g].ap_macro, want[g].ap_macro) and close(got[g].ap_drop, want[g].ap_drop) for g in want)


def test_donors_are_those_of_the_scores_and_need_no_model(spark, small, monkeypatch):
    data = table(spark).where("role = 'test'")
    model = multilabel.Layers((multilabel.Layer(tuple(LABELS), np.ones((3, 1, 4))),), 1)
    groups = {"one": [0], "two": [1, 2]}
    key = lambda d: sorted((r.patch_id, r.group, r.donor) for r in d.select("patch_id", "group", "donor").collect())
    assert key(ablation.donors(data, groups, 7, 40)) == key(ablation.permuted(data, model, LABELS, groups, 7, 40).where("group <> ''"))
    monkeypatch.setattr(multilabel, "newton", lambda *a: pytest.fail("a model"))
    assert plans.ablation_donors(spark, small).count() == len(plans.GROUPS)


def test_grid_shares_fits_and_trees(spark, monkeypatch):
    """Each point as it is alone: one fit for all penalties, trees that deeper and larger forests have in common grown once."""
    x = F.array((F.col("id") % 7).cast("double"), (F.col("id") % 11).cast("double"))
    data = spark.range(800).select(F.col("id").cast("string").alias("patch_id"), F.when(F.col("id") % 4 < 2, "train").otherwise("validation").alias("role"), x.alias("x"), (F.col("id") % 7 < 3).cast("int").alias("lbl_00"), (F.col("id") % 3 == 0).cast("int").alias("lbl_01"))
    rows = data.select("patch_id", "role", F.get("x", 0).alias("f_0"), F.get("x", 1).alias("f_1"), "lbl_00", "lbl_01")
    vectors = ml.feature_vectors(rows, ["f_0", "f_1"], ["patch_id", "role"], ["patch_id", "role", "lbl_00", "lbl_01"]).persist()
    base = ml.Run("s2")
    lr = [ml.Run("s2", reg_param=r) for r in (0.001, 0.1)]
    rf = [ml.Run("s2", learner="rf", num_trees=t, max_depth=d) for t, d in ((9, 3), (9, 5), (20, 3))]
    assert base.seed == rf[0].seed
    fits, fit = [], multilabel.fit_penalties
    monkeypatch.setattr(multilabel, "fit_penalties", lambda *a: fits.append(1) or fit(*a))
    read = lambda runs: {(r.run_id, r.label_name): (r.n, r.n_pos, r.ap, r.auroc) for r in ml.grid_cells(vectors, ["lbl_00", "lbl_01"], ["one", "two"], runs).collect()}
    together = read([*lr, *rf])
    assert len(fits) == 1 and len(together) == 10
    for run in (lr[1], rf[1], rf[2]):
        alone = read([run])
        assert len(alone) == 2 and all(close(a, b) for k, v in alone.items() for a, b in zip(v, together[k], strict=True))
    votes = ml.forest_votes(vectors, ["lbl_00", "lbl_01"], rf[1])
    p = ml.voted(votes.where("role = 'validation'"), ["lbl_00", "lbl_01"], ["lbl_00", "lbl_01"], ["one", "two"]).withColumn("score", F.round("probability", 6))
    for r in metrics.ranking(p, ["label_name"]).collect():
        assert close(together[rf[1].run_id, r.label_name][2], r.ap)
