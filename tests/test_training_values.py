"""What trained models return, by value: the grid's logistic points against plain Newton steps, forests by what they must tell apart."""

import numpy as np
from test_multilabel import twin

from patchwright.operators import ml, multilabel
from patchwright.plans import QUERIES
from patchwright.plans.evaluation import _vectors


def average_precision(y, s):
    out = tp = 0
    for v in np.unique(s)[::-1]:
        own = y[s == v].sum()
        tp += own
        out += own * tp / (s >= v).sum()
    return out / y.sum() if y.sum() else None


def test_grid_values(spark, small):
    got = {r.run_id: r.ap_macro for r in QUERIES["hp_grid"](spark, small).collect()}
    vectors, labels, _ = _vectors(spark, small)
    rows = multilabel.training_table(vectors, labels, 1).collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    role = np.array([r.role for r in rows])
    train, held = role == "train", role == "validation"
    base = float(np.mean([y[held, k].mean() for k in range(len(labels))]))
    for reg in (0.001, 0.01, 0.1):
        aps = [average_precision(y[held, k], np.round(twin(x[train], y[train, k], reg)(x[held]), 6)) for k in range(len(labels))]
        assert abs(got[ml.Run("s2", reg_param=reg).run_id] - np.mean([a for a in aps if a is not None])) < 1e-3
    forests = [v for k, v in got.items() if "_rf_" in k]
    assert len(got) == 6 and len(forests) == 3 and all(v > base + 0.03 for v in forests)


def test_forest_of_planted_labels(spark):
    """Labels that are boxes in the features: a forest ranks them almost rightly, a logistic model can't; the same seed gives the same values."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 2))
    y = (np.abs(x) < 0.8).all(axis=1).astype(int)
    role = np.where(np.arange(900) % 2 == 0, "train", "test")
    rows = [(str(i), str(role[i]), *map(float, x[i]), int(y[i])) for i in range(900)]
    df = spark.createDataFrame(rows, "patch_id string, role string, f_0 double, f_1 double, lbl_00 int").repartition(3, "patch_id")
    vectors = ml.feature_vectors(df, ["f_0", "f_1"], ["patch_id", "role"], ["patch_id", "role", "lbl_00"]).persist()

    def ap(learner):
        p = ml.binary_relevance(vectors, ["lbl_00"], ml.Run("s2", learner=learner, num_trees=20, max_depth=6))[0]
        rows = p.where("role = 'test'").collect()
        return average_precision(np.array([r.true_label for r in rows]), np.array([r.probability for r in rows]))

    assert ap("rf") > 0.95 and ap("rf") == ap("rf") and ap("lr") < 0.6


def test_single_label_forest_beats_the_commonest_class(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 2))
    y = np.where(np.abs(x[:, 0]) < 0.7, "mid", np.where(x[:, 1] > 0, "up", "down"))
    df = spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1]), str(y[i])) for i in range(1200)], "patch_id bigint, a double, b double, y string")
    train, test = ml.hash_split(df, 0.75, 42)
    found = ml.single_label(train, ["a", "b"], "y", trees=20, depth=6).transform(test)
    common = test.groupBy("y").count().toPandas()["count"].max() / test.count()
    accuracy = ml.single_label_metrics(found)["accuracy"]
    assert accuracy > 0.95 > common + 0.3
    names = {r.label_index: r.y for r in found.select("label_index", "y").distinct().collect()}
    assert abs(accuracy - np.mean([names[r.prediction] == r.y for r in found.collect()])) < 1e-12


def test_runs_of_a_ladder_share_their_passes(spark, tmp_path, monkeypatch):
    """Runs that differ in regime and fold only are fitted in the same passes, as many as one run takes, with the values that each has alone."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 2)) * [1.0, 50.0]
    part = lambda: rng.choice(["train", "train", "validation", "test"], 400)
    s1, s2, fold = part(), part(), rng.choice(["a", "b", "c"], 400)
    y = (x[:, 0] + x[:, 1] / 50 + rng.normal(size=400) > 0).astype(int)
    rare = ((fold == "a") & (y == 1)).astype(int)  # no training positive where a is held out
    rows = [(i, float(x[i, 0]), float(x[i, 1]), str(s1[i]), None if i == 7 else str(s2[i]), str(fold[i]), int(y[i]), int(rare[i])) for i in range(400)]
    df = spark.createDataFrame(rows, "patch_id bigint, f_0 double, f_1 double, s1_split string, s2_split string, s4_fold string, lbl_00 int, lbl_01 int")
    args = (df, ["f_0", "f_1"], ["patch_id", "s1_split", "s2_split", "s4_fold"], ["lbl_00", "lbl_01"], ["one", "two"])
    runs = ml.ladder({"s1": [None], "s2": [None], "s4": ["a", "b", "c"]}, ml.Run("s1"))
    calls, summed = [], multilabel.summed
    monkeypatch.setattr(multilabel, "summed", lambda *a: calls.append(1) or summed(*a))
    read = lambda p: {(r.run_id, r.patch_id, r.role, r.label_name): (r.true_label, r.probability) for r in p.collect()}
    together, records = ml.run_all(*args, runs, f"{tmp_path}/all")
    passes = len(calls)
    alone, single = {}, {}
    for run in runs:
        p, record = ml.run_all(*args, [run], f"{tmp_path}/alone")
        alone |= read(p)
        single |= {r.run_id: (r.n_joined_rows, r.n_train_rows) for r in record.collect()}
    together = read(together)
    assert together.keys() == alone.keys() and not any(k[0].startswith("s4_a_") and k[3] == "two" for k in alone)
    assert all(v[0] == alone[k][0] and abs(v[1] - alone[k][1]) < 1e-6 for k, v in together.items())
    assert {r.run_id: (r.n_joined_rows, r.n_train_rows) for r in records.collect()} == single
    assert passes < 2 * (len(calls) - passes) / len(runs)
