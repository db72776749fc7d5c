"""Layers of logistic models against MLlib and a plain NumPy twin; the chain's order by hand."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from patchwright.functions.labels import class_weight
from patchwright.operators import ml, multilabel

LABELS = ["lbl_00", "lbl_01", "lbl_02"]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3)) * [1, 3, 0.5] + [0, 2, 1]
    a = (x @ [1.0, -0.4, 0.8] + rng.normal(size=600) > 0.3).astype(int)
    b = (a + x[:, 0] + rng.normal(size=600) > 1.2).astype(int)
    c = (2 * b - a + rng.normal(size=600) > 0.5).astype(int)
    role = np.where(np.arange(600) % 4 < 2, "train", np.where(np.arange(600) % 4 == 2, "validation", "test"))
    rows = [(str(i), str(role[i]), *map(float, x[i]), int(a[i]), int(b[i]), int(c[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "patch_id string, role string, f_0 double, f_1 double, f_2 double, lbl_00 int, lbl_01 int, lbl_02 int")
    out = ml.feature_vectors(df.repartition(7, "patch_id"), ["f_0", "f_1", "f_2"], ["patch_id", "role"], ["patch_id", "role", *LABELS]).persist()
    assert out.count() == 600
    return out


def twin(x, y, reg):
    """Plain Newton steps of one weighted, penalised logistic model."""
    n, pos = len(y), y.sum()
    w = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    mean = (w[:, None] * x).sum(axis=0) / w.sum()
    variance = (w[:, None] * (x - mean) ** 2).sum(axis=0) / (w.sum() - (w**2).sum() / w.sum())
    a, b, ridge = np.column_stack([x, np.ones(n)]), np.zeros(x.shape[1] + 1), np.append(reg * variance, 0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ b))
        b = b + np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a / w.sum() + np.diag(ridge), a.T @ (w * (y - p)) / w.sum() - ridge * b)
    return lambda z: 1 / (1 + np.exp(-np.column_stack([z, np.ones(len(z))]) @ b))


def plain(rows, layers, folds, reg=0.01):
    """patch -> label -> probability, by the twin; training rows of layers before the last by models without their fold."""
    x = np.array([r.x for r in rows])
    y, fold = np.array([r.y for r in rows]), np.array([r.fold for r in rows])
    out = {}
    for k, labels in enumerate(layers):
        new = []
        for c in labels:
            t = y[:, LABELS.index(c)]
            p = twin(x[fold >= 0], t[fold >= 0], reg)(x)
            out[c] = p.copy()
            if k + 1 < len(layers):
                for f in range(folds):
                    p[fold == f] = twin(x[(fold >= 0) & (fold != f)], t[(fold >= 0) & (fold != f)], reg)(x[fold == f])
            new.append(p)
        x = np.column_stack([x, *new])
    return out


@pytest.mark.parametrize("layers", [[LABELS], [LABELS, LABELS], [["lbl_00"], ["lbl_01"], ["lbl_02"]]])
def test_layers_against_a_twin(spark, vectors, layers):
    data = multilabel.training_table(vectors, LABELS, 3)
    model = multilabel.fit(data, LABELS, layers, folds=3)
    rows = data.collect()
    want = plain(rows, layers, 3)
    got = {(r.patch_id, r.label_name): r.probability for r in multilabel.predictions(data, model, LABELS, LABELS, ["test", "validation"]).collect()}
    assert len(got) == 300 * 3
    for k, r in enumerate(rows):
        if r.fold < 0:
            for c in LABELS:
                assert abs(got[r.patch_id, c] - want[c][k]) < 1e-7


def test_within_a_ten_thousandth_of_mllib_on_every_label(spark, vectors):
    data = multilabel.training_table(vectors, LABELS, 1)
    model = multilabel.fit(data, LABELS, [LABELS])
    got = {(r.patch_id, r.label_name): r.probability for r in multilabel.predictions(data, model, LABELS, LABELS, ["test"]).collect()}
    counts = ml.class_counts(vectors, LABELS)
    for c in LABELS:
        weighted = vectors.withColumn("weight", class_weight(F.col(c), F.lit(counts[c][0]), F.lit(counts[c][1])))
        lr = LogisticRegression(labelCol=c, weightCol="weight", maxIter=500, tol=1e-12, regParam=0.01).fit(weighted.where("role = 'train'"))
        for r in lr.transform(vectors.where("role = 'test'")).select("patch_id", vector_to_array("probability")[1].alias("p")).collect():
            assert abs(got[r.patch_id, c] - r.p) < 1e-4


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return n


def test_jobs_do_not_depend_on_labels(spark, vectors):
    data = multilabel.training_table(vectors, LABELS * 3, 1)
    names = [f"{c}{k}" for k in range(3) for c in LABELS]
    one = jobs(spark, "few", lambda: multilabel.fit(data, names, [names[:3]], passes=5, tolerance=-1.0))
    all_ = jobs(spark, "many", lambda: multilabel.fit(data, names, [names], passes=5, tolerance=-1.0))
    assert one == all_


def test_no_training_row_is_scored_by_a_model_that_saw_it(spark, vectors):
    """Changed labels of one fold change no out-of-fold output of that fold, but others."""
    data = multilabel.training_table(vectors, LABELS, 3).persist()
    turned = data.withColumn("y", F.when(F.col("fold") == 1, F.transform("y", lambda v: 1.0 - v)).otherwise(F.col("y")))
    one, two = (multilabel.fit(d, LABELS, [LABELS, LABELS], folds=3) for d in (data, turned))
    first = lambda m: multilabel.Layers(m.layers[:1], 3)
    p, q = ({r.patch_id: (r.fold, r.p) for r in multilabel.probabilities(data, first(m), LABELS, out_of_fold=True).collect()} for m in (one, two))
    for k, (fold, v) in p.items():
        same = np.allclose(v, q[k][1], atol=1e-9)
        assert same == (fold == 1)


def test_order_and_odd_labels(spark, vectors):
    edges = spark.createDataFrame([("a", "b", 0.1), ("a", "c", 0.5), ("b", "c", -0.2), ("b", "d", 0.5)], "a string, b string, npmi double")
    # sums: a 0.6, b 0.4, c 0.3, d 0.5
    assert multilabel.chain_order(edges, ["e", "d", "c", "b", "a"]) == [("a", None), ("c", 0.5), ("b", 0.1), ("d", 0.5), ("e", None)]
    assert multilabel.frequency_order({"x": (5, 2), "a": (5, 2), "z": (5, 4)}) == ["z", "a", "x"]
    # a label without a negative among the training rows, and one that is null everywhere but once
    odd = vectors.withColumn("lbl_01", F.lit(1)).withColumn("lbl_02", F.when(F.col("patch_id") == "0", 1))
    data = multilabel.training_table(odd, LABELS, 2)
    model = multilabel.fit(data, LABELS, [["lbl_01", "lbl_02"]], folds=2)
    out = multilabel.predictions(data, model, LABELS, LABELS, ["test"])
    assert {r[0] for r in out.select("label_name").distinct().collect()} == {"lbl_01", "lbl_02"}
    assert out.where("label_name = 'lbl_01' AND probability < 0.99").count() == 0 and out.where("probability IS NULL OR isnan(probability)").count() == 0
    with pytest.raises(ValueError):
        multilabel.fit(data.limit(0), LABELS, [LABELS])
    mean = multilabel.averaged([out, out.withColumn("probability", F.col("probability") / 3)])
    assert mean.count() == out.count()
