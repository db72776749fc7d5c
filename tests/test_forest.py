"""Forests over cells: the tree against a plain recursion, the forest against MLlib's, and the way past too many cells."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from patchwright.operators import forest, ml


def plain(bins, counts, cells, depth, out):
    """A tree that tries all features at every node."""
    total = counts[cells].sum(axis=0)
    score = lambda c: (c**2).sum() / c.sum()
    best = (1e-12 * total.sum(), None, None)
    if depth and (total > 0).sum() > 1:
        for j in range(bins.shape[1]):
            for b in np.unique(bins[cells, j])[:-1]:
                low = bins[cells, j] <= b
                a, c = counts[cells[low]].sum(axis=0), counts[cells[~low]].sum(axis=0)
                if a.sum() > 0 and c.sum() > 0 and score(a) + score(c) - score(total) > best[0] + 1e-9:
                    best = (score(a) + score(c) - score(total), j, b)
    if best[1] is None:
        out[cells] = total / total.sum()
        return
    low = bins[cells, best[1]] <= best[2]
    plain(bins, counts, cells[low], depth - 1, out)
    plain(bins, counts, cells[~low], depth - 1, out)


@pytest.mark.parametrize("entries", [1, 2_000_000])
def test_tree_against_a_plain_recursion(monkeypatch, entries):
    monkeypatch.setattr(forest, "ENTRIES", entries)
    rng = np.random.default_rng(5)
    bins = np.arange(32, dtype=np.uint8)[:, None]  # one feature, so that each node tries all
    counts = rng.poisson(3, (32, 3)).astype(float) * [1.0, 2.5, 0.7]
    counts[[4, 9]] = 0  # cells without a draw go along
    for depth in (1, 2, 5, 20):
        want = np.zeros((32, 3))
        got = forest.grow(bins, counts, depth, np.random.default_rng(1))
        plain(bins, counts, np.arange(32), depth, want)
        drawn = counts.sum(axis=1) > 0
        assert np.allclose(got[drawn], want[drawn]) and np.allclose(got.sum(axis=1), 1)


def rows(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(3000, 3)), 1)
    y = ((np.abs(x[:, 0]) < 0.7) ^ (rng.random(3000) < 0.1)).astype(int)
    data = [(str(i), "train" if i % 2 else "test", *map(float, x[i]), int(y[i])) for i in range(3000)]
    df = spark.createDataFrame(data, "patch_id string, role string, a double, b double, c double, lbl_00 int").repartition(3, "patch_id")
    return ml.feature_vectors(df, ["a", "b", "c"], ["patch_id", "role"], ["patch_id", "role", "lbl_00"])


def test_forests_need_no_passes_of_rows_and_agree_with_mllib(spark, monkeypatch):
    vectors = rows(spark)
    run = ml.Run("s2", learner="rf", num_trees=60, max_depth=5)
    read = lambda: {r.patch_id: r.probability for r in ml.binary_relevance(vectors, ["lbl_00"], run)[0].collect()}
    with monkeypatch.context() as m:
        m.setattr(forest, "scores", lambda *a, **k: None)
        passes = read()
    with monkeypatch.context() as m:
        m.setattr(RandomForestClassifier, "_fit", lambda *a: pytest.fail("a fit over rows"))
        cells = read()
        assert read() == cells
    a, b = (np.array([p[k] for k in sorted(cells)]) for p in (cells, passes))
    assert cells.keys() == passes.keys() and len(cells) == 1500
    assert np.abs(a - b).mean() < 0.03 and np.corrcoef(a, b)[0, 1] > 0.99


def test_result_does_not_depend_on_partitions_and_cells_have_a_bound(spark):
    df = spark.range(400).select(F.array((F.col("id") % 7).cast("double"), (F.col("id") % 11).cast("double")).alias("x"), F.array((F.col("id") % 7 < 3).cast("int"), (F.col("id") % 3).cast("int")).alias("y"), (F.col("id") % 4 > 0).alias("train"), "id")
    read = lambda n: sorted((r.id, *map(tuple, r.p)) for r in forest.scores(df.repartition(n), 2, 3, forest.Forest(9, 4)).collect())
    assert read(1) == read(5)
    assert all((r[1][1] > 0.5) == (r[0] % 7 < 3) for r in read(1)) and all(abs(sum(p) - 1) < 1e-12 for r in read(1) for p in r[1:])
    assert forest.scores(df, 2, 3, forest.Forest(9, 4), max_cells=76) is None and forest.scores(df, 2, 3, forest.Forest(9, 4), max_cells=77) is not None


def test_single_label_votes_are_no_passes_over_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 2))
    y = np.where(np.abs(x[:, 0]) < 0.7, "mid", np.where(x[:, 1] > 0, "up", "down"))
    df = spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1]), None if i == 5 else str(y[i])) for i in range(1200)], "patch_id bigint, a double, b double, y string")
    train, test = ml.hash_split(df, 0.75, 42)
    test = test.unionByName(spark.createDataFrame([(-1, 0.0, 0.0, "unseen")], df.schema))
    want = {r.patch_id: r.label_index for r in ml.single_label(train, ["a", "b"], "y", trees=20, depth=6).transform(test).collect()}
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda *a: pytest.fail("a fit over rows"))
    found = ml.single_label_votes(train, test, ["a", "b"], "y", trees=20, depth=6)
    assert {r.patch_id: r.label_index for r in found.collect()} == want
    assert ml.single_label_metrics(found)["accuracy"] > 0.95
