"""Training rows of the stand-in: patches without a known label, words of label bits, and no split that a query does not use."""

import os
import shutil

import duckdb
import pytest
from oracle import compare

from patchwright.operators import splits
from patchwright.plans import ORACLES, QUERIES, evaluation, standin


@pytest.fixture(scope="module")
def odd(spark, small, tmp_path_factory):
    """The small tables, with part keys that `part` has not for all pixels of some patches, and for one pixel of others."""
    root = str(tmp_path_factory.mktemp("odd"))
    for f in os.listdir(small):
        if f != "lineitem.parquet":
            shutil.copy(f"{small}/{f}", root)
    unknown = "l_orderkey % 7 = 0 OR (l_orderkey % 7 = 1 AND l_linenumber = 1)"
    duckdb.connect().execute(f"COPY (SELECT * REPLACE (CASE WHEN {unknown} THEN -1 ELSE l_partkey END AS l_partkey) FROM '{small}/lineitem.parquet') TO '{root}/lineitem.parquet' (FORMAT parquet)")
    return root


def test_patches_without_a_known_label_train_too(spark, odd):
    compare(spark, odd, QUERIES["cross_fit_counts"], ORACLES["cross_fit_counts"])


def test_the_official_split_needs_no_ranks(spark, small, monkeypatch):
    monkeypatch.setattr(splits, "exact_random", lambda *a, **k: pytest.fail("ranks of all patches"))
    assert QUERIES["cross_fit_counts"](spark, small).count() > 0
    assert evaluation._vectors(spark, small)[0].count() > 0


def test_label_bits_of_more_than_a_word(spark, small):
    names = [r[0] for r in standin.table(spark, small, "part").select("p_type").distinct().collect()]
    classes = [*(f"none {i}" for i in range(standin.WORD - 1)), *names]  # one in the first word, the rest behind it
    hot = standin.label_bits(spark, small, classes).select("patch_id", *(standin.has_bit(i).alias(f"c{i}") for i in range(len(classes))))
    got = {(r.patch_id, c) for r in hot.collect() for i, c in enumerate(classes) if r[f"c{i}"]}
    assert got == {(r.patch_id, r["class"]) for r in standin.labels(spark, small).collect()}
