"""The resume of an interrupted run."""

from patchwright.sources import tables


def test_resume_keeps_nothing_in_memory(spark, tmp_path, monkeypatch):
    """What is appended is not cached, and the keys that are there are not made distinct."""
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "persist", lambda *a: (_ for _ in ()).throw(AssertionError("cached")))
    monkeypatch.setattr(DataFrame, "distinct", lambda *a: (_ for _ in ()).throw(AssertionError("distinct")))
    path, df = f"{tmp_path}/out", spark.range(10).withColumnRenamed("id", "k")
    assert tables.append_missing(df.where("k % 3 > 0"), path, ["k"]) == 6
    assert tables.append_missing(df, path, ["k"]) == 4
    assert tables.append_missing(df, path, ["k"]) == 0
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == list(range(10))
