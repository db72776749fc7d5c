"""Groups with an end, over several batches and restarts of the stream."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from patchwright.streaming import complete_groups as groups

START = datetime(2024, 1, 1)


def at(hours):
    return START + timedelta(hours=hours)


@pytest.fixture
def stream(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", groups.ROCKSDB)
    schema = "k string, kind string, v bigint, t timestamp"

    def run(rows):
        """Another run of the stream, after these rows have come as one file."""
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withWatermark("t", "0 seconds")
        out = groups.groups_with_expiry(events, "k", "kind", "v", "t", ["x", "y"], 10 * 3_600_000)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        found = spark.read.parquet(f"{tmp_path}/out").collect()
        return sorted((r.k, r.complete, tuple(zip(r.kinds, r["last"], strict=True)), tuple(r.missing)) for r in found)

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_complete_expired_and_anew(stream):
    # a: complete over two runs, with the last x by time; b: never complete; c: an event of another kind only
    assert stream([("a", "x", 2, at(1)), ("a", "x", 1, at(0)), ("b", "y", 5, at(2)), ("c", "z", 6, at(3))]) == []
    one = ("a", True, (("x", 2), ("y", 9)), ())
    assert stream([("a", "y", 9, at(4))]) == [one]
    # repeated events of a complete group do not emit it again
    assert stream([("a", "x", 3, at(5)), ("a", "y", 3, at(5))]) == [one]
    # the watermark passes all: b and c come out incomplete, a's state goes
    two = [one, ("b", False, (("y", 5),), ("x",)), ("c", False, (), ("x", "y"))]
    assert stream([("d", "x", 1, at(40))]) == two
    # later events of a and b begin anew; d expires
    assert stream([("a", "x", 7, at(41)), ("b", "x", 8, at(41)), ("b", "y", 8, at(42)), ("b", "y", 10, at(42))]) == sorted([*two, ("b", True, (("x", 8), ("y", 10)), ())])
    got = stream([("e", "x", 1, at(80)), ("e", "y", 1, at(80))])
    assert got == sorted([*two, ("b", True, (("x", 8), ("y", 10)), ()), ("a", False, (("x", 7),), ("y",)), ("d", False, (("x", 1),), ("y",)), ("e", True, (("x", 1), ("y", 1)), ())])


def test_bucket_of_many_keys(spark, tmp_path):
    """What comes out does not depend on the number of buckets, and Python is called by bucket, not by key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", groups.ROCKSDB)
    rows = [(f"k{i}", "xyz"[(i * 7 + j) % 3], i * 10 + j, at(i % 50 + j)) for i in range(300) for j in range(1 + i % 3)] + [("k1", "x", 5, None)]
    spark.createDataFrame(rows, "k string, kind string, v bigint, t timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    found, calls = [], []
    for buckets in (2, 5000):
        events = spark.readStream.schema("k string, kind string, v bigint, t timestamp").parquet(f"{tmp_path}/in").withWatermark("t", "0 seconds")
        out = groups.groups_with_expiry(events, "k", "kind", "v", "t", ["x", "y"], 10 * 3_600_000, buckets)
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out{buckets}").option("checkpointLocation", f"{tmp_path}/state{buckets}").trigger(availableNow=True).start()
        query.awaitTermination()
        calls.append(max(int(s["customMetrics"].get("numRegisteredTimers", 0)) for p in query.recentProgress for s in p["stateOperators"]))
        found.append(sorted(map(str, spark.read.parquet(f"{tmp_path}/out{buckets}").collect())))
    first = {i: min(at(i % 50 + j) for j in range(1 + i % 3)) for i in range(300)}
    have = {i: {"xyz"[(i * 7 + j) % 3] for j in range(1 + i % 3)} for i in range(300)}
    last = max(at(i % 50 + j) for i in range(300) for j in range(1 + i % 3))
    assert found[0] == found[1]
    assert len(found[0]) == sum({"x", "y"} <= have[i] or first[i] + timedelta(hours=10) <= last for i in range(300))
    assert 0 < calls[0] <= 4 < calls[1]


def test_no_events(stream, spark):
    assert stream([]) == []
    assert spark.range(1).select(F.lit(1)).count() == 1
