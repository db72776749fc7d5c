import base64
import gzip
import io
import random
import zlib
import hashlib
import os

import pytest

from patchwright.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id bigint, url string, html string, payload string")


ROWS = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "http://a/4", "é\r\n\r\nWARC/1.1\r\n\r\n"), (5, "http://a\r\n/5", ""), (6, "u", "x" * 600_000), (2, "http://a/2", "same"), (None, "n", "alone")]


def test_round_trip(spark, tmp_path):
    path = f"{tmp_path}/w"
    warc.write(warc.records(pages(spark, ROWS)).repartition(3), path)
    assert all(f.endswith(".warc.gz") or f.startswith("_committed-") for f in os.listdir(path) if not f.endswith(".crc"))
    rows = warc.read(spark, path).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["page_id"], []).append(r)
    assert [r["record_type"] for r in by[2]] == ["response"] * 2 and by[1][0]["record_type"] == "revisit" and by[1][0]["refers_to"] == "urn:page:2"
    assert by[3][0]["record_type"] == "revisit" and by[3][0]["refers_to"] == "urn:page:5"
    assert bytes(by[4][0]["payload"]).decode() == ROWS[3][2] and len(by[6][0]["payload"]) == 600_000
    for i, _, h in ROWS:
        want = base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        assert all(r["payload_digest"] == want and r["payload_bytes"] == len((h or "").encode()) for r in by[i])


def test_a_write_counts_as_a_whole_or_not_at_all(spark, tmp_path):
    path = f"{tmp_path}/w"
    warc.write(warc.records(pages(spark, ROWS)), path)
    warc.write(warc.records(pages(spark, ROWS[:2])), path)
    assert warc.read(spark, path).count() == len(ROWS) + 2
    (last,) = [f for f in os.listdir(path) if f.startswith("_committed-") and len(open(f"{path}/{f}").read().split(",")) == min(len(open(f"{path}/{x}").read().split(",")) for x in os.listdir(path) if x.startswith("_committed-"))][:1]
    os.remove(f"{path}/{last}")  # as if the driver had gone before its commit
    assert 0 < warc.read(spark, path).count() < len(ROWS) + 2
    many = f"{tmp_path}/many"
    warc.register(spark)
    warc.records(pages(spark, ROWS)).coalesce(1).write.format(warc.FORMAT).mode("append").option("bytesPerFile", "1").save(many)
    assert sum(f.endswith(".gz") for f in os.listdir(many)) == len(ROWS) == warc.read(spark, many).count()


def test_smaller_payloads_are_all_responses(spark):
    rows = warc.records(pages(spark, ROWS), min_bytes=5).collect()
    assert {r["record_type"] for r in rows} == {"response"}


def test_predicates_and_columns_are_pushed(spark, tmp_path):
    path = f"{tmp_path}/w"
    warc.write(warc.records(pages(spark, ROWS)), path)
    df = warc.read(spark, path, ["page_id", "record_type"]).where("record_type = 'revisit' AND page_id IN (1, 3, 4)")
    assert sorted(r["page_id"] for r in df.collect()) == [1, 3]
    assert warc.read(spark, path, recordTypes="revisit").count() == 2
    assert warc.read(spark, path, partitionBytes="1").count() == len(ROWS)


def test_pushed_filters_leave_the_reader_less(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan
    from pyspark.sql.types import LongType, StructField, StructType

    reader = warc.WarcReader(StructType([StructField("page_id", LongType())]), {"path": str(tmp_path)})
    rest = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("page_id",), 3), EqualTo(("payload",), b"")]))
    assert reader.wanted == {"record_type": {"response"}} and len(rest) == 2


def test_plain_and_whole_file_gzip_and_damage(spark, tmp_path):
    one = warc.record({"record_type": "response", "page_id": 1, "payload": b"abc"})
    for name, body in (("a.warc", one * 2), ("b.warc.gz", gzip.compress(one * 3))):
        (tmp_path / name).write_bytes(body)
    assert warc.read(spark, str(tmp_path)).count() == 5
    (tmp_path / "c.warc").write_bytes(one[:-6])
    with pytest.raises(Exception, match="short payload"):
        warc.read(spark, str(tmp_path)).collect()


def test_empty(spark, tmp_path):
    path = f"{tmp_path}/w"
    warc.write(warc.records(pages(spark, ROWS).limit(0)), path)
    assert warc.read(spark, path).count() == 0


def test_the_query_counts_each_page_once(spark, tmp_path):
    rows = [(i, f"u{i}", f"h{i % 3}", "x") for i in range(9)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string").write.parquet(f"{tmp_path}/pages.parquet")
    out = warc.op1(spark, str(tmp_path)).collect()
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in out}
    assert len(out) == 9 and got == {i: ("response", None) if i >= 6 else ("revisit", 6 + i % 3) for i in range(9)}


class Counted:
    """A file that counts what is read of it."""

    def __init__(self, data):
        self.file, self.got = io.BytesIO(data), 0

    def seek(self, at):
        self.file.seek(at)

    def read(self, n=-1):
        data = self.file.read(n)
        self.got += len(data)
        return data


def test_unwanted_payloads_are_neither_read_nor_inflated():
    noise = random.Random(5)
    rows = [{"record_type": "revisit" if k % 10 == 0 else "response", "page_id": k, "payload": b"" if k % 10 == 0 else noise.randbytes(300_000)} for k in range(40)]
    data = b"".join(warc.pack(warc.record(r)) for r in rows)
    assert gzip.decompress(data) == b"".join(map(warc.record, rows))  # any reader of gzip reads it
    heads = sum(len(warc.record(r)) - len(r["payload"]) for r in rows)
    raw = Counted(data)
    ahead, at, found = warc.Seeking(raw, len(data)), 0, []
    while at < len(data):
        n = ahead.length(at)
        h, payload = ahead.member(at, n, lambda h: False)
        assert payload is None
        found.append(int(h["x-page-id"]))
        at += n
    assert found == list(range(40))
    assert heads <= ahead.inflated <= heads + 40 * warc.STEP
    assert raw.got <= 40 * warc.READ < len(data) / 4
    kept = list(warc.records_of(Counted(data), len(data), True, lambda h: h["warc-type"] == "response"))
    assert [p for _, p in kept] == [None if k % 10 == 0 else r["payload"] for k, r in enumerate(rows)]


def test_own_and_other_members_in_one_file():
    own, other = warc.record({"record_type": "response", "page_id": 1, "payload": b"x" * 5000}), warc.record({"record_type": "response", "page_id": 2, "payload": b"y" * 70})
    data = warc.pack(own) + gzip.compress(other) + warc.pack(own)
    assert [p for _, p in warc.records_of(io.BytesIO(data), len(data), True, lambda h: True)] == [b"x" * 5000, b"y" * 70, b"x" * 5000]
    for cut in (len(data) - 30, 40):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records_of(io.BytesIO(data[:cut]), cut, True, lambda h: True))
