"""Ids against the tiktoken library, and the exact round trip."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patchwright.llm import byte_bpe
from patchwright.llm.entry_points import queries


def ranks_of(name):
    lines = byte_bpe.read_ranks(public_tokenizers.path(name)).splitlines()
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


NAMES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
PLAIN = {n: tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(n), special_tokens={}) for n in NAMES}
CODEC = {n: byte_bpe.Codec(ranks_of(n), public_tokenizers.PATTERN, byte_bpe.RUNS) for n in NAMES}


@pytest.mark.parametrize("name", NAMES)
def test_random_texts(name):
    draw = random.Random(3)
    for _ in range(1000):
        letters = draw.choice(["ab", "aeiou tn", " \n\t", "thequickbrown's", "ÀéñüßΩж ", "한국語中文", "0123456789.,-", "=-_*#", " \x00\x1c\x85 　"])
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 90)))
        assert CODEC[name].encode(text) == PLAIN[name].encode_ordinary(text), text


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_any_text(text):
    assert CODEC[NAMES[0]].encode(text) == PLAIN[NAMES[0]].encode_ordinary(text)


def test_every_code_point():
    for low in range(0, 0x110000, 2048):
        text = " ".join(f"x{chr(c)}{chr(c)}1{chr(c)}" for c in range(low, low + 2048) if not 0xD800 <= c < 0xE000)
        assert CODEC[NAMES[0]].encode(text) == PLAIN[NAMES[0]].encode_ordinary(text), hex(low)


def test_long_pieces_take_linear_time():
    for text in ("a" * 50_000, "ab" * 30_000, "=" * 50_000, "é" * 20_000):
        assert CODEC[NAMES[0]].encode(text) == PLAIN[NAMES[0]].encode_ordinary(text)


def test_memos_do_not_change_ids(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT", 3)
    monkeypatch.setattr(byte_bpe, "PAIRS", 3)
    codec = byte_bpe.Codec(ranks_of(NAMES[0]), public_tokenizers.PATTERN)
    text = "The thing about neighbours, they're unneighbourly; 12345 xqzzy qqrst " * 5
    assert codec.encode(text) == PLAIN[NAMES[0]].encode_ordinary(text)


def test_query(spark, small, documents):
    got = {r.doc_id: tuple(r)[1:] for r in queries()["op13_byte_bpe"](spark, small).collect()}
    assert len(got) == len(documents)
    for i, text in documents.items():
        ids = PLAIN[NAMES[0]].encode_ordinary(text or "")
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_odd_rows(spark, odd):
    words = byte_bpe.Vocabulary(spark, public_tokenizers.path(NAMES[0]), public_tokenizers.PATTERN, byte_bpe.RUNS)
    named = odd.withColumn("ids", F.lit("x")).withColumn("a.b", F.lit(1))
    out = byte_bpe.encoded(named, words)
    assert out.columns == [*named.columns, "_ids"]
    rows = out.select("text", "_ids", words.bytes(F.col("_ids")).alias("back")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert list(r["_ids"]) == PLAIN[NAMES[0]].encode_ordinary(r.text or "")
        assert bytes(r.back) == (r.text or "").encode()
    broken = spark.createDataFrame([(bytearray(b"ab\xff c"),)], "text binary").select(words.ids(F.col("text")).alias("ids")).first()
    assert list(broken.ids) == PLAIN[NAMES[0]].encode_ordinary("ab� c")
    assert byte_bpe.encoded(named.limit(0), words).count() == 0
