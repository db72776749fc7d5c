import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from patchwright.llm import packing
from patchwright.llm.common import table


def check(rows, capacities):
    """Bins are within a permitted capacity, the smallest that holds them, without overlap or gap."""
    bins = defaultdict(list)
    for b, o, n, c in rows:
        bins[b].append((o, n, c))
    for parts in bins.values():
        parts.sort()
        at = 0
        for o, n, _ in parts:
            assert o == at
            at += n
        assert {c for _, _, c in parts} == {min(c for c in capacities if c >= at)}
    return bins


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_pack(lengths):
    lengths = sorted(lengths, reverse=True)
    put = packing.pack(lengths, [16, 32, 64])
    bins = check([(b, o, n, c) for (b, o, c), n in zip(put, lengths, strict=True)], [16, 32, 64])
    assert len(bins) <= max(1, 2 * sum(lengths) // 16 + 1) and len(put) == len(lengths)


def test_cost_prefers_a_size_that_the_rest_fills():
    assert {c for _, _, c in packing.pack([16, 16], [16, 32])} == {32}
    assert [c for _, _, c in packing.pack([17, 15], [16, 32])] == [32, 32]
    assert [c for _, _, c in packing.pack([10], [16, 32])] == [16]
    assert [c for _, _, c in packing.pack([15, 15, 15], [16, 40])] == [16, 16, 16]


def plain(lengths, capacities, attention=None, sizes_to_open=None):
    """The same rules, step by step, with lists only; sizes_to_open: those that may be opened."""
    rest, bins, out = list(lengths), [], []
    least = lambda n: min(c for c in capacities if c >= n)
    cost_of = lambda c: c * (1 + c / attention) if attention else c
    for n in lengths:
        rest.remove(n)
        open_bins = [(left, b) for b, (_, left) in enumerate(bins) if left >= n]
        if open_bins:
            b = min(open_bins)[1]
        else:
            best = None
            for c in sizes_to_open or capacities:
                if c >= n:
                    held = n
                    for m in rest:
                        held += m if held + m <= c else 0
                    cost = (cost_of(least(held)) / held, -c)
                    best = min(best or (cost, c), (cost, c))
            b = len(bins)
            bins.append([0, best[1]])
        out.append((b, bins[b][0]))
        bins[b][0] += n
        bins[b][1] -= n
    return [(b, o, least(bins[b][0])) for b, o in out]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=40), st.sampled_from([None, 40.0]))
def test_pack_by_brute_force(lengths, attention):
    lengths = sorted(lengths, reverse=True)
    assert packing.pack(lengths, [16, 32, 64], attention) == plain(lengths, [16, 32, 64], attention)


def distributions():
    rng = np.random.default_rng(0)
    for x in (rng.integers(100, 900, 1500), np.concatenate([rng.integers(1400, 1700, 400), rng.integers(300, 600, 800)]), rng.integers(600, 1000, 1500)):
        yield sorted(np.clip(x, 1, 4095).astype(int).tolist(), reverse=True)


def test_sizes_compete():
    """Less padding than bins that all open at the largest size; with attention, a lower price too."""
    for lengths in distributions():
        def total(put, attention=None):
            return sum(packing.price(c, attention) for c in {b: c for b, _, c in put}.values())

        fixed = plain(lengths, packing.CAPACITIES, sizes_to_open=packing.CAPACITIES[-1:])
        assert total(packing.pack(lengths, packing.CAPACITIES)) < total(fixed)
        assert total(packing.pack(lengths, packing.CAPACITIES, 24576), 24576) < 0.97 * total(fixed, 24576)


def test_equal_rows_go_apart(spark):
    rows = spark.createDataFrame([(None, "a b c d")] * 3000, "doc_id bigint, text string").repartition(3)
    shards = Counter(r["bin"].split("-")[0] for r in packing.packed(rows, (16, 32), 1000).collect())
    assert len(shards) == 12 and max(shards.values()) < 400


def test_edge_cases(spark, odd):
    rows = packing.packed(odd, (64, 256), 1000).collect()
    check([(r["bin"], r["offset"], r["length"], r["capacity"]) for r in rows if r["bin"]], [64, 256])
    got = defaultdict(int)
    for r in rows:
        got[r["doc_id"]] += r["length"]
    count = lambda t: len(re.findall(r"[^\W_]{1,4}|[^\w\s]|_", t or ""))
    want = defaultdict(int)
    for r in odd.collect():
        want[r["doc_id"]] += count(r["text"])
    assert got == want
    text = defaultdict(list)
    for r in rows:
        text[r["doc_id"]].append((r["piece"], r["text"]))
    for r in odd.collect():
        if r["doc_id"] not in (None, 1):  # those come more than once
            assert "".join(t for _, t in sorted(text[r["doc_id"]])) == r["text"] if r["text"] is not None else text[r["doc_id"]] == [(0, None)]
    assert packing.packed(odd.limit(0)).count() == 0


def test_real_rows_are_whole(spark, small, documents):
    rows = packing.packed(table(spark, small, "documents")).collect()
    parts = defaultdict(list)
    for r in rows:
        parts[r["doc_id"]].append((r["start"], r["length"]))
    assert set(parts) == set(documents)
    for p in parts.values():
        p.sort()
        assert [s for s, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))]
    bins = check([(r["bin"], r["offset"], r["length"], r["capacity"]) for r in rows if r["bin"]], packing.CAPACITIES)
    room = sum(p[0][2] for p in bins.values())
    assert sum(r["length"] for r in rows) / room > 0.97
    loose = sorted((-r["length"], r["doc_id"], r["piece"], r["bin"], r["offset"], r["capacity"]) for r in rows if 0 < r["length"] < 4096)
    want = plain([-x[0] for x in loose], packing.CAPACITIES)
    assert [x[3:] for x in loose] == [(f"0-{b}", o, c) for b, o, c in want]
    text = defaultdict(str)
    for r in sorted(rows, key=lambda r: r["piece"]):
        text[r["doc_id"]] += r["text"] or ""
    assert text == documents


def test_places_do_not_depend_on_partitions(spark, odd):
    """The same rows in 1 and in 7 partitions get the same bins; equal rows are told apart by number only."""
    rows = odd.select("doc_id", "text").unionByName(odd.selectExpr("doc_id + 1 AS doc_id", "concat(text, ' more') AS text"))
    one, seven = (sorted(map(tuple, packing.packed(d, (64, 256), 1000).collect()), key=repr) for d in (rows.coalesce(1), rows.repartition(7)))
    assert one == seven
