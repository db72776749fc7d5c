"""Codes against exhaustive search and plain k-means in Python integers."""

import hashlib
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchwright.llm import vector_codes as codes


def plain(rows, parts=codes.PARTS, entries=codes.ENTRIES, rounds=codes.ROUNDS):
    """(vec_id, label) -> code, error of the kept rows in order, and the digest."""
    rows = sorted(((i is None, i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0], r[1] or 0, r[2]))
    size = len(rows[0][2])
    cuts = [k * size // parts for k in range(parts + 1)]
    whole = [(i, [floor(256 * x) if abs(x) < 2**900 else int(x) * 256 for x in v], lab) for _, i, v, lab in rows if len(v) == size]
    cut = [[v[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] for _, v, _ in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(near(c[p], books[p])[1], []).append(c[p])
            for k, members in own.items():
                books[p][k] = [sum(xs) // len(members) for xs in zip(*members, strict=True)]
    out = []
    for (i, _, lab), c in zip(whole, cut, strict=True):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, lab, [k for _, k in found], min(sum(d for d, _ in found), 2**63 - 1)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("spread", [2, 30, 2**20, 2**40])
@pytest.mark.parametrize("width", [1, 2, 4, 7])
def test_nearest_is_exact_with_ties(spread, width):
    draw = np.random.default_rng(width)
    for n in (1, 5, 64, 200):
        book = draw.integers(-spread, spread, (n, width))
        points = np.concatenate([draw.integers(-spread, spread, (500, width)), book])
        kind = codes.small(book, points)
        assert kind is (np.int64 if width * 16 * spread**2 < 2**64 and spread < 2**40 else object)
        index, best = codes.nearest(points.astype(kind), book.astype(kind), codes.ball(book, np.arange(n)))
        own = ((points.astype(object)[:, None, :] - book.astype(object)[None]) ** 2).sum(axis=2)
        want = [min((d, k) for k, d in enumerate(row)) for row in own.tolist()]
        assert list(zip(best.tolist(), index.tolist(), strict=True)) == want


def test_integers_are_floors_of_any_size():
    values = np.array([[0.1, -0.1, 1.5, -1.001], [3.0e38, -3.0e38, 1e300, -0.0]])
    assert codes.integers(values, 8).tolist() == [[floor(256 * x) for x in row] for row in values.tolist()]


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    draw = np.random.default_rng(5)
    rows = [(k // 2, draw.normal(0, 1, 18).tolist(), k % 3 if k % 4 else None) for k in range(90)]
    rows += [rows[0], rows[0], (None, rows[3][1], 1), (200, None, 1), (201, [1.0] * 17 + [None], 1), (202, [inf] * 18, 2), (203, [nan] * 18, 2), (204, [1.0] * 5, 2), (205, [], 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumns({"a.b": F.lit(1), "codes": F.lit(2), "id": F.lit("x")})
    out, books = codes.compressed(df.repartition(5))
    want, digest = plain(rows)
    assert order(tuple(r) for r in out.collect()) == order(want)
    assert books.digest() == digest
    again, _ = codes.compressed(df.coalesce(1))
    assert order(tuple(r) for r in again.collect()) == order(want)


def test_large_components_and_few_rows(spark):
    rows = [(k, [x * 3.0e37, *([float(k)] * 15)], 0) for k, x in enumerate([1.0, -2.0, 0.5])] + [(3, [1.1e37, *([0.0] * 15)], None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    out, books = codes.compressed(df, entries=3)
    want, digest = plain(rows, entries=3)
    assert order(tuple(r) for r in out.collect()) == order(want)
    assert books.digest() == digest


def test_empty_table_and_restored(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label string")
    out, books = codes.compressed(df)
    assert out.count() == 0 and books is None
    rows = [(k, [k / 256.0] * 16, "a") for k in range(5)]
    out, books = codes.compressed(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label string"))
    for r in out.collect():
        assert codes.restored(list(r.codes), books) == rows[r.vec_id][1] and r.error == 0
