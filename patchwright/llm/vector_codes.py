"""Vector code compression: product codes by integer k-means, nearest entries found in ball trees.

Each component x becomes the integer floor(2^scale * x). A vector is cut into equal parts, and each part position has
a codebook of its own. A codebook starts as the parts of the vectors of least id; a round assigns every part to the
nearest entry (squared distance, ties to the lower index) and replaces each entry by the floor of its parts' mean.

The nearest entry is found in a ball tree over the entries of the part position: a ball is skipped only if the
distance to its centre less its radius is above the best distance so far. Centres and distances are floating point,
so radii are rounded up and bounds down; equal bounds are visited; the distances that decide are integers. A batch
goes down the tree together, each vector first into the ball whose centre is nearer.

A round is one map-side pass: a task adds up its parts per entry, and only sums travel (parts x entries rows a task).
What comes to the driver and goes out again are the codebooks, of a fixed size.

Kept are vectors that are not null and have neither null nor non-finite components. Among them, vectors whose length
differs from that of the first (least id, then least vector; null ids last) cannot be compared: they are dropped as
well. A length that the parts do not divide is cut at floor(k * length / parts). Fewer vectors than entries give as
many entries as there are. Integers of any size are exact; an error beyond 63 bits is given as 2^63 - 1. Repeated
rows and equal ids are rows like others. An empty table gives no rows. Columns beside id, vector and label are not
read; a label may have any type and be null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, materialise, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 8
LEAF = 8
MOST = 2**63 - 1
#: Conservative rounding of floating-point distances: far above their error.
LOOSE = 1e-9


@dataclass
class Ball:
    """A ball around entries: a leaf has their indexes, ascending, an inner ball its two halves."""

    centre: np.ndarray
    radius: float
    entries: np.ndarray
    halves: list[Ball] = field(default_factory=list)


def ball(book: np.ndarray, entries: np.ndarray) -> Ball:
    """The tree over book[entries]: halves along the widest axis."""
    points = book[entries].astype(float)
    centre = points.mean(axis=0)
    radius = float(np.sqrt(((points - centre) ** 2).sum(axis=1)).max()) * (1 + LOOSE) + LOOSE
    here = Ball(centre, radius, np.sort(entries))
    if len(entries) > LEAF:
        axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
        order = entries[np.argsort(points[:, axis], kind="stable")]
        here.halves = [ball(book, order[: len(order) // 2]), ball(book, order[len(order) // 2 :])]
    return here


def nearest(points: np.ndarray, book: np.ndarray, tree: Ball) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each point, in integers; ties to the lower index."""
    best = np.full(len(points), MOST, points.dtype)
    if points.dtype == object:
        best[:] = 1 << 4000
    index = np.full(len(points), len(book), np.int64)
    real = points.astype(float)

    def distance(here: Ball, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((real[rows] - here.centre) ** 2).sum(axis=1))

    def visit(here: Ball, rows: np.ndarray, away: np.ndarray) -> None:
        bound = np.maximum(away * (1 - LOOSE) - here.radius, 0.0)
        reached = rows[bound * bound * (1 - LOOSE) <= within[rows]]
        if not len(reached):
            return
        if not here.halves:
            own = ((points[reached, None, :] - book[here.entries][None]) ** 2).sum(axis=2)
            first = own.argmin(axis=1)
            d, i = own[np.arange(len(reached)), first], here.entries[first]
            better = (d < best[reached]) | ((d == best[reached]) & (i < index[reached]))
            won = reached[better]
            best[won], index[won] = d[better], i[better]
            within[won] = best[won].astype(float) * (1 + LOOSE) + LOOSE
            return
        one, two = here.halves
        d1, d2 = distance(one, reached), distance(two, reached)
        for rows_, near, far, dn, df in ((d1 <= d2, one, two, d1, d2), (d1 > d2, two, one, d2, d1)):
            visit(near, reached[rows_], dn[rows_])
            visit(far, reached[rows_], df[rows_])

    within = np.full(len(points), np.inf)
    every = np.arange(len(points))
    visit(tree, every, distance(tree, every))
    return index, best


@dataclass
class Codebooks:
    """Per part position the entries, as integer rows."""

    cuts: list[int]
    books: list[np.ndarray]

    def assigned(self, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part position, parts, nearest index, squared distance) of integer vectors."""
        for p, book in enumerate(self.books):
            part = vectors[:, self.cuts[p] : self.cuts[p + 1]]
            alike = small(book, part)
            yield p, part, *nearest(part.astype(alike), book.astype(alike), ball(book, np.arange(len(book))))

    def digest(self) -> str:
        flat = (str(int(x)) for book in self.books for x in book.ravel())
        return hashlib.sha256(",".join(flat).encode()).hexdigest()


def small(*arrays: np.ndarray) -> type:
    """int64 where squared distances fit into it, else exact Python integers."""
    width = max(arrays[0].shape[1], 1)
    most = max((abs(int(x)) for a in arrays if a.size for x in (a.min(), a.max())), default=0)
    return np.int64 if width * (2 * most) ** 2 < 2**62 else object


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(2^scale * x), exactly."""
    scaled = np.floor(np.ldexp(values.astype(float), scale))
    if not scaled.size or np.abs(scaled).max() < 2**62:
        return scaled.astype(np.int64)
    shift = 2**scale
    exact = [int(x) if np.isfinite(x) else int(v) * shift for x, v in zip(scaled.ravel(), values.astype(float).ravel(), strict=True)]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(scaled.shape)


def rows_of(column: pa.Array, scale: int) -> np.ndarray:
    """Integer vectors of an Arrow list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return integers(flat.reshape(len(column), -1), scale)


def kept(df: DataFrame, vector: str) -> DataFrame:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return df.where(F.col(vector).isNotNull() & whole)


def starting(df: DataFrame, parts: int, entries: int, scale: int) -> tuple[Codebooks, int] | None:
    """The first codebooks and the length of a vector; none for an empty table."""
    first = df.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).collect()
    if not first:
        return None
    size = len(first[0].vector)
    rows = df.where(F.size("vector") == size).select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    start = integers(np.array([r.vector for r in rows], float).reshape(len(rows), size), scale)
    cuts = [k * size // parts for k in range(parts + 1)]
    return Codebooks(cuts, [start[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)]), size


def improved(df: DataFrame, books: Codebooks, scale: int) -> Codebooks:
    """One round: every part to its nearest entry, entries to the floor of their parts' mean; unused entries stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            for p, part, index, _ in books.assigned(rows_of(batch.column(0), scale)):
                order = np.argsort(index, kind="stable")
                ends = np.flatnonzero(np.diff(index[order], append=-1))
                start = 0
                for e in ends + 1:
                    own = total.setdefault((p, int(index[order[start]])), [0, [0] * part.shape[1]])
                    own[0] += int(e - start)
                    own[1] = [a + int(b) for a, b in zip(own[1], part[order[start:e]].sum(axis=0), strict=True)]
                    start = e
        rows = [(p, i, n, [str(x) for x in s]) for (p, i), (n, s) in total.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "entry", "n", "sums"), r, strict=True)) for r in rows], schema=partial)

    def added(group: pd.DataFrame) -> pd.DataFrame:
        """The partial sums of one entry, one row a task, as exact integers."""
        whole = [str(sum(map(int, xs))) for xs in zip(*group["sums"], strict=True)]
        return pd.DataFrame({"part": group["part"][:1], "entry": group["entry"][:1], "n": [group["n"].sum()], "sums": [whole]})

    partial = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])
    schema = "part int, entry int, n bigint, sums array<string>"
    new = [book.astype(object) for book in books.books]
    for r in df.select("vector").mapInArrow(sums, schema).groupBy("part", "entry").applyInPandas(added, schema).collect():
        new[r.part][r.entry] = [int(s) // r.n for s in r.sums]
    return Codebooks(books.cuts, [b.astype(small(b)) for b in new])


def compressed(
    df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, codes array<int>, error long) of every kept vector, and the codebooks."""
    df = kept(df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label")), "vector")
    began = starting(df, parts, entries, scale)
    names = [F.col("id").alias(id_col), F.col("label").alias(label)]
    if began is None:
        return df.select(*names, F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("bigint").alias("error")), None
    books, size = began
    df = df.where(F.size("vector") == size)
    for _ in range(rounds):
        books = improved(df, books, scale)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.empty((batch.num_rows, parts), np.int32), np.zeros(batch.num_rows, object)
            for p, _, index, d in books.assigned(rows_of(batch.column(2), scale)):
                codes[:, p] = index
                errors += d.astype(object)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * parts, pa.int32()), pa.array(codes.ravel()))
            error = pa.array([min(int(e), MOST) for e in errors], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), listed, error], names=["id", "label", "codes", "error"])

    kinds = dict(df.dtypes)
    out = df.select("id", "label", "vector").mapInArrow(code, f"id {kinds['id']}, label {kinds['label']}, codes array<int>, error bigint")
    return materialise(out, "codes").select(*names, "codes", "error"), books


def restored(codes: list[int], books: Codebooks, scale: int = SCALE) -> list[float]:
    """The vector that a code stands for."""
    return [float(x) / 2**scale for p, c in enumerate(codes) for x in books.books[p][c]]


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compressed(table(spark, sf_dir, "embeddings"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("bigint")
    sums = bounded(codes.groupBy(F.col("label").alias("own")).agg(total.alias("label_error")))
    hexed = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("own")))
    return joined.select("vec_id", hexed.alias("code"), "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))
