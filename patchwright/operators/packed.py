"""Average precision and AUROC of very many model scores: rounded scores and labels as sorted whole numbers, packed by task.

A probability of at most nine digits and its label are one 32-bit number. Where rows are scored, numbers are gathered by key,
and what repeats is counted, so a score of a class is some bytes, not a row. The numbers of a key are cut at balanced borders,
found from every SAMPLE-th number of each piece (16 at least); a task ranks one range of one key, to which the totals of the ranges above
are added. Equal scores share a range. No score is left out, and values are those of `metrics.ranking` over the rounded scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import RANGE_ROWS

PIECES = "key int, v binary, n binary"
#: Scores that a task gathers before it hands pieces on.
GATHERED = 4_000_000
SAMPLE = 256


def numbers(p: np.ndarray, y: np.ndarray, digits: int) -> np.ndarray:
    """2 x the probability as a whole number of its last digit, and 1 more with the label."""
    return (np.floor(p * 10.0**digits + 0.5).astype(np.int64) * 2 + (y == 1)).astype(np.int32)


def piece(key: int, v: np.ndarray) -> tuple[int, bytes, bytes]:
    v, n = np.unique(v, return_counts=True)
    return key, v.tobytes(), n.astype(np.int32).tobytes()


def batch_of(pieces: Sequence[tuple]) -> pa.RecordBatch:
    keys, v, n = zip(*pieces, strict=True) if pieces else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(v, pa.binary()), pa.array(n, pa.binary())], names=["key", "v", "n"])


def gather(found: Iterator[tuple[int, np.ndarray]], limit: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """Pieces of (key, numbers) as they come, by key."""
    held: dict[int, list[np.ndarray]] = {}
    size = 0
    for key, v in found:
        held.setdefault(key, []).append(v)
        size += len(v)
        if size >= limit:
            yield batch_of([piece(k, np.concatenate(held[k])) for k in sorted(held)])
            held, size = {}, 0
    if held:
        yield batch_of([piece(k, np.concatenate(held[k])) for k in sorted(held)])


def unpacked(t) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for k, v, n in zip(*(t.column(c).to_pylist() for c in ("key", "v", "n")), strict=True):
        yield k, np.frombuffer(v, np.int32), np.frombuffer(n, np.int32)


def borders(pieces: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """key -> the least numbers of its ranges but the lowest, so many that a range has about `rows` scores."""
    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, v, n in unpacked(batch):
                ends = np.cumsum(n, dtype=np.int64)
                m = min(int(ends[-1]), max(16, -(-int(ends[-1]) // SAMPLE)))  # small pieces too have more than their middle
                at = np.searchsorted(ends, (np.arange(m) + 0.5) * ends[-1] / m)
                out.append((k, v[at].tobytes(), np.full(m, ends[-1] / m).tobytes()))
            yield batch_of(out)

    def cut(g: pd.DataFrame) -> pd.DataFrame:
        v = np.concatenate([np.frombuffer(b, np.int32) for b in g["v"]])
        w = np.concatenate([np.frombuffer(b, np.float64) for b in g["n"]])
        order = np.argsort(v, kind="stable")
        ends = np.cumsum(w[order])
        parts = max(1, int(np.ceil(ends[-1] / rows - 1e-9)))
        at = np.searchsorted(ends, np.arange(1, parts) * ends[-1] / parts)
        found = np.unique(v[order][at] & ~np.int32(1))  # both labels of a score in one range
        return pd.DataFrame({"key": g["key"][:1].to_numpy(), "v": [found.tobytes()], "n": [b""]})

    out = pieces.mapInArrow(samples, PIECES).groupBy("key").applyInPandas(lambda g: cut(g), PIECES)
    return {r.key: np.frombuffer(r.v, np.int32) for r in out.collect()}  # a number a range


def ranking(pieces: DataFrame, keys: Sequence[tuple], names: Sequence[str], rows: int = RANGE_ROWS) -> DataFrame:
    """(names..., n, n_pos, ap, auroc) of written pieces, whose key k stands for the values keys[k]."""
    cuts = borders(pieces, rows)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, v, n in unpacked(batch):
                ends = [0, *np.searchsorted(v, cuts[k], "left").tolist(), len(v)]
                for r, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                    if b > a:
                        out.append((k, r, v[a:b].tobytes(), n[a:b].tobytes(), int(n[a:b].sum(dtype=np.int64)), int(n[a:b][v[a:b] & 1 == 1].sum(dtype=np.int64))))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "range", "v", "n", "rows", "pos"])

    ranged = pieces.mapInArrow(ranges, "key int, range int, v binary, n binary, rows bigint, pos bigint")
    above: dict[tuple[int, int], tuple[int, int]] = {}
    if any(len(c) for c in cuts.values()):
        own = {(r.key, r.range): (r.rows, r.pos) for r in ranged.groupBy("key", "range").agg(F.sum("rows").alias("rows"), F.sum("pos").alias("pos")).collect()}  # a row a range
        for k, c in cuts.items():
            n = pos = 0
            for r in range(len(c), -1, -1):
                above[k, r] = (n, pos)
                n, pos = n + own.get((k, r), (0, 0))[0], pos + own.get((k, r), (0, 0))[1]

    def rank(t: pa.Table) -> pa.Table:
        k, r = t.column("key")[0].as_py(), t.column("range")[0].as_py()
        v = np.concatenate([np.frombuffer(b, np.int32) for b in t.column("v").to_pylist()])
        n = np.concatenate([np.frombuffer(b, np.int32) for b in t.column("n").to_pylist()])
        order = np.argsort(v)[::-1]  # from the highest
        v, n = v[order], n[order].astype(np.int64)
        starts = np.flatnonzero(np.diff(v >> 1, prepend=-1))
        pos = np.add.reduceat(np.where(v & 1 == 1, n, 0), starts)
        n = np.add.reduceat(n, starts)
        before_n, before_pos = above.get((k, r), (0, 0))
        tp = before_pos + np.cumsum(pos)
        gain = (pos * (tp / (before_n + np.cumsum(n)))).sum()
        below = ((n - pos) * (tp - pos / 2)).sum()
        return pa.table({"key": pa.array([k], pa.int32()), "n": [int(n.sum())], "pos": [int(pos.sum())], "gain": [float(gain)], "below": [float(below)]})

    parts = ranged.groupBy("key", "range").applyInArrow(lambda t: rank(t), "key int, n bigint, pos bigint, gain double, below double")
    each = parts.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", "pos", "gain", "below")))
    p, q = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")
    named = [F.get(F.array(*(F.lit(k[i]) for k in keys)), F.col("key")).alias(name) for i, name in enumerate(names)]
    return each.select(*named, "n", F.col("pos").alias("n_pos"), (F.col("gain") / F.nullif(p, F.lit(0.0))).alias("ap"), (F.col("below") / F.nullif(p * q, F.lit(0.0))).alias("auroc"))
