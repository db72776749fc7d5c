"""Feature ablation by permutation: what a model loses when a group of features comes from other rows.

Rows are dealt to blocks of about BLOCK_ROWS by hash. In a block, in hash order, a row takes a group's features from
the row a fixed number of places on, so each group is permuted and all else stays; the other rows are of the same block.
A task takes some blocks at once, about GATHERED rows (or one larger block), and exchanges each group's columns in a copy.
Blocks do not depend on partitioning, and no group of rows is larger than that, whatever the rows hold.

Scores of a large table are many (rows x groups x labels): `score_pieces` hands on packed numbers, not a row a score."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import seeded, seeded_int
from . import packed
from .metrics import macro, ranking
from .multilabel import Layers, values

BLOCK_ROWS = 20_000
#: Rows of small blocks that a task holds at once.
GATHERED = 20_000
#: Scores that are compared are rounded to so many digits.
DIGITS = 9


def group_hash(seed: int, group: str) -> int:
    return int(hashlib.md5(f"{seed}:{group}".encode()).hexdigest()[:8], 16)


def shift(seed: int, group: str, rows: int) -> int:
    """How many places on a group's features come from: from 1 to rows - 1, 0 for a lone row."""
    return 1 + group_hash(seed, group) % (rows - 1) if rows > 1 else 0


def dealt(data: DataFrame, columns: Sequence[str], seed: int, block_rows: int) -> DataFrame:
    """(columns, patch_id, h, block) of the rows, grouped by some blocks."""
    blocks = max(1, -(-data.count() // block_rows))
    some = max(1, GATHERED // block_rows)
    block = seeded_int(f"{seed}:block", F.col("patch_id")) % blocks
    rows = data.select("patch_id", *columns, seeded(seed, F.col("patch_id")).alias("h"), block.alias("block"))
    return rows.groupBy(F.expr(f"block div {some}").alias("some"))


def in_order(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(the rows in order of block and hash, each one's first row of its block, each one's block's size)."""
    t = t.sort_by([("block", "ascending"), ("h", "ascending"), ("patch_id", "ascending")])
    block = t.column("block").to_numpy()
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    sizes = np.diff(np.append(starts, len(block)))
    return t, np.repeat(starts, sizes), np.repeat(sizes, sizes)


def donors_of(first: np.ndarray, size: np.ndarray, seed: int, group: str) -> np.ndarray:
    """The place of each row's donor: `shift` places on in its block."""
    step = np.where(size > 1, 1 + group_hash(seed, group) % np.maximum(size - 1, 1), 0)
    return first + (np.arange(len(first)) - first + step) % size


def wide(column) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exchanged(x: np.ndarray, at: np.ndarray, places: Sequence[int]) -> np.ndarray:
    other = x.copy()
    other[:, list(places)] = x[at][:, list(places)]
    return other


def donors(data: DataFrame, groups: Sequence[str], seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(patch_id, group, donor): the permutation alone, as `permuted` and `score_pieces` make it. It depends on ids, not on features or a model."""
    names = list(groups)

    def run(t: pa.Table) -> pa.Table:
        t, first, size = in_order(t)
        ids = t.column("patch_id").combine_chunks()
        taken = [ids.take(pa.array(donors_of(first, size, seed, g))).cast(pa.string()) for g in names]
        labels = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(names), dtype=np.int32), len(ids))), pa.array(names, pa.string())).cast(pa.string())
        return pa.table([pa.chunked_array([ids] * len(names)).cast(pa.string()), labels, pa.chunked_array(taken)], names=["patch_id", "group", "donor"])

    return dealt(data, [], seed, block_rows).applyInArrow(lambda t: run(t), "patch_id string, group string, donor string")


def permuted(data: DataFrame, model: Layers, vocabulary: Sequence[str], groups: Mapping[str, Sequence[int]], seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(patch_id, group, donor, y, p): each row scored as it is (group '', donor null) and with each group of features from its donor; p in the order of the vocabulary.

    data: rows of a `training_table` that are to be scored; groups: name -> places in x. Labels must all have a model."""
    names, score = list(groups), values([model], vocabulary)

    def run(t: pa.Table) -> pa.Table:
        t, first, size = in_order(t)
        n, x = t.num_rows, wide(t.column("x"))
        ids, y = t.column("patch_id").combine_chunks(), t.column("y").combine_chunks()
        found, taken = [score(x)[0]], [pa.nulls(n, pa.string())]
        for g in names:
            at = donors_of(first, size, seed, g)
            found.append(score(exchanged(x, at, groups[g]))[0])
            taken.append(ids.take(pa.array(at)).cast(pa.string()))
        p = np.concatenate(found)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
        labels = pa.array(np.repeat(["", *names], n).tolist(), pa.string())
        return pa.table([pa.chunked_array([ids] * len(found)), labels, pa.chunked_array(taken), pa.chunked_array([y] * len(found)), listed], names=["patch_id", "group", "donor", "y", "p"])

    return dealt(data, ["x", "y"], seed, block_rows).applyInArrow(lambda t: run(t), "patch_id string, group string, donor string, y array<double>, p array<double>")


def score_pieces(data: DataFrame, model: Layers, vocabulary: Sequence[str], groups: Mapping[str, Sequence[int]], base: int = 0, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pieces (`packed`) of the scores of `permuted`: key base + group x labels + label, group 0 for the rows as they are."""
    score, n = values([model], vocabulary), len(vocabulary)

    def run(t: pa.Table) -> pa.Table:
        t, first, size = in_order(t)
        x, y = wide(t.column("x")), wide(t.column("y"))
        forms = [x, *(exchanged(x, donors_of(first, size, seed, g), places) for g, places in groups.items())]
        pieces = []
        for k, form in enumerate(forms):
            p = score(form)[0]
            pieces += [packed.piece(base + k * n + i, packed.numbers(p[:, i], y[:, i], DIGITS)) for i in range(n)]
        return pa.Table.from_batches([packed.batch_of(pieces)])

    return dealt(data, ["x", "y"], seed, block_rows).applyInArrow(lambda t: run(t), packed.PIECES)


def losses(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, group, ap_macro, ap_drop) from a cell a group and label: macro AP with each group permuted, and what is lost against the rows as they are."""
    ap = macro(cells, [*keys, "group"], ["ap"]).drop("ap_used")
    base = ap.where("group = ''").select(*(F.col(c).alias(f"_{c}") for c in keys), F.col("ap_macro").alias("base"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return ap.where("group <> ''").join(base, same).select(*keys, "group", "ap_macro", (F.col("base") - F.col("ap_macro")).alias("ap_drop"))


def importance(scored: DataFrame, vocabulary: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The losses of `permuted` rows, one long row a score: for rows with keys of their own. Large tables go by `score_pieces`."""
    cells = scored.select(*keys, "group", F.posexplode(F.arrays_zip("y", "p")).alias("k", "c"))
    long = cells.select(*keys, "group", F.get(F.array(*map(F.lit, vocabulary)), "k").alias("label"), F.col("c.y").cast("bigint").alias("true_label"), F.round("c.p", DIGITS).alias("score"))
    return losses(ranking(long, [*keys, "group", "label"]), keys)
