"""Random forests over binned features, all labels and trees grown side by side.

A forest sees a feature only by its bin (at most BINS, cut at quantiles of the training rows), so rows with equal bins are
one cell: Spark counts, per cell, the training rows of each class. A tree's bootstrap draws each row Poisson(1) times; what
a cell gets is the sum of its rows' draws, which is Poisson of its count, so cells lose nothing against rows. Cells are sent
to groups of trees; a tree is grown in its task, level by level, scores the cells, and the trees' shares are added by Spark.
Rows then take the scores of their cell. Work on trees follows the cells, which features and bins bound; work on rows is one
count and one join.

As MLlib's classifier: Gini impurity of weighted rows, sqrt(features) tried a node, leaves of one row allowed, a tree's vote
is its leaf's shares of the classes. With more than `max_cells` cells (many features), `scores` returns None, and the caller
trains by MLlib's passes over rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialise

BINS = 32
#: Cells that a task holds at once: some hundred bytes each while a tree grows.
MAX_CELLS = 500_000
#: Histogram entries (nodes x bins x classes) of a tree that are held at once.
ENTRIES = 2_000_000
#: Groups of trees a label, each a task: a group's cells are sent once.
GROUPS = 8


@dataclass(frozen=True)
class Forest:
    """Parameters of a forest."""

    trees: int = 50
    depth: int = 10
    seed: int = 42


def cuts(train: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Per place of x the values between bins, a value belongs below the first cut that is not less: between all distinct values where there are few, else quantiles."""
    at = [F.get("x", j) for j in range(width)]
    inner = [k / bins for k in range(1, bins)]
    row = train.agg(*(F.percentile_approx(c, F.array(*map(F.lit, inner)), 10_000).alias(f"q{j}") for j, c in enumerate(at)), *(F.approx_count_distinct(c, 0.02).alias(f"n{j}") for j, c in enumerate(at))).first()
    few = [j for j in range(width) if row[f"n{j}"] <= 2 * bins]  # so that these sets are small
    sets = train.agg(F.lit(0).alias("none"), *(F.collect_set(at[j]).alias(f"s{j}") for j in few)).first()
    out = []
    for j in range(width):
        values = np.unique(sets[f"s{j}"]) if j in few else np.zeros(0)
        out.append((values[1:] + values[:-1]) / 2 if 0 < len(values) <= bins else np.unique(np.array(row[f"q{j}"] or [], float)))
    return out


def grow(bins: np.ndarray, counts: np.ndarray, depth: int, rng: np.random.Generator) -> np.ndarray:
    """The shares of the classes [cell, class] in the leaf of each cell, of one tree on these (drawn and weighted) counts [cell, class]."""
    return grow_to(bins, counts, [depth], rng)[0]


def grow_to(bins: np.ndarray, counts: np.ndarray, depths: Sequence[int], rng: np.random.Generator) -> list[np.ndarray]:
    """The same at several rising depths of one tree: a deeper tree begins as the shallower one."""
    m, d = bins.shape
    k, tried, width = counts.shape[1], int(np.ceil(np.sqrt(d))), int(bins.max(initial=0)) + 1
    total = counts.sum(axis=0, keepdims=True)
    out = np.repeat(total / max(total.sum(), 1e-300), m, axis=0)
    cell, node = np.arange(m), np.zeros(m, np.int64)  # cells of open nodes, in order of their nodes
    column, drawn = np.ascontiguousarray(bins.T), np.ascontiguousarray(counts.T)
    sums, found = total, []
    for level in range(depths[-1]):
        if level in depths:
            found.append(out.copy())
        split = np.flatnonzero((sums > 0).sum(axis=1) > 1)  # nodes of one class are leaves
        if not len(split):
            break
        number = np.full(len(sums), -1)
        number[split] = np.arange(len(split))
        keep = number[node] >= 0
        cell, node, sums = cell[keep], number[node[keep]], sums[split]
        pick = np.argsort(rng.random((len(sums), d)), axis=1)[:, :tried]
        best, feature, border = np.zeros(len(sums)), np.full(len(sums), -1), np.zeros(len(sums), np.int64)
        weight = sums.sum(axis=1)
        parent = (sums**2).sum(axis=1) / weight
        some = max(1, ENTRIES // (width * k))
        for low in range(0, len(sums), some):
            a, b = np.searchsorted(node, [low, low + some])
            mass = drawn[:, cell[a:b]]
            for j in range(d):
                mine = np.flatnonzero((pick[low : low + some] == j).any(axis=1)) + low
                if not len(mine):
                    continue
                place = np.full(min(low + some, len(sums)) - low, -1)
                place[mine - low] = np.arange(len(mine))
                p = place[node[a:b] - low]
                has = np.flatnonzero(p >= 0)
                flat = p[has] * width + column[j][cell[a:b][has]]
                h = np.stack([np.bincount(flat, mass[c][has], len(mine) * width).reshape(len(mine), width) for c in range(k)], axis=2)
                left = np.cumsum(h, axis=1)[:, :-1]
                right = sums[mine][:, None] - left
                wl, wr = left.sum(axis=2), right.sum(axis=2)
                small = 1e-9 * weight[mine][:, None]  # rounding of sums
                able = (wl > small) & (wr > small)
                gain = np.where(able, (left**2).sum(axis=2) / np.where(able, wl, 1) + (right**2).sum(axis=2) / np.where(able, wr, 1) - parent[mine][:, None], 0) / weight[mine][:, None]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(axis=1)
                value = gain[np.arange(len(mine)), at]
                better = value > np.maximum(best[mine], 1e-12)
                best[mine[better]], feature[mine[better]], border[mine[better]] = value[better], j, at[better]
        inside = feature[node] >= 0
        cell, node = cell[inside], node[inside]
        if not len(cell):
            break
        child = node * 2 + (bins[cell, feature[node]] > border[node])
        order = np.argsort(child.astype(np.uint16) if len(sums) < 2**15 else child, kind="stable")  # short numbers sort faster
        cell, child = cell[order], child[order]
        node = np.cumsum(np.diff(child, prepend=child[0]) > 0)
        sums = np.stack([np.bincount(node, drawn[c][cell], node[-1] + 1) for c in range(k)], axis=1)
        out[cell] = (sums / sums.sum(axis=1, keepdims=True))[node]
    return found + [out] * (len(depths) - len(found))


def binned(data: DataFrame) -> DataFrame:
    """data with `cell`, the bins of x by the training rows. data is read several times: pass a written table."""
    first = data.select(F.size("x").alias("d")).first()
    width = first.d if first else 0
    borders = cuts(data.where("train"), width)

    @F.arrow_udf("binary")
    def cell(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        found = np.stack([np.searchsorted(b, rows[:, j], "left") for j, b in enumerate(borders)], axis=1).astype(np.uint8)
        return pa.array([r.tobytes() for r in found], pa.binary())

    return data.withColumn("cell", cell("x") if width else F.lit(b""))


def votes(rows: DataFrame, labels: int, classes: int, forests: Sequence[Forest], weighted: bool = False, max_cells: int = MAX_CELLS) -> tuple[DataFrame, int] | None:
    """((cell, label, p array<double>: the shares of the classes, mean over trees, of one forest after the other), number of cells) of `binned` rows.

    Forests of one seed share their trees: of more trees or a greater depth, one goes on where the other ends."""
    of = lambda i, c: F.count_if(F.col("train") & (F.get("y", i) == c))
    counted = rows.groupBy("cell").agg(F.array(*(of(i, c) for i in range(labels) for c in range(classes))).alias("n"))
    counted = materialise(counted, "cells")
    n_cells = counted.count()
    if n_cells > max_cells:
        return None
    total = np.array(counted.agg(F.array(*(F.sum(F.get("n", i)) for i in range(labels * classes)))).first()[0] or [0] * labels * classes, float).reshape(labels, classes)
    with np.errstate(divide="ignore", invalid="ignore"):
        weights = np.where(total > 0, total.sum(axis=1, keepdims=True) / (classes * total), 1.0) if weighted else np.ones_like(total)
    most = max(f.trees for f in forests)
    groups = min(GROUPS, most)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("cell")  # one order of draws
        names = t.column("cell").combine_chunks()
        bins = np.frombuffer(b"".join(names.to_pylist()), np.uint8).reshape(len(names), -1)
        n = t.column("n").combine_chunks().flatten().to_numpy().reshape(len(names), classes)
        label, group = (t.column(c)[0].as_py() for c in ("label", "group"))
        p = np.zeros((len(names), len(forests), classes))
        for tree in range(group, most, groups):
            for seed in sorted({f.seed for f in forests if tree < f.trees}):
                depths = sorted({f.depth for f in forests if f.seed == seed and tree < f.trees})
                rng = np.random.default_rng([seed, label, tree])
                grown = dict(zip(depths, grow_to(bins, rng.poisson(n) * weights[label], depths, rng), strict=True))
                for k, f in enumerate(forests):
                    if f.seed == seed and tree < f.trees:
                        p[:, k] += grown[f.depth]
        wide = len(forests) * classes
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * wide, pa.int32()), pa.array(p.ravel()))
        return pa.table([t.column("cell"), t.column("label"), t.column("group"), listed], names=["cell", "label", "group", "p"])

    slices = F.array(*(F.struct(F.lit(i).alias("label"), F.lit(g).alias("group"), F.slice("n", i * classes + 1, classes).alias("n")) for i in range(labels) for g in range(groups)))
    dealt = counted.select("cell", F.inline(slices))
    shares = dealt.repartition(max(labels * groups, 1), "label", "group").groupBy("label", "group").applyInArrow(run, "cell binary, label int, group int, p array<double>")
    ordered = F.array_sort(F.collect_list(F.struct("group", "p")))  # one order of addition
    mean = lambda k, c: F.aggregate(ordered, F.lit(0.0), lambda a, s: a + F.get(s["p"], k * classes + c)) / forests[k].trees
    return shares.groupBy("cell", "label").agg(F.array(*(mean(k, c) for k in range(len(forests)) for c in range(classes))).alias("p")), n_cells


def scores(data: DataFrame, labels: int, classes: int, forest: Forest, weighted: bool = False, max_cells: int = MAX_CELLS) -> DataFrame | None:
    """data with `p` array<array<double>>: per label the shares of its classes, mean over trees. None with more than max_cells cells.

    data: x array<double> of one length without nulls, y array<int> (a class from 0 per label) and train boolean. weighted: classes of
    a label weigh alike. A label without training rows of a second class is a constant. data is read several times: pass a written table."""
    rows = binned(data)
    voted = votes(rows, labels, classes, [forest], weighted, max_cells)
    if voted is None:
        return None
    per_label, n_cells = voted
    per_cell = per_label.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "p"))), lambda s: s["p"]).alias("p"))
    found = materialise(per_cell, "votes")
    small = n_cells * labels * classes <= 2_000_000
    return rows.join(F.broadcast(found) if small else found, "cell").drop("cell")
