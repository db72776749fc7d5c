"""Multi-label logistic models, all labels of a layer fitted together: binary relevance, stacking, classifier chains.

A model is a list of layers of labels. A layer sees the features and the outputs of all earlier layers:

    binary relevance    [[a, b, c]]
    stacked             [[a, b, c], [a, b, c]]
    chain               [[b], [a], [c]]

Inputs from earlier layers are cross-fitted: training rows have a fold by hash, and a row's input comes from models
fitted without its fold, so a layer trains on outputs of models that have not seen the row. Other rows get the outputs
of the models fitted on all training rows.

Training rows are written once as blocks of one fold, as bytes of their matrices. A pass over them gives loss, gradient
and Hessian of all models of a layer (every label, with every fold left out, of every chain that is fitted beside) at one
trial point each: matrix products per block, sums per task, then sums of tasks in two steps. The driver takes a Newton
step per model from these sums, whose size depends on features and models only. So jobs are as many as layers x Newton
steps (about eight), whatever the number of labels and of models side by side.

Weights are balanced per class, the penalty is on coefficients of weighted unit deviation, the intercept is free.
Labels without a training positive are left out by the caller's counts (`able`). Null labels count as 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import seeded_int
from ..sources.storage import discard, materialise
from . import packed

#: Tasks' sums are added in two steps, through so many groups a model.
FAN = 64
#: The intercept of a label that has one class only: no finite one is the best.
ONE_CLASS = 30.0
#: Rows of a block, and rows that a task gathers before it hands blocks on.
BLOCK, HELD = 4096, 262_144


@dataclass(frozen=True)
class Layer:
    """Labels and their coefficients: [label, fold left out or (last) none, input and intercept]."""

    labels: tuple[str, ...]
    coefficients: np.ndarray


@dataclass(frozen=True)
class Layers:
    """A fitted model: probabilities of a label come from the last layer that has it."""

    layers: tuple[Layer, ...]
    folds: int

    def extended(self, x: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """The inputs with the outputs of all layers behind them, one column a label; fold -1: no training row."""
        if len(fold) and (fold == fold[0]).all():
            return self.extended_alike(x, int(fold[0]))
        width = x.shape[1] + sum(len(layer.labels) for layer in self.layers)
        out = np.empty((len(x), width))
        for f in np.unique(fold):
            out[fold == f] = self.extended_alike(x[fold == f], int(f))
        return out

    def extended_alike(self, x: np.ndarray, fold: int) -> np.ndarray:
        """The same for rows of one fold."""
        for layer in self.layers:
            c = layer.coefficients[:, -1 if fold < 0 else fold]
            x = np.concatenate([x, sigmoid(x @ c[:, :-1].T + c[:, -1])], axis=1)
        return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def fold_of(role: Column, folds: int, seed: int = 42, patch: str = "patch_id") -> Column:
    """The fold of a training row, by hash; -1 for other rows."""
    return F.when(role == "train", seeded_int(seed, F.col(patch)) % max(folds, 1)).otherwise(-1).cast("int")


def training_table(vectors: DataFrame, labels: Sequence[str], folds: int, seed: int = 42, patch: str = "patch_id") -> DataFrame:
    """(patch_id, role, x array<double>, y array<double>, fold): training rows get a fold by hash, others -1."""
    fold = fold_of(F.col("role"), folds, seed, patch)
    y = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in labels))
    return vectors.select(F.col(patch).cast("string").alias("patch_id"), "role", vector_to_array("features").alias("x"), y.alias("y"), fold.alias("fold"))


def matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, fold) of a batch whose first columns these are."""
    wide = lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
    return wide(batch.column(0)), wide(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)


def blocks(data: DataFrame) -> DataFrame:
    """(fold, n, x, y), written: the rows in blocks of one fold, as the bytes of their matrices, which all passes read."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def out(folds):
            rows = []
            for f in folds:
                x, y = (np.concatenate(m) for m in zip(*held.pop(f), strict=True))
                rows += [(f, len(x[a : a + BLOCK]), x[a : a + BLOCK].tobytes(), y[a : a + BLOCK].tobytes()) for a in range(0, len(x), BLOCK)]
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["fold", "n", "x", "y"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, fold = matrices(batch)
            for f in np.unique(fold).tolist():
                held.setdefault(f, []).append((x[fold == f], y[fold == f]))
            size += len(x)
            if size >= HELD:
                yield out(sorted(held))
                size = 0
        if held:
            yield out(sorted(held))

    return materialise(data.select("x", "y", "fold").mapInArrow(packed, "fold int, n int, x binary, y binary"), "blocks")


def summed(data: DataFrame, per_block, n: int) -> list[np.ndarray]:
    """The sums over all blocks of per_block(x, y, fold), a list of n arrays: added per task, then by FAN groups of tasks an array, then by array. Empty without rows."""
    schema = "row int, task int, sums binary"

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for fold, rows, x, y in zip(*(batch.column(c).to_pylist() for c in ("fold", "n", "x", "y")), strict=True):
                own = per_block(np.frombuffer(x).reshape(rows, -1), np.frombuffer(y).reshape(rows, -1), fold)
                total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        if total is not None:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"row": pa.array(range(n), pa.int32()), "task": pa.array([task] * n, pa.int32()), "sums": pa.array([r.tobytes() for r in total], pa.binary())})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("task")  # one order of addition
        total = np.sum([np.frombuffer(b) for b in group["sums"]], axis=0)
        return pd.DataFrame({"row": group["row"][:1].to_numpy(), "task": group["task"][:1].to_numpy(), "sums": [total.tobytes()]})

    parts = data.mapInArrow(tasks, schema)
    if data.rdd.getNumPartitions() > FAN:  # else the first step has nothing to add
        parts = parts.groupBy("row", F.expr(f"task % {FAN}")).applyInPandas(lambda g: add(g), schema)
    rows = parts.groupBy("row").applyInPandas(lambda g: add(g), schema).collect()  # as many as parts
    return [np.frombuffer(r.sums) for r in sorted(rows, key=lambda r: r.row)]


@dataclass(frozen=True)
class Part:
    """Models with the same inputs: the place of each one's label in y, what it leaves out or trains on, its penalty.

    `key` is a number a model: with `bits` it is the bit that a fold must have, else the fold that is left out."""

    before: Layers
    place: np.ndarray
    key: np.ndarray
    reg: np.ndarray
    bits: bool = False

    def uses(self, fold: int) -> np.ndarray:
        return (fold & self.key) != 0 if self.bits else self.key != fold


def fit_many(data: DataFrame, vocabulary: Sequence[str], models: Sequence[Sequence[Sequence[str]]], folds: int = 5, reg: float = 0.01, passes: int = 30, tolerance: float = 1e-11) -> list[Layers]:
    """Several models of layers, from a `training_table` whose y is in the order of the vocabulary: the k-th layers of all of them are fitted in the same passes, what begins alike once."""
    table = blocks(data.where("role = 'train'"))
    done: dict[tuple, Layers] = {(): Layers((), folds)}
    models = [tuple(tuple(labels) for labels in layers) for layers in models]
    for k in range(max(map(len, models))):
        wanted: dict[tuple, list] = {}
        for m in models:
            if len(m) > k:
                labels, held = wanted.setdefault(m[:k], [[], False])
                labels += [c for c in m[k] if c not in labels]
                wanted[m[:k]][1] = held or len(m) > k + 1
        parts, shapes = [], []
        for before, (labels, cross) in wanted.items():
            left_out = [*(range(folds) if cross else ()), -2]
            each = [(vocabulary.index(c), f) for c in labels for f in left_out]
            parts.append(Part(done[before], np.array([c for c, _ in each], int), np.array([f for _, f in each], int), np.full(len(each), reg)))
            shapes.append((before, labels, len(left_out)))
        found = newton(table, parts, passes, tolerance)
        of = {before: (labels, points.reshape(len(labels), n, -1)) for (before, labels, n), points in zip(shapes, found, strict=True)}
        for m in models:
            if len(m) > k:
                labels, points = of[m[:k]]
                own = points[[labels.index(c) for c in m[k]]]
                done[m[: k + 1]] = Layers((*done[m[:k]].layers, Layer(m[k], own)), folds)
    discard(table)
    return [done[m] for m in models]


def fit_runs(data: DataFrame, vocabulary: Sequence[str], able: Sequence[Sequence[str]], reg: float = 0.01, passes: int = 30, tolerance: float = 1e-11) -> list[Layers]:
    """A model of binary relevance for each of several runs, over the same rows, all fitted in the same passes.

    data: x, y in the order of the vocabulary, and fold: the number whose bit k says that run k trains on the row (at most 31 runs). able: labels of each run."""
    models = [(vocabulary.index(c), 1 << k) for k, labels in enumerate(able) for c in labels]
    part = Part(Layers((), 1), np.array([c for c, _ in models], int), np.array([b for _, b in models], int), np.full(len(models), reg), bits=True)
    table = blocks(data.where("fold <> 0"))
    points = newton(table, [part], passes, tolerance)[0]
    discard(table)
    ends = np.cumsum([len(labels) for labels in able])[:-1]
    return [Layers((Layer(tuple(labels), own[:, None, :]),), 1) for labels, own in zip(able, np.split(points, ends), strict=True)]


def fit_penalties(data: DataFrame, vocabulary: Sequence[str], labels: Sequence[str], regs: Sequence[float], passes: int = 30, tolerance: float = 1e-11) -> list[Layers]:
    """A model of binary relevance for each penalty, all fitted in the same passes."""
    part = Part(Layers((), 1), np.array([vocabulary.index(c) for _ in regs for c in labels], int), np.full(len(regs) * len(labels), -2), np.repeat(np.array(regs, float), len(labels)))
    table = blocks(data.where("role = 'train'"))
    points = newton(table, [part], passes, tolerance)[0]
    discard(table)
    return [Layers((Layer(tuple(labels), own[:, None, :]),), 1) for own in np.split(points, len(regs))]


def newton(table: DataFrame, parts: Sequence[Part], passes: int, tolerance: float) -> list[np.ndarray]:
    """Coefficients [model, input and intercept] of the weighted logistic models of each part, from `blocks`. A pass serves all models that have not settled."""
    def moments(x0, y, fold):
        out = []
        for part in parts:
            x, use = part.before.extended_alike(x0, fold), part.uses(fold)
            s = np.zeros((len(part.place), 2 + 4 * x.shape[1]))
            pos = y[:, part.place[use]].T
            neg = 1 - pos
            s[use] = np.concatenate([pos.sum(axis=1)[:, None], neg.sum(axis=1)[:, None], pos @ x, neg @ x, pos @ x**2, neg @ x**2], axis=1)
            out.append(s)
        return out

    sums = summed(table, moments, len(parts))
    if not sums:
        raise ValueError("no training rows")
    n_of = [len(p.place) for p in parts]
    dims, weights, totals, ridges = [], [], [], []
    for part, s, k in zip(parts, sums, n_of, strict=True):
        m = s.reshape(k, -1)
        d = (m.shape[1] - 2) // 4
        n_pos, n_neg = m[:, 0], m[:, 1]
        n = n_pos + n_neg
        with np.errstate(divide="ignore", invalid="ignore"):
            w_pos, w_neg = np.where(n_pos > 0, n / (2 * n_pos), 1.0), np.where(n_neg > 0, n / (2 * n_neg), 1.0)
            total = w_pos * n_pos + w_neg * n_neg
            first, second = (w_pos[:, None] * m[:, 2 + a * d : 2 + (a + 1) * d] + w_neg[:, None] * m[:, 2 + (a + 1) * d : 2 + (a + 2) * d] for a in (0, 2))
            spread = total - (w_pos**2 * n_pos + w_neg**2 * n_neg) / total
            variance = np.maximum(second - first**2 / total[:, None], 0) / spread[:, None]
        dims.append(d)
        weights.append((w_pos, w_neg, n_pos, n_neg))
        totals.append(total)
        ridges.append(np.concatenate([part.reg[:, None] * variance, np.zeros((k, 1))], axis=1))
    upper = [np.triu_indices(d + 1) for d in dims]

    def at(points: list[np.ndarray], active: list[np.ndarray]):
        def pass_(x0, y0, fold):
            out = []
            for part, point, on, (w_pos, w_neg, *_), (i, j) in zip(parts, points, active, weights, upper, strict=True):
                s = np.zeros((len(on), 1 + point.shape[1] + len(i)))
                use = np.flatnonzero(on & part.uses(fold))
                if len(use):
                    x = np.concatenate([part.before.extended_alike(x0, fold), np.ones((len(x0), 1))], axis=1)
                    y = y0[:, part.place[use]]
                    z = x @ point[use].T
                    e = np.exp(-np.abs(z))
                    p = np.where(z >= 0, 1.0, e) / (1 + e)
                    w = np.where(y == 1, w_pos[use], w_neg[use])
                    loss = (w * (np.log1p(e) + np.maximum(z, 0) - y * z)).sum(axis=0)
                    gradient = (w * (p - y)).T @ x
                    s[use] = np.concatenate([loss[:, None], gradient, (w * (e / (1 + e) ** 2)).T @ (x[:, i] * x[:, j])], axis=1)
                out.append(s)
            return out

        found = []
        for s, point, total, ridge, (i, j) in zip(summed(table, pass_, len(parts)), points, totals, ridges, upper, strict=True):
            s = s.reshape(len(point), -1) / total[:, None]
            d = point.shape[1]
            hessian = np.zeros((len(point), d, d))
            hessian[:, i, j] = hessian[:, j, i] = s[:, d + 1 :]
            found.append((s[:, 0] + 0.5 * (ridge * point**2).sum(axis=1), s[:, 1 : d + 1] + ridge * point, hessian + ridge[:, None] * np.eye(d)))
        return found

    points = [np.zeros((k, d + 1)) for k, d in zip(n_of, dims, strict=True)]
    for p, (_, _, n_pos, n_neg) in zip(points, weights, strict=True):
        p[:, -1] = np.where(n_neg == 0, ONE_CLASS, np.where(n_pos == 0, -ONE_CLASS, 0.0))
    active = [np.ones(k, bool) for k in n_of]
    state = at(points, active)
    scale = [np.ones(k) for k in n_of]
    for _ in range(passes):
        trial = []
        for p, (_, gradient, hessian), on, size in zip(points, state, active, scale, strict=True):
            step = -np.stack([np.linalg.lstsq(h, g, rcond=1e-14)[0] for h, g in zip(hessian, gradient, strict=True)])
            on &= ~(-(step * gradient).sum(axis=1) < tolerance)
            trial.append(p + np.where(on, size, 0.0)[:, None] * step)
        if not any(on.any() for on in active):
            break
        for q, (p, now, new, on) in enumerate(zip(list(points), state, at(trial, active), active, strict=True)):
            better = on & (new[0] <= now[0] + 1e-12 * (1 + np.abs(now[0])))
            scale[q] = np.where(better, np.minimum(1.0, scale[q] * 2), scale[q] / 4)
            points[q] = np.where(better[:, None], trial[q], p)
            state[q] = tuple(np.where(better.reshape(-1, *[1] * (a.ndim - 1)), a, b) for a, b in zip(new, now, strict=True))
    return points


def fit(data: DataFrame, vocabulary: Sequence[str], layers: Sequence[Sequence[str]], folds: int = 5, reg: float = 0.01, passes: int = 30, tolerance: float = 1e-11) -> Layers:
    """The model of these layers, from a `training_table` whose y is in the order of the vocabulary."""
    return fit_many(data, vocabulary, [layers], folds, reg, passes, tolerance)[0]


def values(models: Sequence[Layers], vocabulary: Sequence[str]):
    """f(x) -> [model, row, label of the vocabulary]: probabilities of rows that are not trained on; NaN for labels without a model."""
    found = []
    for model in models:
        widths = np.cumsum([0, *(len(layer.labels) for layer in model.layers)])
        last = {c: int(widths[k]) + i for k, layer in enumerate(model.layers) for i, c in enumerate(layer.labels)}
        found.append((model, [k for k, c in enumerate(vocabulary) if c in last], [last[c] for c in vocabulary if c in last]))

    def score(x: np.ndarray) -> np.ndarray:
        out = np.full((len(found), len(x), len(vocabulary)), np.nan)
        for q, (model, has, places) in enumerate(found):
            out[q][:, has] = model.extended_alike(x, -1)[:, x.shape[1] :][:, places]
        return out

    return score


def score_pieces(data: DataFrame, score, roles: Sequence[str], digits: int = 6) -> DataFrame:
    """Written pieces (`packed`) of all scores of the rows of these roles: key (q x roles + role) x labels + label, where score(x) gives [q, row, label]; NaN is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y, role = matrices(batch)
                p = score(x)
                for r in np.unique(role).tolist():
                    mine = role == r
                    for q in range(len(p)):
                        for k in range(p.shape[2]):
                            own = p[q, mine, k]
                            some = ~np.isnan(own)
                            if some.any():
                                yield (q * len(roles) + r) * p.shape[2] + k, packed.numbers(own[some], y[mine, k][some], digits)

        yield from packed.gather(found())

    number = F.array_position(F.array(*map(F.lit, roles)), F.col("role")).cast("int") - 1
    rows = data.where(F.col("role").isin(*roles)).select("x", "y", number.alias("role"))
    return materialise(rows.mapInArrow(run, packed.PIECES), "pieces")


def probabilities(data: DataFrame, model: Layers, vocabulary: Sequence[str], out_of_fold: bool = False) -> DataFrame:
    """data with `p` array<double> in the order of the vocabulary, null for labels without a model; out_of_fold: training rows by models without their fold."""
    last = {c: (k, i) for k, layer in enumerate(model.layers) for i, c in enumerate(layer.labels)}
    widths = np.cumsum([0, *(len(layer.labels) for layer in model.layers)])
    places = [int(widths[last[c][0]]) + last[c][1] if c in last else None for c in vocabulary]
    known = [p for p in places if p is not None]

    @F.arrow_udf("array<double>")
    def score(x: pa.Array, fold: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        found = model.extended(rows, fold.to_numpy(zero_copy_only=False))[:, rows.shape[1] :][:, known]
        wide = np.full((len(x), len(places)), np.nan)
        wide[:, [k for k, p in enumerate(places) if p is not None]] = found
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(places), pa.int32()), pa.array(wide.ravel(), from_pandas=True))

    fold = F.col("fold") if out_of_fold else F.lit(-1)
    return data.withColumn("p", score("x", fold))


def predictions(data: DataFrame, model: Layers, labels: Sequence[str], names: Sequence[str], roles: Sequence[str]) -> DataFrame:
    """Long predictions (patch_id, role, label_idx, label_name, true_label, probability) of the rows of these roles."""
    scored = probabilities(data.where(F.col("role").isin(*roles)), model, labels)
    cells = F.transform(F.arrays_zip("y", "p"), lambda c, k: F.struct(k.cast("int").alias("label_idx"), F.get(F.array(*map(F.lit, names)), k).alias("label_name"), c["y"].alias("true_label"), c["p"].alias("probability")))
    return scored.select("patch_id", "role", F.inline(F.filter(cells, lambda c: c["probability"].isNotNull())))


def beside(data: DataFrame, score, models: Sequence[str], labels: Sequence[str], names: Sequence[str], roles: Sequence[str]) -> DataFrame:
    """Long predictions of several models, with `model`: a row is scored by all of them at once, where score(x) gives [model, row, label]; NaN is left out."""
    @F.arrow_udf("array<double>")
    def flat(x: pa.Array) -> pa.Array:
        p = score(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1))
        wide = p.transpose(1, 0, 2).reshape(len(x), -1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * wide.shape[1], pa.int32()), pa.array(wide.ravel(), from_pandas=True))

    scored = data.where(F.col("role").isin(*roles)).withColumn("p", flat("x"))
    n = len(labels)
    name = lambda values, k: F.get(F.array(*map(F.lit, values)), k)
    cells = F.transform("p", lambda p, i: F.struct(name(models, (i / n).cast("int")).alias("model"), (i % n).cast("int").alias("label_idx"), name(names, (i % n).cast("int")).alias("label_name"), F.get("y", i % n).alias("true_label"), p.alias("probability")))
    return scored.select("patch_id", "role", F.inline(F.filter(cells, lambda c: c["probability"].isNotNull())))


def averaged(parts: Sequence[DataFrame]) -> DataFrame:
    """An ensemble: the mean probability of several models' long predictions, which hold the same cells."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("patch_id", "role", "label_idx", "label_name", "true_label").agg(F.avg("probability").alias("probability"))


def npmi(data: DataFrame, names: Sequence[str]) -> DataFrame:
    """(a, b, npmi) of all pairs of labels that occur together on training rows, a < b; as many rows as pairs of labels."""
    rows = data.where("role = 'train'").select(F.filter(F.arrays_zip(F.array(*map(F.lit, names)).alias("c"), F.col("y").alias("y")), lambda z: z["y"] == 1)["c"].alias("l"))
    one = rows.select(F.explode("l").alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    both = rows.select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_both"))
    total = rows.agg(F.count("*").alias("total"))
    x = both.join(F.broadcast(one.select(F.col("c").alias("a"), F.col("n").alias("n_a"))), "a").join(F.broadcast(one.select(F.col("c").alias("b"), F.col("n").alias("n_b"))), "b")
    x = x.crossJoin(F.broadcast(total))
    value = F.log(F.col("n_both") * F.col("total") / (F.col("n_a") * F.col("n_b"))) / F.nullif(-F.log(F.col("n_both") / F.col("total")), F.lit(0.0))
    return x.select("a", "b", F.coalesce(value, F.lit(1.0)).alias("npmi"))


def chain_order(edges: DataFrame, names: Sequence[str]) -> list[tuple[str, float | None]]:
    """The labels in spanning order of the NPMI graph, each with its strongest tie to an earlier one.

    First the label with the greatest sum of NPMI, then always the label with the greatest NPMI to any that is in the
    chain; ties to the earlier name, NPMI to six digits. Labels that never meet the chain come last, by name."""
    weight = {}
    for r in edges.collect():  # pairs of labels
        weight[r.a, r.b] = weight[r.b, r.a] = round(r.npmi, 6)
    total = {c: round(sum(v for (a, _), v in weight.items() if a == c), 6) for c in names}
    out: list[tuple[str, float | None]] = []
    rest = sorted(names)
    while rest:
        tie = {c: max((weight[c, o] for o, _ in out if (c, o) in weight), default=None) for c in rest}
        if not out:
            best = min(rest, key=lambda c: (-total[c], c))
        else:
            best = min(rest, key=lambda c: (tie[c] is None, -(tie[c] or 0.0), c))
        out.append((best, tie[best]))
        rest.remove(best)
    return out


def frequency_order(counts: dict[str, tuple[int, int]]) -> list[str]:
    """Labels by falling number of training positives, then by name."""
    return sorted(counts, key=lambda c: (-counts[c][1], c))
