"""Sampling and resampling, all by seeded hash order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded, seeded_int
from ..sources.storage import materialise
from .metrics import ranking, score_ranges

#: bootstrap_many sends at most this many counts to a task; beyond it, joins do the same.
MAX_COUNTS = 5_000_000


def hash_rank(df: DataFrame, keys: Sequence[str], seed: int, ids: Sequence[str]) -> DataFrame:
    """df with _rank (from 1) in hash order within its keys, ties by the last id, and _n, the rows of the keys.

    Ranks are taken within 256 ranges of the hash, to which the sizes of the ranges before are added: a large stratum is spread over 256 tasks."""
    hashed = df.withColumn("_h", seeded(seed, *(F.col(c) for c in ids))).withColumn("_range", F.substring("_h", 1, 2))
    sizes = hashed.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    w = Window.partitionBy(*keys)  # at most 256 rows
    sizes = sizes.withColumn("_before", F.sum("_size").over(w.orderBy("_range")) - F.col("_size")).withColumn("_n", F.sum("_size").over(w)).drop("_size")
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_h", ids[-1]))
    sizes = sizes.select(*(F.col(c).alias(f"_k_{c}") for c in (*keys, "_range")), "_before", "_n")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*keys, "_range")]
    placed = hashed.withColumn("_within", within).join(sizes, reduce(lambda a, b: a & b, same))
    return placed.withColumn("_rank", F.col("_before") + F.col("_within")).select(*df.columns, "_h", "_rank", "_n")


def stratified_fraction(df: DataFrame, by: str, fraction: float, seed: int, patch: str = "patch_id") -> DataFrame:
    """round-half-even(fraction * size) rows of each stratum, the first in hash order."""
    ranked = hash_rank(df, [by], seed, [patch])
    return ranked.where(F.col("_rank") <= F.bround(F.col("_n") * fraction)).select(*df.columns)


def stratified_quota(df: DataFrame, by: str, target: int, seed: int, patch: str = "patch_id") -> DataFrame:
    """floor(target * share) rows of each stratum, topped up from the rest to exactly target rows (all if there are fewer)."""
    total = F.broadcast(df.agg(F.count("*").alias("_total")))  # one row
    ranked = hash_rank(df, [by], seed, [patch]).crossJoin(total)
    quota = F.floor(F.lit(target) * (F.col("_n") / F.col("_total")))
    # rows within quota come first; the limit is the feature
    ordered = ranked.select(*df.columns, (F.col("_rank") > quota).alias("_extra"), "_h")
    return ordered.orderBy("_extra", "_h", patch).limit(target).drop("_extra", "_h")


def primes(count: int, above: int = 2**31) -> list[int]:
    """The first primes above a number, by trial division."""
    small = [p for p in range(2, int(above**0.5) + 1000) if all(p % q for q in range(2, int(p**0.5) + 1))]
    out, n = [], above + 1
    while len(out) < count:
        if all(n % p for p in small if p * p <= n):
            out.append(n)
        n += 1
    return out


def thinning(draws: int, seed: int) -> list[tuple[int, int, int]]:
    """(draw, factor, shift): draw d keeps the ranks r with (factor * r + shift) mod n below what it takes.

    Factors are primes above any n, so each draw is a permutation of the ranks: no sort and no hash per draw."""
    shift = lambda d: int(hashlib.md5(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
    return [(d, p, shift(d)) for d, p in enumerate(primes(draws))]


def thinning_plan(pred: DataFrame, target: DataFrame, keys: Sequence[str], on: Sequence[str]) -> DataFrame:
    """(keys, mode, take_pos, take_neg): how a cell reaches the target prevalence by thinning the class in excess; cells that cannot are left out."""
    size = pred.groupBy(*keys).agg(F.sum("true_label").cast("bigint").alias("pos"), F.sum(1 - F.col("true_label")).cast("bigint").alias("neg"))
    t = F.col("prevalence")
    plan = size.join(F.broadcast(target), list(on))  # one row a class
    plan = plan.where((F.col("pos") > 0) & (F.col("neg") > 0) & (t > 0) & (t < 1))
    plan = plan.withColumn("need_neg", F.bround(F.col("pos") * (1 - t) / t).cast("bigint"))
    plan = plan.withColumn("need_pos", F.bround(F.col("neg") * t / (1 - t)).cast("bigint"))
    thin_neg = F.col("need_neg") <= F.col("neg")
    plan = plan.where(thin_neg | ((F.col("need_pos") > 0) & (F.col("need_pos") <= F.col("pos"))))
    return plan.select(
        *keys,
        F.when(thin_neg, "subsample_neg").otherwise("subsample_pos").alias("mode"),
        F.when(thin_neg, F.col("pos")).otherwise(F.col("need_pos")).alias("take_pos"),
        F.when(thin_neg, F.col("need_neg")).otherwise(F.col("neg")).alias("take_neg"),
    )


def prior_matched(pred: DataFrame, target: DataFrame, keys: Sequence[str], on: Sequence[str], draws: int, seed: int, patch: str = "patch_id") -> DataFrame:
    """(keys, raw_ap, mean_ap, mode, n_kept): AP after the class in excess is thinned to the target prevalence, over several draws.

    pred: keys, patch, true_label, score. target: on, prevalence. Patches are ranked once and sorted once, within balanced
    ranges of the score; a range counts for all draws what it keeps (a row of numbers), and, given what the ranges above
    keep, its share of each draw's AP. Rows are neither multiplied by draws nor sent to the driver."""
    pred = materialise(pred.select(*keys, patch, "true_label", "score"), "scores")
    plan = thinning_plan(pred, target, keys, on)
    ranked = hash_rank(pred, [*keys, "true_label"], seed, [*keys, patch]).join(F.broadcast(plan), list(keys))  # a row a cell
    take = F.when(F.col("true_label") == 1, F.col("take_pos")).otherwise(F.col("take_neg"))
    rows = ranked.select(*keys, F.col("true_label").cast("bigint").alias("label"), F.col("score").cast("double").alias("score"), (F.col("_rank") - 1).alias("rank"), F.col("_n").alias("n"), take.alias("take"))
    rows = materialise(score_ranges(rows, keys, "part"), "ranked")
    how = thinning(draws, seed)

    def kept(t: pa.Table, factor: int, shift: int) -> np.ndarray:
        rank, n, few = (t.column(c).to_numpy() for c in ("rank", "n", "take"))
        return (rank * factor + shift) % n < few

    def count(t: pa.Table) -> pa.Table:
        label = t.column("label").to_numpy() == 1
        both = [(int((k & label).sum()), int(k.sum())) for k in (kept(t, f, s) for _, f, s in how)]
        names = [*keys, "part"]
        return pa.table([*(t.column(c)[:1] for c in names), pa.array([[b[0] for b in both]]), pa.array([[b[1] for b in both]])], names=[*names, "pos", "all"])

    def share(t: pa.Table, above: pa.Table) -> pa.Table:
        if not t.num_rows:
            return t.select(list(keys)).append_column("ap", pa.array([], pa.list_(pa.float64())))
        t = t.sort_by([("score", "descending")])
        score, label = t.column("score").to_numpy(), t.column("label").to_numpy() == 1
        ends = np.append(np.flatnonzero(np.diff(score) != 0), len(score) - 1)
        pos_above, all_above = (above.column(c)[0].as_py() for c in ("pos_above", "all_above"))
        sums = []
        for d, f, s in how:
            k = kept(t, f, s)
            tp, seen = np.cumsum(k & label)[ends], np.cumsum(k)[ends]
            own = np.diff(tp, prepend=0)
            with np.errstate(invalid="ignore"):
                sums.append(float(np.where(own > 0, own * ((tp + pos_above[d]) / np.maximum(seen + all_above[d], 1)), 0.0).sum()))
        return pa.table([*(t.column(c)[:1] for c in keys), pa.array([sums], pa.list_(pa.float64()))], names=[*keys, "ap"])

    types = dict(rows.dtypes)
    names = ", ".join(f"`{c}` {types[c]}" for c in keys)
    counted = rows.groupBy(*keys, "part").applyInArrow(count, f"{names}, part int, pos array<bigint>, all array<bigint>")  # a row a range
    ahead = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

    def added(lists: Column, kind: str) -> Column:
        """Sums by place of a list of lists, one list a range."""
        return F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda d: F.aggregate(lists, F.lit(0).cast(kind), lambda a, x: a + x[d]))

    offsets = counted.select(*keys, "part", *(added(F.collect_list(c).over(ahead), "bigint").alias(f"{c}_above") for c in ("pos", "all")))
    shares = rows.groupBy(*keys, "part").cogroup(offsets.groupBy(*keys, "part")).applyInArrow(share, f"{names}, ap array<double>")
    total = shares.groupBy(*keys).agg(F.collect_list("ap").alias("aps"))
    ap = total.select(*keys, added(F.col("aps"), "double").alias("ap")).join(F.broadcast(plan), list(keys))
    mean = F.aggregate("ap", F.lit(0.0), lambda a, x: a + x) / draws / F.col("take_pos")
    raw = ranking(pred, keys).select(*keys, F.col("ap").alias("raw_ap"))
    return ap.join(raw, list(keys)).select(*keys, "raw_ap", mean.alias("mean_ap"), "mode", (F.col("take_pos") + F.col("take_neg")).alias("n_kept"))


def prior_gap(matched: DataFrame, reference: DataFrame, cls: str = "class") -> DataFrame:
    """One row (raw_gap, matched_gap, explained) in points: how much of the gap between a reference and other cells their priors explain.

    matched: the cells of prior_matched; reference: cls, ap. Both sides are means over classes of the means of their cells."""
    per_class = matched.groupBy(cls).agg(F.avg("raw_ap").alias("raw"), F.avg("mean_ap").alias("matched"))
    both = per_class.join(reference.select(cls, F.col("ap").alias("reference")), cls).where(F.col("reference").isNotNull())
    gap = lambda c: 100 * (F.avg("reference") - F.avg(c))
    return both.agg(gap("raw").alias("raw_gap"), gap("matched").alias("matched_gap"), (gap("raw") - gap("matched")).alias("explained"))


def cluster_bootstrap(pred: DataFrame, keys: Sequence[str], cluster: str, replicates: int, seed: int, cls: str = "class", weight: str | None = None) -> DataFrame:
    """(keys, replicate, ap_macro, auroc_macro): whole clusters drawn with replacement, as row weights; classes undefined in a replicate are skipped there.

    Clusters are numbered in hash order. Draw j of a replicate takes cluster number hash(seed, replicate, j) mod n."""
    named = hash_rank(pred.select(*keys, cluster).distinct(), keys, seed, [cluster]).select(*keys, cluster, (F.col("_rank") - 1).alias("number"), F.col("_n").alias("n"))
    size = named.groupBy(*keys).agg(F.max("n").alias("n"))
    draws = size.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    draws = draws.withColumn("number", seeded_int(seed, F.col("replicate"), F.col("j")) % F.col("n"))
    times = draws.groupBy(*keys, "replicate", "number").agg(F.count("*").alias("times")).join(named.drop("n"), [*keys, "number"]).select(*keys, "replicate", cluster, "times")
    # one row per (cluster, class, score) before replicates multiply them; the joins pick their own form by size
    own = F.lit(1) if weight is None else F.col(weight)
    small = pred.groupBy(*keys, cluster, cls, "score").agg(F.sum(own * F.col("true_label")).alias("pos"), F.sum(own).alias("n"))
    weighted = small.join(times, [*keys, cluster])
    weight = F.col("times") * F.when(F.col("true_label") == 1, F.col("pos")).otherwise(F.col("n") - F.col("pos"))
    rows = weighted.withColumn("true_label", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("w", weight).where("w > 0")
    cells = ranking(rows, [*keys, "replicate", cls], weight="w")
    return cells.groupBy(*keys, "replicate").agg(F.avg("ap").alias("ap_macro"), F.avg("auroc").alias("auroc_macro"))


def interval(replicates: DataFrame, keys: Sequence[str], values: Sequence[str] = ("ap_macro", "auroc_macro")) -> DataFrame:
    """Mean and 95 % percentile interval of each value over the replicates."""
    out = []
    for v in values:
        q = F.percentile(v, F.array(F.lit(0.025), F.lit(0.975)))
        out += [F.avg(v).alias(f"{v}_mean"), q[0].alias(f"{v}_low"), q[1].alias(f"{v}_high")]
    return replicates.groupBy(*keys).agg(F.count("*").alias("n_replicates"), *out)


#: Clusters of a block, draws of a task, and distinct (class, score) that a task holds numbers of at once.
BLOCK, DRAWN, CELLS = 65_536, 4_000_000, 2_000_000


def blocked_bootstrap(small: DataFrame, cluster: str, replicates: int, seed: int, cls: str, block: int = BLOCK, drawn: int = DRAWN, max_cells: int = CELLS) -> DataFrame:
    """cluster_bootstrap without keys for many clusters, with the same draws, from small (cluster, cls, score, pos, n).

    Clusters are numbered in hash order and dealt to blocks of their numbers. A task makes some draws of one replicate and
    sends, a block, how often each of its clusters was drawn, as packed bytes; a block weighs its rows by them and sends, a
    replicate, its sums by class and score; a replicate adds those. Nothing is multiplied by replicates as rows.
    With more than max_cells distinct classes and scores, joins do the same."""
    spark = small.sparkSession
    small = materialise(small, "small")
    cells = small.select(cls, "score").distinct()
    if cells.limit(max_cells + 1).count() > max_cells:
        whole = small.select(cluster, cls, "score", F.explode(F.array(F.struct(F.lit(1).alias("true_label"), F.col("pos").alias("w")), F.struct(F.lit(0).alias("true_label"), (F.col("n") - F.col("pos")).alias("w")))).alias("c")).select(cluster, cls, "score", "c.*")
        return cluster_bootstrap(whole.where("w > 0"), [], cluster, replicates, seed, cls, weight="w")
    names = small.select(cluster).distinct()
    n = names.count()
    # places of cells in order of class and falling score; at most max_cells rows
    order = Window.orderBy(cls, F.desc("score"))
    kinds = F.dense_rank().over(Window.orderBy(cls))
    cells = materialise(cells.select(cls, "score", (F.row_number().over(order) - 1).cast("int").alias("cell"), kinds.cast("int").alias("kind")), "cells")
    number = hash_rank(names, [], seed, [cluster]).select(cluster, (F.col("_rank") - 1).alias("number"))
    placed = small.join(number, cluster).join(cells, [small[cls].eqNullSafe(cells[cls]), small["score"].eqNullSafe(cells["score"])])
    rows = placed.select(F.floor(F.col("number") / block).cast("int").alias("block"), (F.col("number") % block).cast("int").alias("at"), "cell", F.col("pos").cast("double").alias("pos"), F.col("n").cast("double").alias("n"))
    packed = lambda a: pa.compress(a.tobytes(), "zstd", asbytes=True)

    def unpacked(body: bytes, size: int, kind) -> np.ndarray:
        return np.frombuffer(pa.decompress(body, size * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                digests = b"".join(hashlib.md5(b"%d:%d:%d" % (seed, r, j)).digest()[:4] for j in range(start, min(start + drawn, n)))
                numbers = np.sort(np.frombuffer(digests, ">u4").astype(np.int64) % n)
                blocks = range(-(-n // block))
                ends = np.searchsorted(numbers, [b * block for b in (*blocks, len(blocks))])
                for b in blocks:
                    if ends[b] < ends[b + 1]:
                        times = np.bincount(numbers[ends[b] : ends[b + 1]] - b * block, minlength=block).astype(np.int32)
                        yield pa.RecordBatch.from_pylist([{"block": b, "replicate": r, "times": packed(times)}], schema=pa.schema([("block", pa.int32()), ("replicate", pa.int64()), ("times", pa.binary())]))

    def weigh(own: pa.Table, times: pa.Table) -> pa.Table:
        own = own.sort_by("cell")
        at, cell, pos, count = (own.column(c).to_numpy() for c in ("at", "cell", "pos", "n"))
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        out = []
        times = times.sort_by("replicate")
        which = times.column("replicate").to_numpy()
        starts = np.append(np.flatnonzero(np.diff(which, prepend=-1)), len(which))
        held = packed(cell[first].astype(np.int32))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            w = sum(unpacked(times.column("times")[i].as_py(), block, np.int32) for i in range(a, b))[at]
            sums = np.concatenate([np.add.reduceat(x * w, first) for x in (pos, count)])
            out.append({"replicate": int(which[a]), "size": len(first), "cells": held, "sums": packed(sums)})
        return pa.Table.from_pylist(out, schema=pa.schema([("replicate", pa.int64()), ("size", pa.int32()), ("cells", pa.binary()), ("sums", pa.binary())]))

    total = cells.count()
    kind_of = np.empty(total, np.int32)
    for batch in cells.select("cell", "kind").toArrow().to_batches():  # at most max_cells
        kind_of[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    shared_kinds = spark.sparkContext.broadcast(np.append(np.flatnonzero(np.diff(kind_of, prepend=-1)), total))

    def finish(own: pa.Table) -> pa.Table:
        p, m = np.zeros(total), np.zeros(total)
        for size, held, body in zip(*(own.column(c).to_pylist() for c in ("size", "cells", "sums")), strict=True):
            where, sums = unpacked(held, size, np.int32), unpacked(body, 2 * size, np.float64)
            p[where] += sums[:size]
            m[where] += sums[size:]
        ap, auc = [], []
        ends = shared_kinds.value
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            x, y = p[a:b], m[a:b]
            tp, seen = np.cumsum(x), np.cumsum(y)
            if tp[-1] > 0:
                ap.append((x * tp / np.maximum(seen, 1e-300)).sum() / tp[-1])
            if 0 < tp[-1] < seen[-1]:
                auc.append(((y - x) * (tp - x / 2)).sum() / (tp[-1] * (seen[-1] - tp[-1])))
        return pa.Table.from_pylist([{"replicate": own.column("replicate")[0].as_py(), "ap_macro": float(np.mean(ap)) if ap else None, "auroc_macro": float(np.mean(auc)) if auc else None}], schema=pa.schema([("replicate", pa.int64()), ("ap_macro", pa.float64()), ("auroc_macro", pa.float64())]))

    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(n - 1, 0)).cast("bigint"), F.lit(drawn).cast("bigint")))
    jobs = spark.range(replicates if n else 0).select(F.col("id").alias("replicate"), starts.alias("start"))
    jobs = jobs.repartition(min(1000, replicates * -(-n // drawn) or 1), "replicate", "start")
    times = materialise(jobs.mapInArrow(draw, "block int, replicate bigint, times binary"), "times")
    sums = rows.groupBy("block").cogroup(times.groupBy("block")).applyInArrow(weigh, "replicate bigint, size int, cells binary, sums binary")
    return sums.groupBy("replicate").applyInArrow(finish, "replicate bigint, ap_macro double, auroc_macro double")


def bootstrap_many(pred: DataFrame, cluster: str, replicates: int, seed: int, cls: str = "class", max_counts: int = MAX_COUNTS) -> DataFrame:
    """cluster_bootstrap without keys for a thousand replicates, with the same draws: counts per (cluster, class, score) go once to each task as arrays.

    The arrays are as large as clusters x classes x distinct scores, which is counted; beyond max_counts blocked_bootstrap does it."""
    small = pred.groupBy(cluster, cls, "score").agg(F.sum("true_label").cast("double").alias("pos"), F.count("*").cast("double").alias("n"))
    if small.limit(max_counts + 1).count() > max_counts:
        return blocked_bootstrap(small, cluster, replicates, seed, cls)
    t = small.orderBy(cls, F.desc("score"), cluster).toArrow()
    names, at = np.unique(t.column(cluster).to_numpy(zero_copy_only=False), return_inverse=True)
    order = sorted(range(len(names)), key=lambda k: (hashlib.md5(f"{seed}:{names[k]}".encode()).hexdigest(), names[k]))
    number = np.empty(len(names), np.int64)
    number[order] = np.arange(len(names))
    kinds = np.unique(t.column(cls).to_numpy(zero_copy_only=False), return_inverse=True)[1]
    same = np.concatenate([[True], (np.diff(kinds) != 0) | (np.diff(t.column("score").to_numpy()) != 0)])[: len(kinds)]
    shared = pred.sparkSession.sparkContext.broadcast((number[at], kinds, np.cumsum(same) - 1, t.column("pos").to_numpy(), t.column("n").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, kind, group, pos, n = shared.value
        first = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0])) if len(group) else np.zeros(0, int)
        kinds, clusters = kind[first], where.max(initial=-1) + 1
        for batch in batches:
            out = []
            for r in batch.column(0).to_pylist():
                drawn = [int(hashlib.md5(f"{seed}:{r}:{j}".encode()).hexdigest()[:8], 16) % clusters for j in range(clusters)]
                times = np.bincount(drawn, minlength=clusters).astype(float)
                p, m = (np.add.reduceat(x * times[where], first) for x in (pos, n)) if len(first) else (pos, n)
                ap, auc = [], []
                for k in np.unique(kinds):
                    a, b = p[kinds == k], m[kinds == k]
                    tp, seen = np.cumsum(a), np.cumsum(b)
                    if tp[-1] > 0:
                        ap.append((a * tp / np.maximum(seen, 1e-300)).sum() / tp[-1])
                    if 0 < tp[-1] < seen[-1]:
                        auc.append(((b - a) * (tp - a / 2)).sum() / (tp[-1] * (seen[-1] - tp[-1])))
                out.append((r, float(np.mean(ap)) if ap else None, float(np.mean(auc)) if auc else None))
            yield pa.RecordBatch.from_pylist([dict(zip(("replicate", "ap_macro", "auroc_macro"), x, strict=True)) for x in out], schema=pa.schema([("replicate", pa.int64()), ("ap_macro", pa.float64()), ("auroc_macro", pa.float64())]))

    return pred.sparkSession.range(replicates).withColumnRenamed("id", "replicate").mapInArrow(run, "replicate bigint, ap_macro double, auroc_macro double")
