"""Conversation structure repair: the cheapest edits that give role initials `(s?(ua)+)?`, by a rank-compressed DP.

The DP goes turn by turn over four states: nothing yet, after the system turn, after a user turn, after an assistant
turn. An edit of a turn (Delete, Keep, Rerole) with the run of Inserts before it is one macro edit. Its letters are a
prefix-free code, as only the last letter is no I; so two sequences of as many codes compare as their first different
codes do, and no audit string is kept: a layer holds for each state the cost, the rank of its audit among those of
the layer, and a pointer to parent and code. Ranks of the next layer come from (rank of the parent, order of the code).
Audits are written afterwards, along the pointers. Runs of up to two inserts suffice: a third gives a state that one
insert gives as well.

At scale: rows without texts are put in range order, and each task turns its stretch of a conversation into a string of
turn classes, one byte a turn. A conversation inside one task is solved there. Of one that lies over several, each
stretch gives its costs and ranks from every state to every state (16 numbers), which are composed along the stretches
(at most one row a task), and each stretch is then written from its own first to its own last state. Earlier turns
of equal role and text are found by aggregation. Only the hash of the repaired turns needs all texts of a conversation
one after another, as SHA-256 has no other way: they pass a task as a stream, and memory is that of a batch. An audit is
one string, so a conversation has fewer than 2^31 turns.

Null texts and roles are one space. A role's initial is its first character; an empty role has none and is kept
nowhere. Turns order with nulls first; equal turns by role, then by the text's first 64 characters, then by its hash.
Equal rows are duplicates of each other. Null conv_ids form one conversation. Other columns are not read. An empty
table gives no rows. 128 bits of hash stand for role and text in finding duplicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_TRIM, materialise, small_batches, table

INITIALS = "sua"
OTHER = 3
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
COST = {"keep": 0, "rerole": 1, "delete": 2, "insert": 5, "truncated": 5}
FAR = 2**50
PREFIX = 64
#: Codes in the order of their letters; turn edits: letter, role given ('' keeps the turn's own).
CODES = sorted("I" * k + edit for k in range(3) for edit in "DKR")


def step(state: int, initial: int) -> int | None:
    """The state after a turn of this initial, or none."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


def inserted(state: int, n: int) -> tuple[int, list[str]]:
    """(state, roles) after n inserts: they alternate, as there is one role that fits."""
    roles = []
    for _ in range(n):
        state = ASSISTANT if state == USER else USER
        roles.append("assistant" if state == ASSISTANT else "user")
    return state, roles


def moves() -> tuple[np.ndarray, np.ndarray]:
    """(cost, code) [class, from, to] of the best macro edit; class: initial * 4 + fault."""
    cost, code = np.full((16, 4, 4), FAR, np.int64), np.zeros((16, 4, 4), np.int64)
    for kind in range(16):
        initial, fault = divmod(kind, 4)
        for state in range(4):
            for k, letters in enumerate(CODES):
                mid, _ = inserted(state, len(letters) - 1)
                price = COST["insert"] * (len(letters) - 1) + (COST["truncated"] if fault == TRUNCATED else 0)
                ends = {"D": [mid], "K": [step(mid, initial)], "R": [step(mid, 1), step(mid, 2)]}[letters[-1]]
                if letters[-1] == "D":
                    price = COST["insert"] * (len(letters) - 1) + COST["delete"]
                elif fault in (BLANK, DUPLICATE):
                    continue
                else:
                    price += COST["keep" if letters[-1] == "K" else "rerole"]
                for to in ends:
                    if to is not None and (price, k) < (cost[kind, state, to], code[kind, state, to] if cost[kind, state, to] < FAR else len(CODES)):
                        cost[kind, state, to], code[kind, state, to] = price, k
    return cost, code


MOVE_COST, MOVE_CODE = moves()
#: Inserts behind the last turn: how many each state needs to be final.
BEHIND = [next(n for n in range(3) if inserted(s, n)[0] in FINAL) for s in range(4)]


def ranked(key: np.ndarray, reached: np.ndarray) -> np.ndarray:
    """Rank of each key [.., 4] among the four; those not reached come last."""
    key = np.where(reached, key, np.iinfo(np.int64).max)
    return (key[..., :, None] > key[..., None, :]).sum(axis=-1)


def layers(kinds: np.ndarray, cost: np.ndarray, pointers: list | None) -> tuple[np.ndarray, np.ndarray]:
    """(cost, rank) [from, to] after the turns, from cost [from, to] before them; pointers get (parent, code) [from, to] a turn."""
    rank = np.zeros_like(cost)
    for kind in kinds:
        total = cost[:, :, None] + MOVE_COST[kind][None]  # from, parent, to
        order = rank[:, :, None] * len(CODES) + MOVE_CODE[kind][None]
        best = np.where(total == total.min(axis=1, keepdims=True), order, np.iinfo(np.int64).max).argmin(axis=1)
        cost = np.minimum(np.take_along_axis(total, best[:, None], 1)[:, 0], FAR)
        rank = ranked(np.take_along_axis(order, best[:, None], 1)[:, 0], cost < FAR)
        if pointers is not None:
            pointers.append((best.astype(np.int8), np.take_along_axis(np.broadcast_to(MOVE_CODE[kind], (len(cost), 4, 4)), best[:, None], 1)[:, 0].astype(np.int8)))
    return cost, rank


def entry(state: int | None = None) -> np.ndarray:
    """Costs before the first turn: from every state, or from one."""
    cost = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(cost, 0)
    return cost if state is None else cost[state : state + 1]


def last_state(cost: np.ndarray, rank: np.ndarray) -> int:
    """The state of the best end, inserts behind it included: the least cost, then the least audit."""
    return min(range(4), key=lambda s: (int(cost[s]) + COST["insert"] * BEHIND[s], int(rank[s])))


def edits(kinds: np.ndarray, first: int, last: int | None) -> tuple[int, bytes, bytes, int]:
    """(cost, code a turn, state before each turn, last state) of the best edits from state to state; last None: the best end."""
    pointers: list = []
    cost, rank = layers(kinds, entry(first), pointers)
    if last is None:
        last = last_state(cost[0], rank[0])
    codes, states, at = bytearray(), bytearray(), last
    for parent, code in reversed(pointers):
        codes.append(code[0, at])
        at = int(parent[0, at])
        states.append(at)
    return int(cost[0, last]), bytes(codes[::-1]), bytes(states[::-1]), last


def illegal(initials: np.ndarray) -> int:
    pairs = initials[:-1] * 4 + initials[1:]
    return int((~np.isin(pairs, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))).sum())


def shown(conv: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls of role and text as one space."""
    return conv.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))


def damaged(conv: DataFrame) -> DataFrame:
    """The damage that the query asks for."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = shown(conv).withColumn("fate", F.crc32(key.cast("binary")) % 20).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def keyed(turns: DataFrame) -> DataFrame:
    """Turns with what orders and tells them apart: start (of the text), h1, h2."""
    h = (F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"))
    return turns.select("conv_id", "turn", "role", "text", F.substring("text", 1, PREFIX).alias("start"), *h)


ORDER = ("conv_id", "turn", "role", "start", "h1", "h2")


def classed(turns: DataFrame) -> DataFrame:
    """One row per distinct turn, without its text: ORDER, n (equal rows), kind (class of the first), twin (class of the others)."""
    core = F.btrim("text", F.lit(SPACE_TRIM))
    place = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))  # an empty role: instr gives 1 for ''
    initial = F.when((place > 0) & (F.col("role") != ""), place - 1).otherwise(OTHER)
    fault = F.when(core == "", BLANK).when(~F.substring(core, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    rows = keyed(turns).withColumns({"initial": initial, "fault": fault})
    rows = rows.groupBy(*ORDER, "initial", "fault").agg(F.count(F.lit(1)).alias("n"))
    # the first turn of equal role and text: a key of (conv_id, h1, h2, turn) is one row, so the join back has no hot key
    when = F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("turn"))
    first = rows.groupBy("conv_id", "h1", "h2").agg(F.min(when)["turn"].alias("first_turn"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{d}")) for c, d in (("conv_id", "conv_id"), ("h1", "h1"), ("h2", "h2"), ("turn", "first_turn"))]
    joined = rows.alias("l").join(first.alias("r"), same[0] & same[1] & same[2] & same[3], "left")
    again = F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)
    kind = F.when(F.col("r.h1").isNotNull(), F.col("fault")).otherwise(again)
    return joined.select(*(F.col(f"l.{c}").alias(c) for c in ORDER), "n", (F.col("initial") * 4 + kind).cast("int").alias("kind"), (F.col("initial") * 4 + again).cast("int").alias("twin"))


STRETCH = "conv_id bigint, part int, edge boolean, turn bigint, role string, start string, h1 bigint, h2 bigint, kinds binary, turns bigint, low bigint, high bigint"


def stretches(rows: DataFrame) -> DataFrame:
    """One row per conversation and task of the range order: its first turn's place, the classes, the distinct turns with the least and the greatest."""
    order = [F.col(c).asc_nulls_first() for c in ORDER]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ended, done = None, 0, []
        for batch in batches:
            for conv, turn, role, start, h1, h2, n, kind, twin, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or conv != own["conv_id"]:
                    if own is not None:
                        done.append(own | {"edge": ended == 0, "kinds": bytes(own["kinds"])})
                        ended += 1
                    own = {"conv_id": conv, "part": part, "turn": turn, "role": role, "start": start, "h1": h1, "h2": h2, "kinds": bytearray(), "turns": 0, "low": 0, "high": None}
                own["kinds"] += bytes([kind]) + bytes([twin]) * (n - 1)
                if turn is not None and turn != own["high"]:
                    own["low"] = own["low"] if own["turns"] else turn
                    own["turns"], own["high"] = own["turns"] + 1, turn
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
        if own is not None:
            yield pa.RecordBatch.from_pylist([own | {"edge": True, "kinds": bytes(own["kinds"])}], schema=schema)

    n64, s = pa.int64(), pa.string()
    schema = pa.schema([("conv_id", n64), ("part", pa.int32()), ("edge", pa.bool_()), ("turn", n64), ("role", s), ("start", s), ("h1", n64), ("h2", n64), ("kinds", pa.binary()), ("turns", n64), ("low", n64), ("high", n64)])
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select(*ORDER, "n", "kind", "twin", F.spark_partition_id().alias("part")).mapInArrow(run, STRETCH)


def ways(edge: DataFrame) -> DataFrame:
    """For each stretch of a conversation that may lie over several: its first and its last state in the best edits of the whole."""

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, part, kinds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cost, rank = layers(np.frombuffer(kinds, np.uint8), entry(), None)
                out.append({"conv_id": conv, "part": part, "cost": cost.ravel().tolist(), "rank": rank.ravel().tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("cost", pa.list_(pa.int64())), ("rank", pa.list_(pa.int64()))]))

    def composed(group: pd.DataFrame) -> pd.DataFrame:
        """Along the stretches of one conversation, at most one a task; the costs and ranks from START only."""
        group = group.sort_values("part")
        cost, rank, parents = entry(START)[0], np.zeros(4, np.int64), []
        for c, r in zip(group["cost"], group["rank"], strict=True):
            total = cost[:, None] + np.reshape(c, (4, 4))
            order = rank[:, None] * 4 + np.reshape(r, (4, 4))
            best = np.where(total == total.min(axis=0), order, np.iinfo(np.int64).max).argmin(axis=0)
            cost = np.minimum(total.min(axis=0), FAR)
            rank = ranked(order[best, np.arange(4)], cost < FAR)
            parents.append(best)
        at = last_state(cost, rank)
        firsts, lasts = [], []
        for best in reversed(parents):
            lasts.append(at)
            at = int(best[at])
            firsts.append(at)
        return pd.DataFrame({"conv_id": group["conv_id"], "part": group["part"], "first": firsts[::-1], "last": lasts[::-1], "closing": [False] * (len(firsts) - 1) + [True]})

    numbers = edge.select("conv_id", "part", "kinds").mapInArrow(transfer, "conv_id bigint, part int, cost array<bigint>, rank array<bigint>")
    return numbers.groupBy("conv_id").applyInPandas(composed, "conv_id bigint, part int, first int, last int, closing boolean")


SOLVED = "conv_id bigint, part int, edge boolean, turn bigint, role string, start string, h1 bigint, h2 bigint, turns bigint, low bigint, high bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head int, tail int, cost bigint, audit string, codes binary, states binary, behind int"


def solved(all_stretches: DataFrame) -> DataFrame:
    """Stretches with counts of faults, cost, audit, code and state a turn, and the number of inserts behind the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple, tuple] = {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                kinds = np.frombuffer(r.pop("kinds"), np.uint8)
                first, last, closing = r.pop("first"), r.pop("last"), r.pop("closing")
                key = (kinds.tobytes(), first, last)
                found = memo.get(key)
                if found is None:
                    found = edits(kinds, first, last)
                    if len(kinds) <= 64 and len(memo) < 100_000:
                        memo[key] = found
                cost, codes, states, end = found
                behind = BEHIND[end] if closing else 0
                faults = np.bincount(kinds % 4, minlength=4)
                r |= {"blank": int(faults[BLANK]), "duplicate": int(faults[DUPLICATE]), "truncated": int(faults[TRUNCATED])}
                r |= {"illegal": illegal(kinds // 4), "head": int(kinds[0] // 4), "tail": int(kinds[-1] // 4), "cost": cost + COST["insert"] * behind}
                out.append(r | {"audit": "".join(CODES[c] for c in codes) + "I" * behind, "codes": codes, "states": states, "behind": behind})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    n64, n32, s = pa.int64(), pa.int32(), pa.string()
    schema = pa.schema(
        [("conv_id", n64), ("part", n32), ("edge", pa.bool_()), ("turn", n64), ("role", s), ("start", s)]
        + [(c, n64) for c in ("h1", "h2", "turns", "low", "high", "blank", "duplicate", "truncated", "illegal")]
        + [("head", n32), ("tail", n32), ("cost", n64), ("audit", s), ("codes", pa.binary()), ("states", pa.binary()), ("behind", n32)]
    )
    several = all_stretches.where("edge")
    found = ways(several).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "first", "last", "closing")
    edges = several.join(found, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")
    inner = all_stretches.where("NOT edge").withColumns({"first": F.lit(START), "last": F.lit(None).cast("int"), "closing": F.lit(True)})
    return edges.unionByName(inner).mapInArrow(run, SOLVED)


def whole(parts: DataFrame) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit. Those that may lie over several tasks have at most one row a task."""
    counts = ("blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def joined(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        out = {c: [group[c].sum()] for c in counts}
        out["illegal"][0] += sum(illegal(np.array(p)) for p in zip(group["tail"][:-1], group["head"][1:], strict=True))
        own = group[group["turns"] > 0]
        lows, highs = own["low"].to_numpy(), own["high"].to_numpy()
        distinct = own["turns"].sum() - (lows[1:] == highs[:-1]).sum()
        gaps = int(highs[-1]) - int(lows[0]) + 1 - int(distinct) if len(own) else 0
        return pd.DataFrame({"conv_id": pd.Series([key[0]], dtype="Int64"), "gaps": [gaps]} | out)

    schema = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
    columns = ("conv_id", "part", "turns", "low", F.coalesce("high", F.lit(0).cast("bigint")).alias("high"), "head", "tail", *counts)
    edges = parts.where("edge").select(*columns).groupBy("conv_id").applyInPandas(joined, schema)
    gaps = F.when(F.col("turns") > 0, F.col("high") - F.col("low") + 1 - F.col("turns")).otherwise(0).alias("gaps")
    return edges.unionByName(parts.where("NOT edge").select("conv_id", gaps, *counts))


def repaired(turns: DataFrame, parts: DataFrame) -> DataFrame:
    """The repaired turns in order: conv_id, place (from 0), role, text. A row with null place comes with each stretch, so no conversation is without rows.

    Turns and the stretches' edits meet in one order: a stretch comes before its first turn, and its edits are used up turn by turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, codes, states, at, behind, n = object(), b"", b"", 0, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for conv_id, role, text, more, more_states, closing in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv_id != conv:
                    conv, codes, states, at, behind, n = conv_id, b"", b"", 0, 0, 0
                if more is not None:
                    codes, states, at, behind = codes[at:] + more, states[at:] + more_states, 0, closing
                    out.append((conv_id, None, None, None))
                    continue
                code = CODES[codes[at]]
                state, roles = inserted(states[at], len(code) - 1)
                at += 1
                said = [(r, "") for r in roles]
                if code[-1] != "D":
                    said.append((role if code[-1] == "K" else "assistant" if state == USER else "user", text))
                if at == len(codes):
                    said += [(r, "") for r in ("user", "assistant")[2 - behind :]]
                out += [(conv_id, n + k, *x) for k, x in enumerate(said)]
                n += len(said)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["conv_id", "place", "role", "text"])

    rows = keyed(turns).select(*ORDER, F.lit(1).alias("what"), "text", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("states"), F.lit(None).cast("int").alias("behind"))
    marks = parts.select(*ORDER, F.lit(0).alias("what"), F.lit("").alias("text"), "codes", "states", "behind")
    order = [F.col(c).asc_nulls_first() for c in (*ORDER, "what")]
    merged = rows.unionByName(marks).repartition("conv_id").sortWithinPartitions(*order)
    small_batches(turns.sparkSession)
    return merged.select("conv_id", "role", "text", "codes", "states", "behind").mapInArrow(run, "conv_id bigint, place bigint, role string, text string")


def hashed(lines: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of `role:text` joined by line breaks, which pass as a stream. `lines` come from `repaired` and are not dealt again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, done = None, None, []
        for batch in batches:
            for conv_id, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv_id != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = conv_id, hashlib.sha256()
                if place is not None:
                    state.update((f"\n{role}:{text}" if place else f"{role}:{text}").encode())
            yield rows(done)
            done = []
        if state is not None:
            yield rows([(conv, state.hexdigest())])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "repaired_sha256"])

    return lines.mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, turns): one row per conversation with faults, cost and audit, and the repaired turns as `repaired` gives them."""
    turns = shown(turns)
    parts = materialise(solved(materialise(stretches(classed(turns)), "stretches")), "edits")
    return whole(parts), repaired(turns, parts)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    report, lines = repair(damaged(conv))
    every = conv.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()

    def to(df: DataFrame, name: str) -> tuple[DataFrame, Column]:
        return df.withColumnRenamed("conv_id", name), F.col("conv_id").eqNullSafe(F.col(name))

    (report, one), (hashes, two) = to(report, "c1"), to(hashed(lines), "c2")
    out = every.join(report, one, "left").join(hashes, two, "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
