"""The report and the repaired turns against plain Python: every edit sequence by a search over whole audits."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from patchwright.llm import conversation_repair as rep
from patchwright.llm.entry_points import queries

BLANKS = " \t\n\x0b\x0c\r"


def fates(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        elif fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def fits(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return (initials == "" or rest != "") and rest == "ua" * (len(rest) // 2) and len(rest) % 2 == 0


def plain(rows):
    """Report of one conversation in order, and its repaired lines: whole audits with their roles in a dictionary, no states."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        core = text.strip(BLANKS)
        faults.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for _, t, _, _ in rows if t is not None]
    initials = [r[:1] for _, _, r, _ in rows]
    bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    best = {"": (0, "", [])}  # initials so far, shortened -> cost, audit, lines

    def keep(into, initials, cost, audit, lines):
        if re.fullmatch("s?(ua)*u?", initials):
            key = initials if initials in ("", "s") else "u" if initials[-1] == "u" else "ua"
            if key not in into or (cost, audit) < into[key][:2]:
                into[key] = (cost, audit, lines)

    def with_inserts():
        """Before and after one, two and three inserts."""
        out = [best]
        for _ in range(3):
            more = {}
            for key, (cost, audit, lines) in out[-1].items():
                for name in ("user", "assistant"):
                    keep(more, key + name[0], cost + 5, audit + "I", [*lines, f"{name}:"])
            out.append(more)
        return [item for layer in out for item in layer.items()]

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for key, (cost, audit, lines) in with_inserts():
            keep(new, key, cost + 2, audit + "D", lines)
            if fault not in ("b", "d"):
                extra = 5 if fault == "t" else 0
                if role:
                    keep(new, key + role[0], cost + extra, audit + "K", [*lines, f"{role}:{text}"])
                for name in ("user", "assistant"):
                    keep(new, key + name[0], cost + extra + 1, audit + "R", [*lines, f"{name}:{text}"])
        best = new
    cost, audit, lines = min((v for k, v in with_inserts() if k in ("", "ua")), key=lambda v: v[:2])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows, damage=True):
    ids = {r[0] for r in rows}
    kept = fates(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    return {i: plain([r for r in kept if r[0] == i]) for i in ids}


def exhaustive(kinds):
    """Least (cost, audit) over all audits with up to two inserts in a place, by trying them."""
    best = None

    def go(k, initials, cost, audit):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for run in range(3):
            for start in ("ua", "au"):
                made = initials + (start * 2)[:run]
                if run == 0 and start == "au":
                    continue
                price, letters = cost + 5 * run, audit + "I" * run
                if k == len(kinds):
                    if fits(made) and (best is None or (price, letters) < best):
                        best = (price, letters)
                    continue
                initial, fault = divmod(kinds[k], 4)
                go(k + 1, made, price + 2, letters + "D")
                if fault not in (rep.BLANK, rep.DUPLICATE):
                    price += 5 * (fault == rep.TRUNCATED)
                    go(k + 1, made + "sua?"[initial], price, letters + "K")
                    go(k + 1, made + "u", price + 1, letters + "R")
                    go(k + 1, made + "a", price + 1, letters + "R")

    go(0, "", 0, "")
    return best


def test_dp_against_every_edit_sequence(monkeypatch):
    draw = random.Random(4)
    for _ in range(60):
        kinds = np.array([draw.randrange(16) for _ in range(draw.randint(1, 4))], np.uint8)
        cost, codes, _, end = rep.edits(kinds, rep.START, None)
        audit = "".join(rep.CODES[c] for c in codes) + "I" * rep.BEHIND[end]
        assert (cost + 5 * rep.BEHIND[end], audit) == exhaustive(kinds.tolist()), kinds


def test_whole_table(spark, small):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{small}/conversations.parquet'").fetchall()
    want = expected(rows)
    got = {r.conv_id: tuple(r)[1:] for r in queries()["op11_conversation_repair"](spark, small).collect()}
    assert got == want


def random_rows(draw, sizes):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "Üser"]
    texts = ["Yes.", "No!", "cut off", "", "  \n", None, "Why?", "Fine. ", "x" * 200 + "."]
    rows = []
    for conv, n in sizes:
        for _ in range(n):
            rows.append((conv, draw.choice([None, draw.randint(0, n), draw.randint(0, 3 * n)]), draw.choice(roles), draw.choice(texts) if draw.random() < 0.4 else f"text {draw.randint(0, 5 * n)}{draw.choice(['.', '', '?'])}"))
    return rows


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_stretches_over_tasks_give_the_same(spark, partitions):
    """A conversation of a third of all rows, many small ones, nulls, ties and repeated rows, over few and many tasks."""
    draw = random.Random(partitions)
    rows = random_rows(draw, [(7, 400), (None, 5), *((k, draw.randint(1, 9)) for k in range(100, 220))])
    rows += rows[:30] + [(8, 1, "user", "same."), *[(8, 2, "assistant", "same.")] * 40]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"a.b": F.lit(1), "part": F.lit("x"), "kind": F.lit(2)})
        report, turns = rep.repair(df)
        want = expected(rows, damage=False)
        hashes = {r.conv_id: r.repaired_sha256 for r in rep.hashed(turns).collect()}
        columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
        got = {r.conv_id: (*(r[c] for c in columns), hashes[r.conv_id]) for r in report.collect()}
        assert len(got) == report.count()
        assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_dropped_and_empty(spark, tmp_path):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello."), (None, None, None, None)]
    schema = "conv_id bigint, turn bigint, role string, text string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/one/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries()["op11_conversation_repair"](spark, f"{tmp_path}/one").collect()}
    assert got == expected(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries()["op11_conversation_repair"](spark, f"{tmp_path}/none").count() == 0
