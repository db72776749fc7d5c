import hashlib
import re

from patchwright.llm import decontaminate
from patchwright.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), []
        for k, it in items:
            iw = words(it)
            n = min(13, len(iw))
            wins = {tuple(iw[p : p + n]) for p in range(len(iw) - n + 1)} if n else set()
            at = [p for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in wins] if n else []
            if at:
                ids.append(str(k))
                hit.update(q for p in at for q in range(p, p + n))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.drop("items").collect()), key=repr)


def test_edge_cases(spark, odd):
    items = [(1, "c d e"), (2, "B C"), (3, None), (4, " ".join(f"word{i}" for i in range(100, 140))), (5, "c d e"), (6, "zz"), (10, "x")]
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert got(decontaminate.contamination(odd, bench)) == brute(docs, items)
    assert got(decontaminate.contamination(odd, bench.limit(0))) == brute(docs, [])
    assert got(decontaminate.contamination(odd.limit(0), bench)) == []
    kept = decontaminate.decontaminate(odd, bench)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [2, 3, 4, 6]


def test_equal_items_and_clashing_names(spark):
    """Many ids of one text, also several times in a document, and columns named as inner ones."""
    text = " ".join(f"b{k}" for k in range(30))
    items = [(k, text) for k in range(40)] + [(7, text), (None, text), (50, text + " more"), (51, "b1 b2 b3")]
    docs = [(1, f"{text} x {text} y {text}"), (2, "b1 b2 b3 " * 5 + "z " * 200), (3, "clean words only")]
    df = spark.createDataFrame([(*d, 1, 2, 3, 4) for d in docs], "doc_id bigint, text string, k_id int, k_key int, Own_Key int, item int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = [(*r[:4], hashlib.sha256(",".join(sorted([str(k) for k in range(40)] + ["7", "50", "51"])).encode()).hexdigest(), r[5]) if r[0] == 1 else r for r in brute(docs, items)]
    assert got(decontaminate.contamination(df, bench)) == want
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect() if r["doc_id"] != 2] == [3]


def test_real_rows_by_brute_force(spark, small, documents):
    bench = table(spark, small, "benchmark")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    assert got(decontaminate.contamination(table(spark, small, "documents"), bench)) == brute(list(documents.items()), items)
