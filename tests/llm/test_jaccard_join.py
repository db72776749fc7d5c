import re
from collections import Counter

import numpy as np

from patchwright.llm import jaccard_join as J
from patchwright.llm.common import components, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    """(doc_id, class, links) by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in docs]
    root, links = list(range(len(sets))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, least.get(find(k)) if s else i, links[k]) for k, (i, s) in enumerate(sets)), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in df.collect()), key=repr)


def test_edge_cases(spark, odd):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(J.classes(odd)) == brute(docs)
    assert got(J.classes(odd.limit(0))) == []
    kept = J.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)) == [1, 2, 3, 4, 6]
    assert kept.where("doc_id IS NULL").count() == 2
    assert J.deduplicate(odd.limit(0)).count() == 0


def test_documents_are_told_apart_by_id_and_text(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    schema = "doc_id bigint, text string, k_id int, K_KEY int, own_key int, class_id int, digest int"

    def kept(rows):
        return sorted(((r["doc_id"], r["text"]) for r in J.deduplicate(spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], schema)).collect()), key=repr)

    assert kept([(7, a), (7, b)]) == [(7, a), (7, b)]
    assert kept([(3, a), (7, a), (7, b), (None, a), (3, a)]) == [(3, a), (7, b)]


def near_copies(n, edits, rng, words=120):
    base = [f"w{k}" for k in range(words)]
    for i in range(n):
        w = list(base)
        for k in rng.choice(words, edits(i), replace=False):
            w[k] = f"x{i}y{k}"
        yield i, " ".join(w)


def test_large_near_group_loses_no_link(spark):
    """Distinct near copies of one text, in one block and in many."""
    docs = [*near_copies(60, lambda i: 1, np.random.default_rng(5)), (99, "something else entirely that nobody wrote before")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    whole, want = got(J.classes(df)), brute(docs)
    assert got(J.classes(df, block=7)) == whole
    assert [r[:2] for r in whole] == [r[:2] for r in want]
    assert sum(r[2] for r in want) >= sum(r[2] for r in whole) >= 0.998 * sum(r[2] for r in want)


def test_recall_near_the_threshold(spark):
    """Pairs of a similarity from 0.8: alone, and in one large group where sets stop at longer prefixes."""
    rng = np.random.default_rng(1)
    pairs = [(2 * i + k, " ".join(f"p{i}w{j}" if k == 0 or j not in (20, 60) else f"q{i}w{j}" for j in range(95))) for i in range(150) for k in (0, 1)]  # 81 of 101 shingles
    group = [(1000 + i, t) for i, t in near_copies(150, lambda i: i % 3, rng)]
    links = {i: n for i, _, n in got(J.classes(spark.createDataFrame(pairs + group, "doc_id bigint, text string")))}
    for docs in (pairs, group):
        want = {i: n for i, _, n in brute(docs)}
        assert all(links[i] <= want[i] for i in want)
        assert sum(links[i] for i in want) >= 0.99 * sum(want.values()) > 0


def test_real_rows_by_brute_force(spark, small, documents):
    assert got(J.classes(table(spark, small, "documents"))) == brute(list(documents.items()))


def test_depths_meet_the_recall():
    d = J.depths_for(0.8)
    assert d[0] == J.LONGEST and d == sorted(d, reverse=True)
    assert J.chance(0.8, d[-1], J.TREES) >= J.TARGET_RECALL > J.chance(0.8, d[-1] + 1, J.TREES)


def test_components(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (None, 3)], "a bigint, b bigint")
    root = {r["node"]: r["root"] for r in components(chain).collect()}
    assert {root[k] for k in range(41)} == {0} and root[101] == 100
    star = spark.createDataFrame([(5000, k) for k in range(300)] + [(k, 5001) for k in range(300, 400)], "a bigint, b bigint")
    root = {r["node"]: r["root"] for r in components(star).collect()}
    assert {root[k] for k in (*range(300), 5000)} == {0} and {root[k] for k in (*range(300, 400), 5001)} == {300}
    assert components(chain.limit(0)).count() == 0
