"""N-gram Jaccard join: MinHash LSH forest over word shingles, with exact verification.

A document is the set of its runs of five words (fewer words, but not none: one run), as 64-bit
hashes. Documents with one set are copies and count once, weighted by their number.

Forest: TREES tries over paths of LONGEST MinHash values. Two sets of similarity s share a prefix of d
values in some tree with probability p_d(s) = 1 - (1 - s^d)^TREES. Sets match at the longest prefix
first; then the prefix is shortened by one value at a time, for each set apart, until its recall is
reached: with the links found so far and their exact similarities s, the expected number of links
missed at depth d is the sum of (1 - p_d(s)) / p_d(s), and one more at the threshold is assumed. A set
with found / (found + missed) of TARGET_RECALL stops. The others go on to the depth at which
p_d(threshold) itself is TARGET_RECALL. A pair is compared while either of both goes on, so a set of
a large group stops early, and one with few links or none is searched to the end.

A trie node is the group of sets with one prefix in one tree. A node with the members of another is
the same node; it counts at its longest prefix. Inside a node sets are compared in blocks of at
most BLOCK sets and about VALUES shingles, block against block, each in a task of its own: the exact
intersections of two blocks are one 0/1 matrix product. A pair counts where its common prefix is longest, in
the first such tree, so nothing counts twice. What leaves a task grows with its sets, not with its
pairs: each set's number of links, and a spanning forest of them. A node of n distinct near copies
takes n^2 / 2 comparisons, and its sets are sent n / BLOCK times: that is the price of exact numbers of links.

Defined cases: null or wordless texts link with nothing and are classes of their own; a null doc_id
takes part and never names a class that has another; repeated rows are copies; other columns are
ignored. n_links counts the other documents (rows) at the threshold or above, copies included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, components, discard, matching, materialise, small_batches, table, text_key
from .textops import blocks, mix, shingle_hashes

SHINGLE, THRESHOLD = 5, 0.8
TREES, LONGEST, TARGET_RECALL = 24, 10, 0.999
BLOCK, VALUES = 512, 1_000_000


def chance(s: np.ndarray | float, depth: int, trees: int) -> np.ndarray | float:
    """Probability that two sets of similarity s share a prefix of that depth in some tree."""
    return 1 - (1 - s**depth) ** trees


def depths_for(threshold: float, trees: int = TREES, longest: int = LONGEST, recall: float = TARGET_RECALL) -> list[int]:
    """The prefix lengths, longest first, down to the one with enough recall at the threshold."""
    depth = longest
    while depth > 1 and chance(threshold, depth, trees) < recall:
        depth -= 1
    return list(range(longest, depth - 1, -1))


def _sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    for _, _, h, bounds in blocks(texts):
        s, at = shingle_hashes(h, bounds, shingle)
        for k in range(len(at) - 1):
            yield np.unique(s[at[k] : at[k + 1]])


def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(99).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


def _prefixes(s: np.ndarray, seeds: np.ndarray, trees: int, depths: list[int]) -> np.ndarray:
    """The hashes of the MinHash prefixes: for each depth, as listed, one per tree."""
    longest = depths[0]
    low = np.full(trees * longest, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(s), 4096):
        # multiply-shift on mixed values: the upper half of an odd multiple, one row per hash function
        v = s[i : i + 4096]
        np.minimum(low, ((v[None, :] * seeds[:, None]) >> np.uint64(32)).astype(np.uint32).min(axis=1), out=low)
    m = low.reshape(trees, longest).astype(np.uint64)
    out, at = np.arange(trees, dtype=np.uint64), {}
    for k in range(longest):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + m[:, k] + np.uint64(1))
        at[k + 1] = out
    return np.concatenate([at[d] for d in depths])


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, shingle: int, trees: int, depth: int) -> DataFrame:
    """(doc_id, text_key, digest, prefixes): digest names the shingle set, null for none; prefixes of that depth, one per tree."""
    schema = "doc_id bigint, text_key bigint, digest binary, prefixes array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(trees * depth)
        for batch in batches:
            digests, keys = [], []
            for s in _sets(batch.column(2), shingle):
                digests.append(_digest(s) if len(s) else None)
                keys.append(_prefixes(s, seeds, trees, [depth]).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_key", "digest", "prefixes"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key("text").alias("text_key"), "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame, shingle: int, trees: int, depths: list[int]) -> DataFrame:
    """(digest, size, values, prefixes): the shingle hashes as bytes, and the prefixes of all depths."""
    schema = "digest binary, size int, values binary, prefixes array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = _seeds(trees * depths[-1]).reshape(trees, depths[-1])
        more = _seeds(2 * trees * depths[0])[-trees * depths[0] :].reshape(trees, depths[0])
        seeds = np.concatenate([low, more[:, depths[-1] :]], axis=1).ravel()  # the shortest prefixes are those of `signatures`
        for batch in batches:
            got = [(_digest(s), len(s), s.tobytes(), _prefixes(s, seeds, trees, depths).view(np.int64)) for s in _sets(batch.column(0), shingle) if len(s)]
            for i in range(0, len(got), 256):
                digest, size, raw, keys = zip(*got[i : i + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array(raw, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["digest", "size", "values", "prefixes"])

    return docs.select("text").mapInArrow(run, schema)


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets; only shared values take columns, some at a time."""
    va, vb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    shared = np.intersect1d(va, vb)
    out = np.zeros((len(a), len(b)), np.float32)
    ca, cb = np.searchsorted(shared, va), np.searchsorted(shared, vb)
    ka, kb = np.isin(va, shared), np.isin(vb, shared)
    ra, ca, rb, cb = ra[ka], ca[ka], rb[kb], cb[kb]
    for lo in range(0, len(shared), 4096):
        ma, mb = np.zeros((len(a), min(4096, len(shared) - lo)), np.float32), np.zeros((len(b), min(4096, len(shared) - lo)), np.float32)
        x, y = (ca >= lo) & (ca < lo + 4096), (cb >= lo) & (cb < lo + 4096)
        ma[ra[x], ca[x] - lo] = 1
        mb[rb[y], cb[y] - lo] = 1
        out += ma @ mb.T
    return out


def _verify(threshold: float, trees: int, depths: list[int]):
    """For two blocks of a node: (digest, root, links, found, missed) of each set with a new link.

    root: a set that it is connected with here; links: partners, copies counted; found: partners; missed: by depth."""
    def run(key, rows):
        rows = rows.combine_chunks()
        level, tree = divmod(key[0].as_py(), trees)
        values = [np.frombuffer(v.as_buffer(), np.uint64) for v in rows.column("values").combine_chunks()]
        keys = np.stack([np.asarray(k, np.int64) for k in rows.column("prefixes").to_pylist()])
        copies, block, active, digests = rows.column("copies").to_numpy(), rows.column("block").to_numpy(), np.asarray(rows.column("active").to_pylist()), rows.column("digest").to_pylist()
        a, b = np.flatnonzero(block == key[2].as_py()), np.flatnonzero(block == key[3].as_py())
        full, near = np.zeros((len(values), len(values)), bool), np.zeros((0,))
        missed = np.zeros((len(values), len(depths)))
        if len(a) and len(b):
            sizes = np.array([len(x) for x in values], np.float64)
            both = _intersections([values[i] for i in a], [values[i] for i in b]).astype(np.float64)
            near = both / np.maximum(sizes[a][:, None] + sizes[b][None, :] - both, 1)
            ok = (near >= threshold - 1e-9) & (active[a][:, None] | active[b][None, :])
            # not where the pair has met: at a longer prefix in any tree, at this one in a tree before
            for t in [*range(trees if level else 0), *((trees if level else 0) + t for t in range(tree))]:
                ok &= keys[a, t][:, None] != keys[b, t][None, :]
            ok &= a[:, None] != b[None, :]
            full[np.ix_(a, b)] = ok
            full |= full.T
            x, y = np.nonzero(ok)
            s = np.minimum(near[x, y], 1.0)
            for k, d in enumerate(depths):
                p = chance(s, d, trees)
                each = (1 - p) / p
                np.add.at(missed[:, k], a[x], each)
                if a[0] != b[0]:  # of one block with itself, both orders are there
                    np.add.at(missed[:, k], b[y], each)
        links, found = full @ copies, full.sum(axis=1)
        root = np.arange(len(values))
        for i in range(len(values)):  # breadth first: a spanning forest of the links
            if root[i] == i:
                seen = full[i].copy()
                seen[i] = True
                todo = seen.copy()
                while True:
                    new = full[todo].any(axis=0) & ~seen
                    if not new.any():
                        break
                    seen |= new
                    todo = new
                root[seen] = i
        keep = np.flatnonzero(links > 0)
        out = [pa.array([digests[i] for i in keep], pa.binary()), pa.array([digests[root[i]] for i in keep], pa.binary()), pa.array(links[keep].astype(np.int64)), pa.array(found[keep].astype(np.int64)), pa.array(list(missed[keep]), pa.list_(pa.float64()))]
        return pa.table(out, names=["digest", "root", "links", "found", "missed"])

    return run


def alive_sets(docs: DataFrame, sets: DataFrame, shingle: int, trees: int, depths: list[int]) -> DataFrame:
    """Of the sets that share the shortest prefix with another in some tree: digest, size, values, prefixes, copies. No other can match."""
    nodes = sets.select("digest", F.posexplode("prefixes").alias("tree", "prefix"))
    shared = nodes.groupBy("tree", "prefix").agg(F.count("*").alias("n")).where("n > 1")
    alive = materialise(nodes.join(shared, ["tree", "prefix"], "left_semi").select("digest").distinct(), "alive")
    alive = sets.join(alive, "digest", "left_semi").select("digest", "copies", "first.doc_id", "first.text_key")
    alive = materialise(alive, "alive")
    full = full_sets(matching(docs, alive, "left_semi"), shingle, trees, depths).dropDuplicates(["digest"])
    return full.join(alive.select("digest", "copies"), "digest")


def trie_nodes(alive: DataFrame) -> DataFrame:
    """(digest, pos, prefix, n, total): the members of each different node. pos orders depths, longest first, then trees."""
    paths = alive.select("digest", "size", F.posexplode("prefixes").alias("pos", "prefix"))
    nodes = paths.groupBy("pos", "prefix").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("content")).where("n > 1")
    chosen = nodes.groupBy("n", "content").agg(F.min(F.struct("pos", "prefix", "total")).alias("x")).select("x.*", "n")
    return paths.drop("size").join(materialise(chosen, "nodes"), ["pos", "prefix"])


def links_of(alive: DataFrame, threshold: float, trees: int, depths: list[int], recall: float, block: int) -> DataFrame:
    """(digest, root, links, ...): all verified links, by set."""
    nodes = materialise(trie_nodes(alive), "trie")
    done: list[DataFrame] = []
    stopped = alive.select("digest").limit(0)
    for level, depth in enumerate(depths):
        here = nodes.where(F.floor(F.col("pos") / trees) == level)
        if level:
            here = here.join(bounded(stopped).withColumn("stopped", F.lit(True)), "digest", "left").withColumn("active", F.col("stopped").isNull()).drop("stopped")
            going = here.where("active").select("pos", "prefix").distinct()
            here = here.join(going, ["pos", "prefix"], "left_semi")
        else:
            here = here.withColumn("active", F.lit(True))
        parts = F.least("n", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("total") / VALUES))).cast("int")
        here = here.select("digest", "pos", "prefix", "active", parts.alias("parts")).withColumn("block", F.pmod(F.xxhash64("digest"), "parts").cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        units = here.withColumn("other", other).select("digest", "pos", "prefix", "active", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        # of the prefixes only those of this depth, and of the one before
        own = F.slice("prefixes", 1, trees) if level == 0 else F.slice("prefixes", (level - 1) * trees + 1, 2 * trees)
        rows = units.join(alive.select("digest", "copies", "values", own.alias("prefixes")), "digest")
        found = rows.groupBy("pos", "prefix", "low", "high").applyInArrow(_verify(threshold, trees, depths), "digest binary, root binary, links bigint, found bigint, missed array<double>")
        done.append(materialise(found, "verified"))
        if level + 1 < len(depths):
            tally = reduce(DataFrame.unionByName, done).groupBy("digest").agg(F.sum("found").alias("found"), F.sum(F.get("missed", F.lit(level))).alias("missed"))
            bound = recall * (F.col("found") + F.col("missed") + (1 - chance(threshold, depth, trees)))
            stopped = materialise(tally.where(F.col("found") >= bound).select("digest"), "stopped")
    discard(nodes)
    return reduce(DataFrame.unionByName, done)


def members(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, recall: float = TARGET_RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, text_key, class_id and class_key (those of the class's first document), n_copies, n_links."""
    small_batches(docs.sparkSession)
    depths = depths_for(threshold, trees, LONGEST, recall)
    narrow = materialise(signatures(docs, shingle, trees, depths[-1]), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    sets = narrow.where("digest IS NOT NULL").groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("copies"), F.first("prefixes").alias("prefixes"))
    sets = materialise(sets, "sets")
    alive = materialise(alive_sets(docs, sets, shingle, trees, depths), "full-sets")
    verified = links_of(alive, threshold, trees, depths, recall, block)

    links = verified.groupBy("digest").agg(F.sum("links").alias("links"))
    root = components(verified.select(F.col("digest").alias("a"), F.col("root").alias("b")).distinct()).withColumnRenamed("node", "digest")
    named = sets.select("digest", "first", "copies").join(root, "digest", "left").join(links, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = named.groupBy("root").agg(F.min("first").alias("class"))
    named = named.join(least, "root").select("digest", "class", "copies", "links")
    out = narrow.select("doc_id", "text_key", "digest").join(named, "digest", "left")
    own = F.when(F.col("digest").isNull(), order).otherwise(F.col("class"))
    n_links = F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long")
    return out.select("doc_id", "text_key", own["doc_id"].alias("class_id"), own["text_key"].alias("class_key"), F.coalesce("copies", F.lit(1)).alias("n_copies"), n_links.alias("n_links"))


def classes(docs: DataFrame, **parameters) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), n_copies (rows with its set), n_links."""
    return members(docs, **parameters).select("doc_id", "class_id", "n_copies", "n_links")


def deduplicate(docs: DataFrame, **parameters) -> DataFrame:
    """One document of each class stays, that with the least doc_id (then text key; null ids last), in its columns.

    Documents are told apart by doc_id and text together. A document that comes repeatedly stays once, also one
    without words (a null text counts as an empty one)."""
    found = materialise(members(docs, **parameters).groupBy("doc_id", "text_key", "class_id", "class_key").agg(F.count("*").alias("n")), "members")
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_key"))
    kept = matching(docs, found.where(~first), "left_anti")
    again = found.where(first & (F.col("n") > 1))
    once = matching(kept, again, "left_anti")
    return once.unionByName(matching(kept, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
