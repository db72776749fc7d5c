"""Benchmark decontamination [native]: prefix-filtered set join with exact windows.

An item of n words gives windows of min(window, n) consecutive words. A window lies in a document
only if each of its shingles (min(shingle, n) words) does, so one shingle is a sufficient prefix:
the rarest, counted over all documents. Steps, all DataFrame functions:

1. every document shingle is joined by hash with those of the benchmark; the matches are written;
2. their frequencies order the shingles by rarity; a window's prefix is its rarest shingle;
3. matches with a prefix shingle give alignments (document position of the item's first word).
   Length and positional bounds: the window has to end inside the document and start in it;
4. documents with alignments are read again, and each window is compared word by word in place.

Defined cases: null or wordless texts have no words, hits or items; an empty benchmark leaves all
documents clean; equal items each count; repeated documents come back as often as they came; a
null item_id counts as an item but is left out of the joined ids; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, ascii_lower, bind, bounded, matching, materialise, table, text_key

WINDOW, SHINGLE = 13, 5
MIN_SHARE_OF = 20  # contaminated: n_hit * 20 >= n_words


def lower_words(text: Column) -> Column:
    return alnum_words(ascii_lower(text))


def shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of `size` words, by position from 0; none where there are fewer words. words: a bound column."""
    run = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))
    return F.when(F.size(words) >= size, run).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items of equal words are one item until the ids are told.

    (items: item, words, width, size), (names: item, item_id, copies) and (item_shingles: item, size, width, n_item, at, h)."""
    rows = benchmark.select("item_id", lower_words(F.coalesce("text", F.lit(""))).alias("words")).where(F.size("words") > 0)
    rows = rows.select(F.xxhash64("words").alias("item"), "item_id", "words")
    names = rows.groupBy("item", "item_id").agg(F.count("*").alias("copies"))
    items = rows.groupBy("item").agg(F.first("words").alias("words"))
    items = items.select("item", "words", F.least(F.lit(window), F.size("words")).alias("width"), F.least(F.lit(shingle), F.size("words")).alias("size"))
    own = ["item", "size", "width", F.size("words").alias("n_item")]
    parts = [items.where(F.col("size") == k).select(*own, F.posexplode(shingles(F.col("words"), k)).alias("at", "h")) for k in range(1, shingle + 1)]
    return items, names, reduce(DataFrame.unionByName, parts)


def document_matches(docs: DataFrame, item_shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, text_key, pos, h, size): document shingles that any item has."""
    known = bounded(item_shingles.select("h", "size").distinct())
    words = docs.select("doc_id", text_key("text").alias("text_key"), lower_words(F.coalesce("text", F.lit(""))).alias("words"))
    out = None
    for k in sizes:
        part = words.select("doc_id", "text_key", F.posexplode(shingles(F.col("words"), k)).alias("pos", "h")).withColumn("size", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.join(known, ["h", "size"], "left_semi")


def prefix_shingles(item_shingles: DataFrame, frequency: DataFrame) -> DataFrame:
    """(h, size, item, at): for each window the rarest of its shingles, ties by hash, then the first."""
    ranked = item_shingles.join(frequency, ["h", "size"], "left").withColumn("rank", F.struct(F.coalesce("n", F.lit(0)), "h", "at"))
    start = F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("width") + F.col("size")), F.least("at", F.col("n_item") - F.col("width"))))
    windows = ranked.select("item", "size", "rank", start.alias("start"))
    best = windows.groupBy("item", "size", "start").agg(F.min("rank").alias("rank"))
    return best.select("item", "size", F.col("rank.h").alias("h"), F.col("rank.at").alias("at")).distinct()


def hits_in(words: Column, alignments: Column) -> Column:
    """Per item (item, starts, width, words): the document positions where one of its windows begins."""
    def found(w: Column, a: Column, start: Column) -> Column:
        # run: length of the run of equal words that ends with item word i
        runs = F.aggregate(
            F.sequence(F.lit(0), F.size(a["words"]) - 1),
            F.struct(F.lit(0).alias("run"), F.array().cast("array<int>").alias("at")),
            lambda s, i: bind(
                F.when((i + start >= 0) & F.coalesce(F.get(w, i + start) == F.get(a["words"], i), F.lit(False)), s["run"] + 1).otherwise(0),
                lambda r: F.struct(r.alias("run"), F.when(r >= a["width"], F.concat(s["at"], F.array(i + start - a["width"] + 1))).otherwise(s["at"]).alias("at")),
            ),
        )
        return runs["at"]

    def one(w: Column, a: Column) -> Column:
        at = F.flatten(F.transform(a["starts"], lambda start: found(w, a, start)))
        return F.struct(a["item"].alias("item"), a["width"].alias("width"), at.alias("at"))

    return bind(words, lambda w: F.transform(alignments, lambda a: one(w, a)))


def scored(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, min_share_of: int = MIN_SHARE_OF) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, n_items, items_sha256, items, contaminated."""
    items, names, item_shingles = item_windows(benchmark, window, shingle)
    items, names, item_shingles = materialise(items, "items"), materialise(names, "item-names"), materialise(item_shingles, "item-shingles")
    sizes = [r["size"] for r in items.select("size").distinct().collect()] or [shingle]  # at most `shingle` numbers
    matches = materialise(document_matches(docs, item_shingles, sizes), "shingle-matches")
    frequency = matches.groupBy("h", "size").agg(F.count("*").alias("n"))
    prefix = materialise(prefix_shingles(item_shingles, frequency), "prefixes")

    near = matches.join(bounded(prefix), ["h", "size"]).select("doc_id", "text_key", "item", (F.col("pos") - F.col("at")).alias("start")).distinct()
    near = materialise(near, "alignments")
    words = docs.select("doc_id", text_key("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    keys = near.select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_key")).distinct()
    touched = words.join(keys, words["doc_id"].eqNullSafe(keys["k_id"]) & (words["text_key"] == keys["k_key"]), "left_semi")
    touched = touched.dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", lower_words(F.col("text")).alias("words"))
    # verification by document: its alignments by item, each with the item's words once; no more than its own matches
    held = near.groupBy("doc_id", "text_key", "item").agg(F.collect_list("start").alias("starts"))
    item_words = items.select("item", "width", F.col("words").alias("item_words"))
    size_of = F.aggregate("item_words", F.lit(64), lambda n, w: n + 16 + F.octet_length(w))
    listed = held.join(bounded(item_words, weight=size_of), "item")
    listed = listed.groupBy(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_key")).agg(
        F.collect_list(F.struct("item", "starts", "width", F.col("item_words").alias("words"))).alias("alignments")
    )
    hit = touched.join(listed, touched["doc_id"].eqNullSafe(listed["k_id"]) & (touched["text_key"] == listed["k_key"]))
    hit = hit.select("k_id", "k_key", hits_in(F.col("words"), F.col("alignments")).alias("found"))
    spans = F.sort_array(F.flatten(F.transform("found", lambda x: F.transform(x["at"], lambda p: F.struct(p.alias("p"), x["width"].alias("width"))))))

    def cover(s: Column, x: Column) -> Column:
        end = x["p"] + x["width"]
        return F.struct((s["n"] + F.greatest(F.lit(0), end - F.greatest(s["end"], x["p"]))).alias("n"), F.greatest(s["end"], end).alias("end"))

    covered = F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), cover, lambda s: s["n"])
    hit = hit.select("k_id", "k_key", covered.cast("long").alias("n_hit"), F.array_distinct(F.transform(F.filter("found", lambda x: F.size(x["at"]) > 0), lambda x: x["item"])).alias("items"))
    hit = materialise(hit.where("n_hit > 0"), "hits")
    names = bounded(names)
    owned = hit.select("k_id", "k_key", F.explode("items").alias("item")).join(names, "item").groupBy("k_id", "k_key")
    owned = owned.agg(F.sum("copies").alias("n_items"), F.sort_array(F.flatten(F.collect_list(F.array_repeat(F.col("item_id").cast("string"), F.col("copies").cast("int"))))).alias("item_ids"))
    hit = hit.select("k_id", "k_key", "n_hit").join(owned.select(F.col("k_id").alias("o_id"), F.col("k_key").alias("o_key"), "n_items", "item_ids"), F.col("k_id").eqNullSafe(F.col("o_id")) & (F.col("k_key") == F.col("o_key"))).drop("o_id", "o_key")

    base = words.select("doc_id", "text_key", F.size(alnum_words(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(hit, base["doc_id"].eqNullSafe(hit["k_id"]) & (base["text_key"] == hit["k_key"]), "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "text_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ids.alias("items"),
        ((n_hit > 0) & (min_share_of * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """`scored` without the key."""
    return scored(docs, benchmark, **parameters).drop("text_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The documents that are not contaminated, in their columns."""
    bad = scored(docs, benchmark, **parameters).where("contaminated").select("doc_id", "text_key")
    return matching(docs, materialise(bad, "contaminated"), "left_anti")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")
