"""Quality rules [native]: cross-document line frequency over hashed normalised lines.

A line is normalised (lower case, digits as 0, outer white space off) and hashed to 64 bits. For
each host (here `source`) the distinct documents that hold it are counted; a document is a row's doc_id,
host and text, so copies under other ids count and repeated rows do not. A line is removed where more than
MIN_DOCS documents of the host hold it, or more than ANY_HOST over all hosts. The limits are numbers of
documents and do not rise with the host. A document is rejected as depleted if under MIN_LEFT of its line characters stay.

Defined cases: null or empty text has no words, fails the base and is not kept; a null host is a
host of its own; repeated rows come back as often as they came; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, materialise, space_words, table, text_key

MIN_DOCS, ANY_HOST, MIN_LEFT = 5, 20, 0.5
BLANKS = " \t\x0b\x0c\r"
COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "line_chars", "removed_chars", "depleted", "kept")


def lines_of(text: Column) -> Column:
    """The lines with anything but white space, trimmed."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


def hashed(line: Column) -> Column:
    return F.xxhash64(F.regexp_replace(F.lower(line), "[0-9]", "0"))


def worded(text: Column) -> Column:
    """The lines with a word, as they are."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows found twice or more in the text, the first included.

    Windows are compared by 64-bit hashes of three words. Only texts with a repeated window sort them."""
    def covered(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        twice = bind(pairs, lambda p: F.filter(p, lambda x, k: F.coalesce(F.get(p, k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(p, k + 1)["g"] == x["g"], F.lit(False))))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    def from_words(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return bind(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(0))

    return F.when(F.size(words) >= 4, bind(words, from_words)).otherwise(0).cast("long")


def base_rules(docs: DataFrame) -> DataFrame:
    """The document-level counts and base_failed; map side only."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", "source", text_key("text").alias("text_key"), F.col("text").alias("raw"), text.alias("text"), space_words(text).alias("words"))
    out = out.select(
        "doc_id",
        "source",
        "text_key",
        "raw",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        bind(worded(F.col("text")), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.aggregate(lines_of(F.col("text")), F.lit(0), lambda n, x: n + F.length(x)).cast("long").alias("line_chars"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, any_host: int = ANY_HOST) -> DataFrame:
    """(source, line, n_docs) of the lines above a limit. Counts merge per task before each shuffle."""
    keyed = docs.select("source", F.xxhash64("doc_id", text_key("text")).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    lines = keyed.select("source", "doc", F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), hashed))).alias("line"))
    every = materialise(lines.groupBy("source", "line").agg(F.count_distinct("doc").alias("n_docs")), "line-counts")
    wide = every.groupBy("line").agg(F.sum("n_docs").alias("all_docs")).where(F.col("all_docs") > any_host).select("line", F.lit(True).alias("wide"))
    return every.join(wide, "line", "left").where((F.col("n_docs") > min_docs) | F.col("wide")).select("source", "line", "n_docs")


def apply_rules(docs: DataFrame, min_docs: int = MIN_DOCS, any_host: int = ANY_HOST, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per document: base counts, line_chars, removed_chars, depleted, kept, and text without its frequent lines (null stays null)."""
    frequent = materialise(frequent_lines(docs, min_docs, any_host), "frequent-lines").withColumnRenamed("source", "host")
    lines = docs.select("doc_id", "source", text_key("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    core = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.btrim(x, F.lit(BLANKS)).alias("core"), i.alias("at"))), lambda x: x["core"] != "")
    lines = lines.select("doc_id", "source", "text_key", F.explode(F.transform(core, lambda x: F.struct(x["at"].alias("at"), hashed(x["core"]).alias("line"), F.length(x["core"]).alias("chars")))).alias("x"))
    lines = lines.select("doc_id", "source", "text_key", "x.at", "x.line", "x.chars")
    hit = lines.join(frequent, (lines["line"] == frequent["line"]) & lines["source"].eqNullSafe(frequent["host"]))
    # repeated rows bring the same lines at the same places: each place counts once, and texts need no shuffle
    hit = hit.groupBy("doc_id", "source", "text_key", "at").agg(F.first("chars").alias("chars"))
    removed = hit.groupBy("doc_id", "source", "text_key").agg(F.sum("chars").alias("removed_chars"), F.collect_list("at").alias("places"))
    removed = removed.select(*(F.col(c).alias(f"r_{c}") for c in ("doc_id", "source", "text_key")), "removed_chars", "places")
    base = base_rules(docs)
    same = [base[c].eqNullSafe(removed[f"r_{c}"]) for c in ("doc_id", "source", "text_key")]
    out = base.join(removed, same[0] & same[1] & same[2], "left")
    removed_chars = F.coalesce("removed_chars", F.lit(0)).cast("long")
    out = out.withColumn("removed_chars", removed_chars).withColumn("depleted", F.col("removed_chars") > (1 - min_left) * F.col("line_chars"))
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    return out.select(*COLUMNS, F.when(F.col("places").isNull(), F.col("raw")).otherwise(without(F.coalesce("raw", F.lit("")), F.col("places"))).alias("text"))


def without(text: Column, places: Column) -> Column:
    """The text without the lines at these places; the others in order, blank ones too."""
    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    return bind(F.split(text, "\n"), rest)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).select(*COLUMNS)
