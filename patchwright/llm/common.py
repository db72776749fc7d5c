"""Shared pieces of the training-data operators: tables, shared storage, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import discard, materialise, new_path

__all__ = ["discard", "materialise", "new_path"]

# Separators of a word as the contracts write it, in Java's syntax.
ALNUM_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ALNUM_TRIM = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
SPACE_SEPARATOR = r"[\x20\x09-\x0D]+"
SPACE_TRIM = " \t\n\x0b\x0c\r"
#: A side of a join that is broadcast by hint has been counted to have no more rows than this.
BROADCAST_ROWS = 2_000_000
#: The same for rows of texts or arrays, by their bytes.
BROADCAST_BYTES = 64_000_000
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Rows hold whole texts: Arrow batches of BATCH_ROWS rows in place of Spark's default keep workers small. A value that was set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def text_key(text: Column | str = "text") -> Column:
    """With doc_id, the key of a document: rows equal in both have equal results, whatever else they hold."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, though the body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def alnum_words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, still in their own case; none for null."""
    return split_words(text, ALNUM_TRIM, ALNUM_SEPARATOR)


def space_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; none for null."""
    return split_words(text, SPACE_TRIM, SPACE_SEPARATOR)


def split_words(text: Column, trim: str, separator: str) -> Column:
    core = F.btrim(text, F.lit(trim))
    return F.when(core != "", F.split(core, separator)).otherwise(F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is: `lower` where the text is ASCII, else letter by letter."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """The frame with a broadcast hint if it is small, else left to a shuffle join.

    Small: no more rows than allowed (counting stops there); where rows hold texts or arrays, `weight`
    is a row's bytes, and their sum may be BROADCAST_BYTES at most."""
    if df.limit(rows + 1).count() > rows:
        return df
    if weight is not None and (df.agg(F.sum(weight)).first()[0] or 0) > BROADCAST_BYTES:
        return df
    return F.broadcast(df)


def apart(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the frame's columns in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def matching(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs semi- or anti-joined with keys (doc_id, text_key), nulls being equal; docs keep their columns, whatever their names."""
    k_id, k_key, own = apart(docs, "k_id", "k_key", "own_key")
    keys = bounded(keys.select(F.col("doc_id").alias(k_id), F.col("text_key").alias(k_key)))
    keyed = docs.withColumn(own, text_key("text"))
    return keyed.join(keys, F.col("doc_id").eqNullSafe(F.col(k_id)) & (F.col(own) == F.col(k_key)), how).select(*(F.col(f"`{c}`") for c in docs.columns))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b): (node, root), root the least node of the component.

    Contraction: in each round every node goes to the end of least hash among its neighbours and itself,
    the ends of all edges are replaced, equal edges and loops go. So the edge list shrinks by a share of
    its nodes a round, and a hub's edges meet in its one name. Hub keys are aggregated per task before the
    shuffle, and their joins are split by AQE. Each round is a written table: a lost executor costs one round.
    An edge list without rows gives none. Null ends and loops are dropped.
    """
    left = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    left = materialise(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps = []
    for k in range(rounds):
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        to = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("near"))
        to = materialise(to.select("node", F.least("near", rank("node"))["x"].alias("to")), "labels")
        one = left.join(to.withColumnRenamed("node", "a"), "a").select(F.col("to").alias("a"), "b")
        two = one.join(to.withColumnRenamed("node", "b"), "b").select("a", F.col("to").alias("b")).where("a <> b")
        smaller = materialise(two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        discard(left)
        left = smaller
        maps.append(to)
    else:
        raise RuntimeError("components: not settled, raise rounds")
    root = None
    for to in reversed(maps):  # a node of this round goes where its name of the next round goes
        if root is None:
            root = to.select("node", F.col("to").alias("root"))
        else:
            later = root.select(F.col("node").alias("to"), "root")
            root = materialise(to.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "roots")
    if root is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    least = root.groupBy("root").agg(F.least(F.min("node"), F.col("root")).alias("least"))
    return root.join(least, "root").select("node", F.col("least").alias("root"))
