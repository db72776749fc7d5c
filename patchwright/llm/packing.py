"""Best-fit packing: variable-capacity best-fit over several permitted sequence lengths.

Texts are measured in tokens by a rule any engine can apply (runs of letters and digits cost one
token per CHARS_PER_TOKEN characters, rounded up; every other non-blank character costs one). A text longer than the largest
capacity is cut into full pieces of it and a rest. Full pieces fill a sequence each; the other pieces are
dealt by hash into shards of about SHARD_TOKENS tokens, which pack on their own, so
no task grows with the input and a shard's loss repeats only that shard.

Inside a shard pieces go in falling length to the open bin with the least room left that holds
them. Where none does, a bin opens at the size of the least cost: for each permitted size the room that the
piece leaves is filled, longest first, from the lengths that the shard still has, and the cost is the price of the
smallest size that holds this filling, by filled token. So all sizes compete at every opening, by what they
could really hold. At last every bin is downsized to the smallest permitted length that holds its contents.
The price of a sequence is its length, or with `attention` length * (1 + length / attention), as
the work on a sequence has a part that grows with its square.

Defined cases: null or empty texts have no tokens and come out as one piece of length 0 in no bin;
equal lengths go by doc_id, then piece; repeated rows are separate pieces, dealt apart; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, materialise, table

CAPACITIES = (512, 1024, 2048, 4096)
SHARD_TOKENS, CHARS_PER_TOKEN = 4_000_000, 4
TOKEN = r"[\p{L}\p{N}]{1,%d}|[^\p{L}\p{N}\s]" % CHARS_PER_TOKEN


def tokens(text: Column) -> Column:
    """The number of tokens of a text, counted in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def price(size: int, attention: float | None = None) -> float:
    """The cost of a sequence of this length."""
    return size * (1 + size / attention) if attention else float(size)


class Lengths:
    """The lengths that are still to be placed, as counts and as the bits of one number."""

    def __init__(self, lengths: Sequence[int]) -> None:
        self.count = Counter(lengths)
        self.bits = sum(1 << n for n in self.count)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.bits ^= 1 << n

    def filling(self, room: int) -> int:
        """How much of the room they fill, longest first."""
        left, bits = room, self.bits
        while left and (n := (bits & ((2 << left) - 1)).bit_length() - 1) > 0:
            left -= n * min(left // n, self.count[n])
            bits &= (1 << n) - 1
        return room - left


def pack(lengths: Sequence[int], capacities: Sequence[int], attention: float | None = None) -> list[tuple[int, int, int]]:
    """(bin, offset, capacity) for each length, given in falling order, each at least 1 and at most the largest capacity."""
    sizes = sorted(capacities)
    rest = Lengths(lengths)
    room: list[tuple[int, int]] = []  # (left, bin), sorted: the open bins with room
    fill: list[int] = []
    place: list[tuple[int, int]] = []

    def fitting(n: int) -> int:
        return sizes[bisect_left(sizes, n)]

    def cost(size: int, n: int) -> tuple[float, int]:
        held = n + rest.filling(size - n)
        return price(fitting(held), attention) / held, -size

    for n in lengths:
        rest.take(n)
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = min((c for c in sizes if c >= n), key=lambda c: cost(c, n)), len(fill)  # noqa: B023
            fill.append(0)
        place.append((b, fill[b]))
        fill[b] += n
        if left > n:
            insort(room, (left - n, b))
    return [(b, o, fitting(fill[b])) for b, o in place]


def pieces(docs: DataFrame, largest: int) -> DataFrame:
    """(doc_id, piece, start, length, text): a text in pieces of at most `largest` tokens; one of length 0 where there are none.

    start and length count tokens. A piece's text begins behind the last token of the piece before it, blanks included; joined
    they are the text. Only longer texts are cut into tokens. A null text is one piece of a null text."""
    lengths = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", tokens(F.col("text")).alias("n"))
    words = F.concat(F.regexp_extract_all("text", F.lit(rf"\s*(?:{TOKEN})"), F.lit(0)), F.array(F.regexp_extract("text", r"\s*\z", 0)))
    last = F.ceil(F.col("n") / largest).cast("int") - 1

    def cut(w: Column) -> Column:
        def one(i: Column) -> Column:
            size = F.when(i < last, F.lit(largest)).otherwise(F.size(w) - i * largest)
            return F.struct(i.cast("bigint").alias("piece"), F.array_join(F.slice(w, i * largest + 1, size), "").alias("text"))

        return F.transform(F.sequence(F.lit(0), last), one)

    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("piece"), F.col("text")))
    out = lengths.select("doc_id", "n", F.explode(F.when(F.col("n") > largest, bind(words, cut)).otherwise(whole)).alias("x"))
    start = F.col("x.piece") * largest
    return out.select("doc_id", "x.piece", start.alias("start"), F.least(F.lit(largest).cast("bigint"), F.col("n") - start).alias("length"), "x.text")


def packed(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, shard_tokens: int = SHARD_TOKENS, attention: float | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, text, bin, offset, capacity.

    Only lengths are dealt to shards and packed; the texts are joined to the places. Equal rows are counted and told
    apart by number, so bins do not depend on how the rows are partitioned."""
    largest = max(capacities)
    own = (F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("own"), "piece", F.xxhash64("doc_id", "text").alias("key"))
    # written, as texts are counted once so
    cut = materialise(pieces(docs, largest).select("*", own[0], own[2]), "pieces")
    same = ["own", "piece", "key"]
    counted = cut.groupBy(*same).agg(F.first("doc_id").alias("doc_id"), F.first("length").alias("length"), F.count(F.lit(1)).alias("n"))
    each = counted.select("doc_id", *same, "length", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("number"))
    total = cut.where(F.col("length") < largest).agg(F.sum("length")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    schema = "own bigint, piece bigint, key bigint, length bigint, number bigint, bin string, offset bigint, capacity int"

    def run(key, rows):
        rows = rows.drop_columns(["shard"]).sort_by([("length", "descending"), ("own", "ascending"), ("piece", "ascending"), ("key", "ascending"), ("number", "ascending")])
        put = pack(rows.column("length").to_pylist(), capacities, attention)
        out = [pa.array([f"{key[0].as_py()}-{b}" for b, _, _ in put], pa.string()), pa.array([o for _, o, _ in put], pa.int64()), pa.array([c for _, _, c in put], pa.int32())]
        return pa.table([*rows.columns, *out], names=[*rows.column_names, "bin", "offset", "capacity"])

    loose = each.where((F.col("length") > 0) & (F.col("length") < largest)).drop("doc_id")
    some = loose.withColumn("shard", F.pmod(F.xxhash64(*same, "number"), F.lit(shards))).groupBy("shard").applyInArrow(run, schema)
    name = F.concat_ws("-", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "piece", F.hex("key"), "number")
    places = [F.when(F.col("length") > 0, x).alias(c) for c, x in (("bin", name), ("offset", F.lit(0).cast("bigint")), ("capacity", F.lit(largest)))]
    alone = each.where((F.col("length") >= largest) | (F.col("length") <= 0))  # a bin of its own, or none
    placed = some.unionByName(alone.select("*", *places).drop("doc_id")).drop("length", "number")
    texts = cut.groupBy(*same).agg(*(F.first(c).alias(c) for c in ("doc_id", "start", "length", "text")))
    return texts.join(placed, same).select("doc_id", "piece", "start", "length", "text", "bin", "offset", "capacity")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces, with the code points of each in place of its text."""
    out = packed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", F.length("text").cast("bigint").alias("n_chars"), "bin", "offset", "capacity")
