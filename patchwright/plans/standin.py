"""The stand-in data set: an order is a patch, its lineitems are pixels, its part types are labels,
its nation is the tile and its region the country. Each frame has an SQL twin for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import seeded_int
from ..operators import splits
from ..sources.storage import materialise

SEED = 42
BANDS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """(patch_id, class), each once."""
    part = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("class"))
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("patch_id"), "l_partkey")
    return items.join(part, items["l_partkey"] == part["p_partkey"]).select("patch_id", "class").distinct()


def places(spark: SparkSession, sf: str) -> DataFrame:
    """(patch_id, tile, country, s2_split, taken) of every order."""
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("tile"), F.col("r_name").alias("country"))
    customer = table(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "tile", "country")  # nations of the world
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("patch_id"), "o_custkey", F.col("o_orderdate").alias("taken"))
    official = F.when(F.col("patch_id") % 4 < 2, "train").when(F.col("patch_id") % 4 == 2, "validation").otherwise("test")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select("patch_id", "tile", "country", official.alias("s2_split"), "taken")


def patches(spark: SparkSession, sf: str) -> DataFrame:
    """The places that have pixels."""
    has = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("patch_id"))
    return places(spark, sf).join(has, "patch_id", "left_semi")


def split(spark: SparkSession, sf: str) -> DataFrame:
    """The patches under all four regimes. The patches are written once; sizes, ranks and joins read them again."""
    return split_of(materialise(patches(spark, sf), "patches"))


def split_of(p: DataFrame) -> DataFrame:
    """Written patches under all four regimes."""
    return splits.leave_tile_out(p, 5).join(splits.exact_random(p, SEED), "patch_id").withColumn("s4_fold", F.col("country"))


#: Classes a word of label bits holds.
WORD = 62


def label_bits(spark: SparkSession, sf: str, classes: list[str]) -> DataFrame:
    """(patch_id, _bits0, ...): a patch's classes as bits, in the order of `classes`. No row a label is shuffled, and none is made distinct."""
    at = F.array_position(F.array(*map(F.lit, classes)), F.col("p_type")).cast("int") - 1
    words = range(-(-len(classes) // WORD))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_at") % WORD)
    part = table(spark, sf, "part").select("p_partkey", at.alias("_at")).select("p_partkey", *(F.when((F.col("_at") / WORD).cast("int") == w, bit).alias(f"_bits{w}") for w in words))
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("patch_id"), "l_partkey")
    return items.join(part, items["l_partkey"] == part["p_partkey"]).groupBy("patch_id").agg(*(F.bit_or(f"_bits{w}").alias(f"_bits{w}") for w in words))


def has_bit(i: int):
    """1 if class i is among a patch's label_bits, else 0 (also without any)."""
    own = F.coalesce(F.col(f"_bits{i // WORD}"), F.lit(0).cast("bigint"))
    return (own.bitwiseAND(F.lit(1 << i % WORD).cast("bigint")) != 0).cast("int")


def label_cells(spark: SparkSession, sf: str, of: DataFrame) -> DataFrame:
    """(all columns of `of`, class, label 0 or 1): every patch with every class.

    A patch is joined to its own classes as one list; its cells are made afterwards, so no join or shuffle carries a row a cell."""
    lab = labels(spark, sf)
    every = lab.agg(F.collect_set("class").alias("_every"))  # class names only
    own = lab.groupBy("patch_id").agg(F.collect_set("class").alias("_own"))
    listed = of.join(own, "patch_id", "left").crossJoin(F.broadcast(every))
    cells = listed.select(*of.columns, "_own", F.explode("_every").alias("class"))
    return cells.select(*of.columns, "class", F.coalesce(F.array_contains("_own", F.col("class")), F.lit(False)).cast("int").alias("label"))


def predictions(spark: SparkSession, sf: str, of: DataFrame) -> DataFrame:
    """label_cells with true_label and an integer score in 0..999 that leans to the label."""
    score = F.col("label") * 250 + seeded_int("score", F.col("patch_id"), F.col("class")) % 750
    return label_cells(spark, sf, of).withColumn("score", score).withColumnRenamed("label", "true_label")


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    """(patch_id, tile, country, regime, fold, class, true_label, score) of all test cells of all regimes, from one pass.

    A patch carries the regimes that test it as a list until its cells are scored."""
    p = split(spark, sf)
    tests = F.filter(splits.roles_list(), lambda r: r["role"] == "test")
    cells = predictions(spark, sf, p.select("patch_id", "tile", "country", tests.alias("_tests")))
    out = cells.select("patch_id", "tile", "country", "class", "true_label", "score", F.explode("_tests").alias("_test"))
    return out.select("patch_id", "tile", "country", "class", "true_label", "score", F.col("_test.regime").alias("regime"), F.col("_test.fold").alias("fold"))


SQL = """
WITH RECURSIVE
lab AS (SELECT DISTINCT l_orderkey AS patch_id, p_type AS class FROM lineitem JOIN part ON l_partkey = p_partkey),
place AS (SELECT o_orderkey AS patch_id, n_name AS tile, r_name AS country, o_orderdate AS taken,
  CASE WHEN o_orderkey % 4 < 2 THEN 'train' WHEN o_orderkey % 4 = 2 THEN 'validation' ELSE 'test' END AS s2_split
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
patch AS (SELECT * FROM place WHERE patch_id IN (SELECT l_orderkey FROM lineitem)),
s1 AS (SELECT patch_id, CASE WHEN r <= round_even(n * 0.5, 0) THEN 'train' WHEN r <= round_even(n * 0.5, 0) + round_even(n * 0.25, 0) THEN 'validation' ELSE 'test' END AS s1_split
  FROM (SELECT patch_id, row_number() OVER (ORDER BY md5('42:' || patch_id), patch_id) AS r, count(*) OVER () AS n FROM patch)),
tile AS (SELECT tile, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, tile) AS i FROM patch GROUP BY tile),
lpt AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS load, NULL::VARCHAR AS tile, 0::BIGINT AS fold, 0::BIGINT AS n
  UNION ALL SELECT i, [load[1] + CASE WHEN f = 1 THEN m ELSE 0 END, load[2] + CASE WHEN f = 2 THEN m ELSE 0 END, load[3] + CASE WHEN f = 3 THEN m ELSE 0 END, load[4] + CASE WHEN f = 4 THEN m ELSE 0 END, load[5] + CASE WHEN f = 5 THEN m ELSE 0 END]::BIGINT[], tile, (f - 1)::BIGINT, m
  FROM (SELECT t.i, l.load, t.tile, t.n AS m, list_position(l.load, list_min(l.load)) AS f FROM lpt l JOIN tile t ON t.i = l.i + 1)),
split AS (SELECT p.*, s1_split, l.fold AS s3_fold, country AS s4_fold FROM patch p JOIN s1 USING (patch_id) JOIN lpt l ON l.tile = p.tile),
cls AS (SELECT DISTINCT class FROM lab),
pred AS (SELECT p.*, c.class, (l.class IS NOT NULL)::INT AS true_label,
  (l.class IS NOT NULL)::INT * 250 + ('0x' || substr(md5('score:' || p.patch_id || ':' || c.class), 1, 8))::BIGINT % 750 AS score
  FROM split p CROSS JOIN cls c LEFT JOIN lab l ON l.patch_id = p.patch_id AND l.class = c.class),
ev AS (SELECT patch_id, tile, country, 's1' AS regime, 'all' AS fold, class, true_label, score FROM pred WHERE s1_split = 'test'
  UNION ALL SELECT patch_id, tile, country, 's2', 'all', class, true_label, score FROM pred WHERE s2_split = 'test'
  UNION ALL SELECT patch_id, tile, country, 's3', s3_fold::VARCHAR, class, true_label, score FROM pred
  UNION ALL SELECT patch_id, tile, country, 's4', s4_fold, class, true_label, score FROM pred)
"""


def ranking_sql(source: str, keys: str, name: str = "cell") -> str:
    """CTEs that end in `name` (keys, n, n_pos, ap, auroc)."""
    return f""", {name}_c AS (SELECT {keys}, score, sum(true_label) AS pos, count(*) AS n FROM {source} GROUP BY {keys}, score),
{name}_k AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k FROM {name}_c WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
{name} AS (SELECT {keys}, sum(n)::BIGINT AS n, sum(pos)::BIGINT AS n_pos, sum(pos * (tp::DOUBLE / k)) / nullif(sum(pos), 0)::DOUBLE AS ap,
  sum((n - pos) * (tp - pos / 2.0::DOUBLE)) / nullif(sum(pos)::DOUBLE * (sum(n) - sum(pos)), 0) AS auroc FROM {name}_k GROUP BY {keys})
"""
