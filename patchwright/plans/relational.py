"""Queries: ids, labels, splits, audits, gates, features, textures, the older path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, ids, raster
from ..functions import labels as label_functions
from ..functions.spectral import indices, safe_div
from ..operators import features, legacy, quality, sampling, splits
from ..schema import unknown_classes
from . import standin
from .registry import query, rounded
from .standin import BANDS, SEED, SQL, table


def scene_ids(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    scene = F.concat(F.lit("S2"), F.when(k % 2 == 0, "A").otherwise("B"), F.lit("_MSIL2A_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T101031_N"), pad(k % 10000, 4), F.lit("_R"), pad(k % 143, 3), F.lit("_T"), pad(k % 61, 2), F.lit("UUP_"), (k % 100).cast("string"), F.lit("_"), (k % 77).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", scene.alias("scene"))


SCENES = """WITH scene AS (SELECT o_orderkey, 'S2' || CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END || '_MSIL2A_' || strftime(o_orderdate, '%Y%m%d') || 'T101031_N' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0')
  || '_R' || lpad((o_orderkey % 143)::VARCHAR, 3, '0') || '_T' || lpad((o_orderkey % 61)::VARCHAR, 2, '0') || 'UUP_' || (o_orderkey % 100) || '_' || (o_orderkey % 77) AS scene FROM orders)
"""


@query(SCENES + "SELECT o_orderkey, scene, 'T' || lpad((o_orderkey % 61)::VARCHAR, 2, '0') || 'UUP' AS tile, o_orderkey % 100 AS gx, o_orderkey % 77 AS gy, split_part(scene, '_', 3)[1:4]::BIGINT AS year, split_part(scene, '_', 3)[5:6]::BIGINT AS month FROM scene")
def parse_scene_id(spark, sf):
    return scene_ids(spark, sf).withColumn("p", ids.parse_scene_id(F.col("scene"))).select("o_orderkey", "scene", "p.tile", "p.gx", "p.gy", "p.year", "p.month")


@query(SCENES + "SELECT o_orderkey, regexp_replace(scene, '_[^_]*_[^_]*$', '') AS folder FROM scene")
def folder_name(spark, sf):
    return scene_ids(spark, sf).select("o_orderkey", ids.folder_name(F.col("scene")).alias("folder"))


@query(SCENES + ", m AS (SELECT unnest(['B02', 'B8A', 'B11']) AS band) SELECT 'top/' || regexp_replace(scene, '_[^_]*_[^_]*$', '') || '/' || scene || '/' || scene || '_' || band || '.tif' AS path, 4 AS depth, 'top' AS top, regexp_replace(scene, '_[^_]*_[^_]*$', '') AS folder, scene AS patch, band, '.tif' AS extension, band = 'B8A' AS is_wanted FROM scene, m")
def member_paths(spark, sf):
    s = scene_ids(spark, sf).select("scene", F.explode(F.array(F.lit("B02"), F.lit("B8A"), F.lit("B11"))).alias("b"))
    s = s.select(F.concat_ws("/", F.lit("top"), ids.folder_name(F.col("scene")), "scene", F.concat("scene", F.lit("_"), "b", F.lit(".tif"))).alias("path"))
    return s.select("path", ids.path_parts(F.col("path")).alias("p"), ids.has_suffix(F.col("path"), ["_B8A.tif"]).alias("is_wanted")).select("path", "p.*", "is_wanted")


@query("SELECT l_orderkey AS patch_id, " + ", ".join(f"max((p_type = (SELECT t FROM (SELECT p_type AS t, row_number() OVER (ORDER BY p_type) AS i FROM (SELECT DISTINCT p_type FROM part)) WHERE i = {i + 1}))::INT) AS lbl_{i:02d}" for i in range(6)) + " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def multi_hot_labels(spark, sf):
    classes = [r[0] for r in table(spark, sf, "part").select("p_type").distinct().orderBy("p_type").collect()]  # the class vocabulary
    lists = standin.labels(spark, sf).groupBy("patch_id").agg(F.collect_set("class").alias("labels"))
    return lists.select("patch_id", *label_functions.multi_hot(F.col("labels"), classes))


@query(SQL + "SELECT class, count(*) AS n, round(count(*) / (SELECT count(DISTINCT patch_id) FROM lab)::DOUBLE, 6) AS prevalence FROM lab GROUP BY class")
def label_prevalence(spark, sf):
    lists = standin.labels(spark, sf).groupBy("patch_id").agg(F.collect_set("class").alias("labels"))
    total = lists.agg(F.count("*").alias("total"))
    n = lists.select(F.explode("labels").alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    return rounded(n.crossJoin(F.broadcast(total)).select("class", "n", (F.col("n") / F.col("total")).alias("prevalence")))


@query(SQL + "SELECT n_labels, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM (SELECT patch_id, count(*) AS n_labels FROM lab GROUP BY 1) GROUP BY 1")
def label_cardinality(spark, sf):
    return rounded(splits.shares(standin.labels(spark, sf).groupBy("patch_id").agg(F.count("*").alias("n_labels")), ["n_labels"]))


@query("""WITH a AS (SELECT l_orderkey AS patch_id, p_type AS class, sum(l_quantity) AS area FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT patch_id, class AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY area DESC, class) AS r FROM a) WHERE r = 1""")
def dominant_label(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    areas = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", "p_type").agg(F.sum("l_quantity").alias("area"))
    maps = areas.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "area"))).alias("areas"))
    return maps.select(F.col("l_orderkey").alias("patch_id"), label_functions.dominant_label(F.array().cast("array<string>"), F.col("areas")).alias("dominant"))


@query(SQL + "SELECT patch_id, count(*) AS n_labels, min(class) AS first_label FROM lab GROUP BY 1 UNION ALL SELECT -1, NULL, 'Unknown'")
def json_labels(spark, sf):
    text = standin.labels(spark, sf).groupBy("patch_id").agg(F.to_json(F.array_sort(F.collect_set("class"))).alias("text"))
    text = text.unionByName(spark.createDataFrame([(-1, "no list")], "patch_id bigint, text string"))
    parsed = text.select("patch_id", label_functions.parse_labels(F.col("text")).alias("labels"))
    return parsed.select("patch_id", F.when(F.col("labels").isNotNull(), F.size("labels").cast("bigint")).alias("n_labels"), label_functions.dominant_label(F.col("labels")).alias("first_label"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_field(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").groupBy("event_type", (k % 10).alias("k")).agg(F.count("*").alias("n"))


def _stats_sql(c: str) -> str:
    q = lambda p: f"quantile_cont({c}, {p})"
    return f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std, round({q(0.1)}, 6) AS {c}_p10, round({q(0.5)}, 6) AS {c}_p50, round({q(0.9)}, 6) AS {c}_p90, round({q(0.75)} - {q(0.25)}, 6) AS {c}_iqr"


@query(f"SELECT l_orderkey AS patch_id, {', '.join(_stats_sql(c) for c in BANDS)} FROM lineitem GROUP BY 1")
def band_stats(spark, sf):
    pixels = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("patch_id"), *BANDS)
    return rounded(pixels.groupBy("patch_id").agg(*(s for c in BANDS for s in features.band_statistics(c, F.col(c)))))


BAND_COLUMNS = {"B02": "l_quantity", "B03": "l_quantity * 7 + 100", "B04": "l_tax * 1000 + 50", "B05": "l_quantity + 200", "B06": "l_linenumber * 10 + 300", "B07": "l_quantity * 3 + 150", "B08": "l_discount * 2000 + 400", "B11": "l_linenumber * 40 + 90", "B12": "l_quantity * 2 + l_linenumber"}


def _index_sql(columns: dict[str, str] = BAND_COLUMNS) -> str:
    b = {k: f"({v})::DOUBLE" for k, v in columns.items()}
    g = lambda num, den: f"(({num}) / CASE WHEN abs({den}) < 1e-6 THEN 1e-6 ELSE ({den}) END)"
    nd = lambda x, y: g(f"{b[x]} - {b[y]}", f"{b[x]} + {b[y]}")
    out = {"NDVI": nd("B08", "B04"), "NDWI": nd("B03", "B08"), "MNDWI": nd("B03", "B11"), "NDMI": nd("B08", "B11"), "NDBI": nd("B11", "B08"), "NBR": nd("B08", "B12"), "NDRE1": nd("B08", "B05"), "NDRE2": nd("B08", "B06"), "NDRE3": nd("B08", "B07")}
    out["EVI"] = "2.5::DOUBLE * " + g(f"{b['B08']} - {b['B04']}", f"{b['B08']} + 6 * {b['B04']} - 7.5::DOUBLE * {b['B02']} + 1")
    out["SAVI"] = "1.5::DOUBLE * " + g(f"{b['B08']} - {b['B04']}", f"{b['B08']} + {b['B04']} + 0.5::DOUBLE")
    out["BSI"] = g(f"({b['B11']} + {b['B04']}) - ({b['B08']} + {b['B02']})", f"({b['B11']} + {b['B04']}) + ({b['B08']} + {b['B02']})")
    out["CIre"] = g(b["B07"], b["B05"]) + " - 1"
    return ", ".join(f"round(avg({e}), 6) AS {n}_mean, round(stddev_pop({e}), 6) AS {n}_std" for n, e in out.items())


@query("SELECT l_returnflag, l_linestatus, " + _index_sql() + " FROM lineitem GROUP BY 1, 2")
def spectral_indices(spark, sf):
    bands = {k: F.expr(v) for k, v in BAND_COLUMNS.items()}
    cells = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", *(c.alias(n) for n, c in indices(bands).items()))
    names = [c for c in cells.columns if not c.startswith("l_")]
    return rounded(cells.groupBy("l_returnflag", "l_linestatus").agg(*(s for n in names for s in features.index_statistics(n, F.col(n)))))


@query("SELECT i, round(1.0::DOUBLE / CASE WHEN abs(d) < 1e-6 THEN 1e-6 ELSE d END, 6) AS q FROM (VALUES (0, 0.0::DOUBLE), (1, -1e-9::DOUBLE), (2, 1e-9::DOUBLE), (3, -2.0::DOUBLE), (4, 4.0::DOUBLE)) t(i, d)")
def safe_div_edge(spark, sf):
    cases = spark.createDataFrame([(0, 0.0), (1, -1e-9), (2, 1e-9), (3, -2.0), (4, 4.0)], "i int, d double")
    return rounded(cases.select("i", safe_div(F.lit(1.0), F.col("d")).alias("q")))


@query(SQL + "SELECT patch_id, s1_split FROM s1")
def split_random_exact(spark, sf):
    return splits.exact_random(standin.patches(spark, sf), SEED)


@query(SQL + "".join(f", r{k} AS (SELECT patch_id, CASE WHEN r <= round_even(n * 0.5, 0) THEN 'train' WHEN r <= round_even(n * 0.5, 0) + round_even(n * 0.25, 0) THEN 'validation' ELSE 'test' END AS s1_split_seed{k} FROM (SELECT patch_id, row_number() OVER (ORDER BY md5('{k}:' || patch_id), patch_id) AS r, count(*) OVER () AS n FROM patch))" for k in (123, 7)) + " SELECT patch_id, s1_split, s2_split, s3_fold, s4_fold, s1_split_seed123, s1_split_seed7 FROM split JOIN r123 USING (patch_id) JOIN r7 USING (patch_id)")
def split_table(spark, sf):
    """All regimes of every patch, with the random cut under two further seeds."""
    p = standin.patches(spark, sf)
    out = standin.split(spark, sf).select("patch_id", "s1_split", "s2_split", "s3_fold", "s4_fold")
    for seed in (123, 7):
        out = out.join(splits.exact_random(p, seed, f"s1_split_seed{seed}"), "patch_id")
    return out


@query(SQL + "SELECT s2_split, count(*) AS n, round(count(*) / (SELECT count(*) FROM patch)::DOUBLE, 6) AS share FROM patch GROUP BY 1")
def split_official(spark, sf):
    return rounded(splits.shares(standin.patches(spark, sf), ["s2_split"]))


@query(SQL + "SELECT patch_id, CASE WHEN country = 'ASIA' THEN 'test' ELSE 'train' END AS role FROM patch")
def split_leave_country(spark, sf):
    return standin.patches(spark, sf).withColumn("s4_fold", F.col("country")).select("patch_id", label_functions.role("s4", "ASIA").alias("role"))


@query(SQL + "SELECT tile, fold, n FROM lpt WHERE tile IS NOT NULL")
def split_leave_tile_lpt(spark, sf):
    return splits.lpt_folds(standin.patches(spark, sf).groupBy("tile").agg(F.count("*").alias("n")), "tile", "n", 5)


@query(SQL + "SELECT (SELECT count(*) FROM (SELECT patch_id FROM s1 GROUP BY 1 HAVING count(DISTINCT s1_split) > 1)) AS n_overlap, (SELECT count(*) FROM patch WHERE patch_id NOT IN (SELECT patch_id FROM s1)) AS n_missing, (SELECT count(DISTINCT patch_id) FROM s1 WHERE patch_id NOT IN (SELECT patch_id FROM patch)) AS n_foreign")
def split_validity(spark, sf):
    p = standin.patches(spark, sf)
    return splits.validity(splits.exact_random(p, SEED, "role"), p)


@query(SQL + "SELECT s3_fold, class, sum(true_label)::BIGINT AS test_pos, (sum(sum(true_label)) OVER (PARTITION BY class) - sum(true_label))::BIGINT AS train_pos FROM pred GROUP BY 1, 2")
def coverage_audit(spark, sf):
    return splits.fold_positives(standin.label_cells(spark, sf, standin.split(spark, sf)), "s3_fold")


@query(SQL + "SELECT class, count(*) AS n_pos, count(DISTINCT s3_fold) AS n_folds FROM pred WHERE true_label = 1 GROUP BY 1 ORDER BY 2, 1 LIMIT 3")
def rare_class_spread(spark, sf):
    return splits.fold_spread(standin.label_cells(spark, sf, standin.split(spark, sf)), "s3_fold", 3)


@query(SQL + """SELECT 's1' AS regime, s1_split AS part, count(*) AS n, count(DISTINCT tile) AS n_tiles FROM split GROUP BY 2 UNION ALL SELECT 's2', s2_split, count(*), count(DISTINCT tile) FROM split GROUP BY 2
UNION ALL SELECT 's3', s3_fold::VARCHAR, count(*), count(DISTINCT tile) FROM split GROUP BY 2 UNION ALL SELECT 's4', s4_fold, count(*), count(DISTINCT tile) FROM split GROUP BY 2""")
def split_stats(spark, sf):
    parts = F.array(*(F.struct(F.lit(r).alias("regime"), F.col(c).cast("string").alias("part")) for r, c in (("s1", "s1_split"), ("s2", "s2_split"), ("s3", "s3_fold"), ("s4", "s4_fold"))))
    return standin.split(spark, sf).select("tile", F.inline(parts)).groupBy("regime", "part").agg(F.count("*").alias("n"), F.count_distinct("tile").alias("n_tiles"))


@query(SQL + "SELECT patch_id, tile FROM patch WHERE country = 'EUROPE'")
def semi_join_region(spark, sf):
    p = standin.patches(spark, sf)
    return p.select("patch_id", "tile").join(p.where("country = 'EUROPE'").select("patch_id"), "patch_id", "left_semi")


@query(SQL + "SELECT patch_id, tile FROM place WHERE patch_id NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_join_missing(spark, sf):
    has = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("patch_id"))
    return standin.places(spark, sf).select("patch_id", "tile").join(has, "patch_id", "left_anti")


@query("SELECT (SELECT count(*) FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS n_both, (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS n_left_only, (SELECT count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)) AS n_right_only")
def set_reconcile(spark, sf):
    return quality.reconcile(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("SELECT 'LEAD ORE' AS class, 'vocabulary' AS side UNION ALL SELECT max(p_type), 'data' FROM part")
def unknown_labels(spark, sf):
    names = [r[0] for r in table(spark, sf, "part").select("p_type").distinct().orderBy("p_type").collect()]  # the class vocabulary
    lists = standin.labels(spark, sf).groupBy("patch_id").agg(F.collect_list("class").alias("labels"))
    return unknown_classes(lists, "labels", [*names[:-1], "LEAD ORE"])


@query(SQL + "SELECT n, w.class, round(CASE WHEN pos > 0 THEN n / (2.0::DOUBLE * pos) ELSE 1 END, 6) AS w_pos, round(CASE WHEN n > pos THEN n / (2.0::DOUBLE * (n - pos)) ELSE 1 END, 6) AS w_neg FROM (SELECT class, count(*) AS n, sum(true_label) AS pos FROM pred WHERE s2_split = 'train' GROUP BY 1) w")
def class_weights(spark, sf):
    cells = standin.label_cells(spark, sf, standin.patches(spark, sf)).where("s2_split = 'train'")
    counts = cells.groupBy("class").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    w = lambda y: label_functions.class_weight(F.lit(y), F.col("n"), F.col("pos"))
    return rounded(counts.select("n", "class", w(1).alias("w_pos"), w(0).alias("w_neg")))


@query(SQL + """, half AS (SELECT * FROM lab WHERE ('0x' || substr(md5('42:' || patch_id), 1, 8))::BIGINT % 2 = 0), rates AS (SELECT h, w FROM (SELECT class, count(*) / (SELECT count(DISTINCT patch_id) FROM half)::DOUBLE AS h FROM half GROUP BY 1) FULL JOIN (SELECT class, count(*) / (SELECT count(DISTINCT patch_id) FROM lab)::DOUBLE AS w FROM lab GROUP BY 1) USING (class))
SELECT * FROM (SELECT 'unique_ids' AS check, (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders) AS passed UNION ALL SELECT 'all_joined', (SELECT count(*) = 0 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'finite', (SELECT count(*) = 0 FROM lineitem WHERE l_tax IS NULL OR isnan(l_tax) OR isinf(l_tax)) UNION ALL SELECT 'rates_close', (SELECT max(abs(coalesce(h, 0) - coalesce(w, 0))) < 0.05 FROM rates) UNION ALL SELECT 'returned_dearer', (SELECT avg(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) > avg(CASE WHEN l_returnflag = 'N' THEN l_tax END) FROM lineitem))
UNION ALL SELECT 'all', (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders) AND (SELECT count(*) = 0 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AND (SELECT max(abs(coalesce(h, 0) - coalesce(w, 0))) < 0.05 FROM rates)""")
def quality_gate(spark, sf):
    orders, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    lab = standin.labels(spark, sf)
    rate = lambda x: x.groupBy("class").agg(F.count("*").alias("n")).crossJoin(F.broadcast(x.agg(F.count_distinct("patch_id").alias("all")))).select("class", (F.col("n") / F.col("all")).alias("rate"))
    half = lab.where(hashing.seeded_int(SEED, F.col("patch_id")) % 2 == 0)
    when = lambda f, c: F.avg(F.when(F.col("l_returnflag") == f, F.col(c)))
    return quality.gate(
        unique_ids=quality.duplicates(orders, ["o_orderkey"]).select(F.col("n_duplicates") == 0),
        all_joined=items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*") == 0),
        finite=quality.nan_inf(items, ["l_tax"]).select(F.col("n_null") + F.col("n_nan") + F.col("n_inf") == 0),
        rates_close=quality.rate_deviation(rate(half), rate(lab)).agg(F.max("deviation") < 0.05),
        returned_dearer=items.agg(when("R", "l_extendedprice") > when("N", "l_tax")),
    )


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER (isnan({c})) AS n_nan, count(*) FILTER (isinf({c})) AS n_inf FROM lineitem" for c in BANDS))
def nan_inf_scan(spark, sf):
    return quality.nan_inf(table(spark, sf, "lineitem"), BANDS)


@query("SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_duplicates FROM lineitem")
def duplicate_scan(spark, sf):
    return quality.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(SQL + "SELECT patch_id, tile FROM (SELECT patch_id, tile, row_number() OVER (PARTITION BY tile ORDER BY md5('7:' || patch_id), patch_id) AS r, count(*) OVER (PARTITION BY tile) AS n FROM patch) WHERE r <= round_even(n * 0.1, 0)")
def stratified_fraction(spark, sf):
    return sampling.stratified_fraction(standin.patches(spark, sf).select("patch_id", "tile"), "tile", 0.1, 7)


@query(SQL + """, q AS (SELECT tile, floor(333 * (count(*) / (SELECT count(*) FROM patch)::DOUBLE)) AS quota FROM patch GROUP BY 1),
r AS (SELECT patch_id, tile, row_number() OVER (PARTITION BY tile ORDER BY md5('7:' || patch_id), patch_id) AS r FROM patch)
SELECT patch_id, tile FROM r JOIN q USING (tile) ORDER BY r > quota, md5('7:' || patch_id), patch_id LIMIT 333""")
def stratified_quota_topup(spark, sf):
    return sampling.stratified_quota(standin.patches(spark, sf).select("patch_id", "tile"), "tile", 333, 7)


@query("SELECT user_id, count(DISTINCT event_type) AS n_kinds, count(*) AS n_events FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def complete_groups_batch(spark, sf):
    from ..streaming.complete_groups import complete_groups

    events = table(spark, sf, "events")
    kinds = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").collect()]  # the kinds of a complete group
    whole = complete_groups(events, "user_id", "event_type", "event_id", "ts", kinds)
    n = events.groupBy("user_id").agg(F.count("*").alias("n_events"))
    return whole.select("user_id", F.size("members").cast("bigint").alias("n_kinds")).join(n, "user_id")


@query("""SELECT user_id, event_type FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t EXCEPT SELECT user_id, event_type FROM events""")
def incomplete_groups(spark, sf):
    from ..streaming.complete_groups import incomplete

    events = table(spark, sf, "events")
    kinds = [r[0] for r in events.select("event_type").distinct().collect()]  # the kinds of a complete group
    return incomplete(events, "user_id", "event_type", kinds).select("user_id", F.explode("missing").alias("event_type"))


@query("SELECT event_id, user_id, event_type, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS changed FROM events")
def change_points(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))).alias("changed"))


def _rasters(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000, 0)).alias("a"))


RASTER_SQL = """WITH v AS (SELECT vec_id, (unnest(range(64))) AS i, round(unnest(embedding)::DOUBLE * 1000, 0) AS x FROM embeddings), g AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, x FROM v)"""


def _near_sql(k: int, expr: str, name: str) -> str:
    """Mean of expr over a k x k box with reflected edges, by an offset join."""
    h = k // 2
    fold = lambda e: f"CASE WHEN {e} < 0 THEN -({e}) - 1 WHEN {e} >= 8 THEN 15 - ({e}) ELSE {e} END"
    return f"{name} AS (SELECT a.vec_id, a.r, a.c, avg({expr}) AS m FROM g a, (SELECT unnest(range(-{h}, {h + 1})) AS dr) o1, (SELECT unnest(range(-{h}, {h + 1})) AS dc) o2, g b WHERE b.vec_id = a.vec_id AND b.r = {fold('a.r + dr')} AND b.c = {fold('a.c + dc')} GROUP BY 1, 2, 3)"


def _cells(df, column):
    return df.select("vec_id", F.posexplode(column).alias("i", "v")).select("vec_id", F.col("i").cast("bigint").alias("i"), "v")


@query("WITH s AS (SELECT unnest(range(20)) AS t) SELECT vec_id, (a.t * 20 + b.t)::BIGINT AS i, round(round(embedding[(floor(a.t * 7 / 19.0 + 0.5) * 8 + floor(b.t * 7 / 19.0 + 0.5) + 1)::INT]::DOUBLE * 1000, 0), 6) + 0.0::DOUBLE AS v FROM embeddings, s a, s b")
def upsample_nearest(spark, sf):
    r = _rasters(spark, sf)
    return rounded(_cells(r.select("vec_id", raster.upsample(F.col("a"), 8, 20).alias("u")), "u"))


@query(RASTER_SQL + ", " + _near_sql(3, "b.x", "m3") + " SELECT vec_id, r * 8 + c AS i, round(m, 5) AS v FROM m3")
def box_mean_3(spark, sf):
    r = _rasters(spark, sf)
    return rounded(_cells(r.select("vec_id", raster.box_mean(F.col("a"), 8, 3).alias("m")), "m"), 5)


@query(RASTER_SQL + ", " + ", ".join([_near_sql(3, "b.x", "m3"), _near_sql(3, "b.x * b.x", "s3"), _near_sql(7, "b.x", "m7"), _near_sql(7, "b.x * b.x", "s7")]) + " SELECT m3.vec_id, m3.r * 8 + m3.c AS i, round(greatest(s3.m - m3.m * m3.m, 0), 2) AS var3, round(greatest(s7.m - m7.m * m7.m, 0), 2) AS var7 FROM m3 JOIN s3 USING (vec_id, r, c) JOIN m7 USING (vec_id, r, c) JOIN s7 USING (vec_id, r, c)")
def local_var_3_7(spark, sf):
    r = _rasters(spark, sf).select("vec_id", F.arrays_zip(raster.local_variance(F.col("a"), 8, 3).alias("var3"), raster.local_variance(F.col("a"), 8, 7).alias("var7")).alias("z"))
    return rounded(r.select("vec_id", F.posexplode("z").alias("i", "z")).select("vec_id", F.col("i").cast("bigint").alias("i"), F.col("z.var3").alias("var3"), F.col("z.var7").alias("var7")), 2)


def _sobel_sql() -> str:
    fold = lambda e: f"CASE WHEN {e} < 0 THEN -({e}) - 1 WHEN {e} >= 8 THEN 15 - ({e}) ELSE {e} END"
    return RASTER_SQL + f", o AS (SELECT unnest([-1, 0, 1]) AS d, unnest([1, 2, 1]) AS w), sob AS (SELECT a.vec_id, a.r, a.c, sum(b.x * o1.d * o2.w) AS gy, sum(b.x * o2.d * o1.w) AS gx FROM g a, o o1, o o2, g b WHERE b.vec_id = a.vec_id AND b.r = {fold('a.r + o1.d')} AND b.c = {fold('a.c + o2.d')} GROUP BY 1, 2, 3)"


@query(_sobel_sql() + " SELECT vec_id, r * 8 + c AS i, round(sqrt(gx * gx + gy * gy), 4) AS v FROM sob")
def sobel_mag(spark, sf):
    return rounded(_cells(_rasters(spark, sf).select("vec_id", raster.sobel(F.col("a"), 8).alias("s")), "s"), 4)


@query(_sobel_sql() + ", " + ", ".join([_near_sql(3, "b.x", "m3"), _near_sql(3, "b.x * b.x", "s3"), _near_sql(7, "b.x", "m7"), _near_sql(7, "b.x * b.x", "s7")]) + """, t AS (SELECT vec_id, greatest(s3.m - m3.m * m3.m, 0) AS v3, greatest(s7.m - m7.m * m7.m, 0) AS v7, sqrt(gx * gx + gy * gy) AS s FROM m3 JOIN s3 USING (vec_id, r, c) JOIN m7 USING (vec_id, r, c) JOIN s7 USING (vec_id, r, c) JOIN sob USING (vec_id, r, c))
SELECT vec_id, """ + ", ".join(f"round(stddev_pop({c}), 3) AS B_{n}_std, round(quantile_cont({c}, 0.9), 3) AS B_{n}_p90" for c, n in (("v3", "var3x3"), ("v7", "var7x7"), ("s", "sobel"))) + " FROM t GROUP BY 1")
def texture_summary(spark, sf):
    return rounded(features.textures(_rasters(spark, sf), {"B": "a"}, 8, ["vec_id"]), 3)


#: Bands of the composite: native edge length on a common grid of 8 x 8.
NATIVE = {"B01": 2, "B02": 8, "B03": 8, "B04": 8, "B05": 4, "B06": 4, "B07": 4, "B08": 8, "B09": 2, "B11": 4, "B12": 4, "B8A": 4}


def _composite_sql() -> str:
    def source(e: str, n: int) -> str:
        return e if n == 8 else f"floor({e} * {n - 1} / 7.0 + 0.5)"

    value = lambda k, n: f"2000 + {37 * k} + round(e[({source('r', n)} * {n} + {source('c', n)} + 1)::INT]::DOUBLE * {1000 + 10 * k}, 0)"
    px = "WITH e AS (SELECT vec_id, embedding AS e, unnest(range(64)) AS i FROM embeddings), rc AS (SELECT vec_id, e, i // 8 AS r, i % 8 AS c FROM e), px AS (SELECT vec_id, r, c, "
    px += ", ".join(f"({value(k, n)})::DOUBLE AS {b}" for k, (b, n) in enumerate(NATIVE.items())) + " FROM rc)"
    parts, joins = [], ""
    rough = lambda b: ", ".join(f"round(stddev_pop({c}), 2) AS {b}_{n}_std, round(quantile_cont({c}, 0.9), 2) AS {b}_{n}_p90" for c, n in (("v3", "var3x3"), ("v7", "var7x7"), ("s", "sobel")))
    for b in ("B08", "B04"):
        near = [_near_sql(3, "b.x", f"m3{b}"), _near_sql(3, "b.x * b.x", f"s3{b}"), _near_sql(7, "b.x", f"m7{b}"), _near_sql(7, "b.x * b.x", f"s7{b}")]
        sob = _sobel_sql().split("GROUP BY 1, 2, 3)")[0].split("sob AS (")[1]
        offsets = f"o{b} AS (SELECT unnest([-1, 0, 1]) AS d, unnest([1, 2, 1]) AS w)"
        own = [f"g{b} AS (SELECT vec_id, r, c, {b} AS x FROM px)", offsets, *near, f"sob{b} AS ({sob} GROUP BY 1, 2, 3)"]
        parts += [x.replace("FROM g a", f"FROM g{b} a").replace(" g b WHERE", f" g{b} b WHERE").replace(" o o1, o o2", f" o{b} o1, o{b} o2") for x in own]
        parts.append(f"t{b} AS (SELECT vec_id, greatest(s3{b}.m - m3{b}.m * m3{b}.m, 0) AS v3, greatest(s7{b}.m - m7{b}.m * m7{b}.m, 0) AS v7, sqrt(gx * gx + gy * gy) AS s FROM m3{b} JOIN s3{b} USING (vec_id, r, c) JOIN m7{b} USING (vec_id, r, c) JOIN s7{b} USING (vec_id, r, c) JOIN sob{b} USING (vec_id, r, c))")
        parts.append(f"x{b} AS (SELECT vec_id, {rough(b)} FROM t{b} GROUP BY 1)")
        joins += f" JOIN x{b} USING (vec_id)"
    parts.append(f"st AS (SELECT vec_id, {', '.join(_stats_sql(b).replace(', 6) AS', ', 3) AS') for b in NATIVE)}, {_index_sql({b: b for b in NATIVE})} FROM px GROUP BY 1)")
    return px + ", " + ", ".join(parts) + f" SELECT * FROM st{joins}"


def composite_rasters(spark, sf):
    """(vec_id, the twelve bands in their native sizes), made from the embeddings."""
    def band(k: int, n: int):
        return F.transform(F.slice("embedding", 1, n * n), lambda x: F.round(x.cast("double") * (1000 + 10 * k), 0) + 2000.0 + 37 * k)

    return table(spark, sf, "embeddings").select("vec_id", *(band(k, n).alias(b) for k, (b, n) in enumerate(NATIVE.items())))


@query(_composite_sql())
def composite_features(spark, sf):
    """All 110 features of a patch from native rasters."""
    out = features.composite(composite_rasters(spark, sf), {b: (b, n) for b, n in NATIVE.items()}, 8, ["vec_id"])
    digits = lambda c: 2 if "var" in c or "sobel" in c else 3 if c[0] == "B" and c[1].isdigit() else 6
    return out.select("vec_id", *((F.round(c, digits(c)) + F.lit(0.0)).alias(c) for c in out.columns[1:]))


@query(f"WITH w AS (SELECT l_orderkey AS patch_id, {', '.join(_stats_sql(c) for c in BANDS)} FROM lineitem GROUP BY 1), u AS (UNPIVOT w ON COLUMNS(* EXCLUDE patch_id) INTO NAME feature VALUE v) SELECT patch_id, 'f_' || lpad((dense_rank() OVER (ORDER BY feature) - 1)::VARCHAR, 3, '0') AS code, round(v, 1) AS v FROM u")
def feature_vector_long(spark, sf):
    source = band_stats(spark, sf)
    _, codes = features.numbered(source, ["patch_id"])
    cells = F.array(*(F.struct(F.lit(k).alias("code"), F.col(c).alias("v")) for k, c in codes.items()))
    return rounded(source.select("patch_id", F.inline(cells)), 1)


@query("""WITH t AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem WHERE l_orderkey % 4 < 2)
SELECT l_returnflag, count(*) AS n, round(avg((l_quantity - m) / s), 6) AS mean, round(max((l_quantity - m) / s), 6) AS top FROM lineitem, t GROUP BY 1""")
def standardize_train_only(spark, sf):
    from ..operators.ml import standardise

    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    scaled = standardise(rows, ["l_quantity"], F.col("l_orderkey") % 4 < 2)
    return rounded(scaled.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"), F.max("l_quantity").alias("top")))


def _single(spark, sf):
    """A deterministic single-label prediction: order priority, guessed from the customer segment's hash."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    guess = F.when(hashing.seeded_int(3, F.col("o_orderkey")) % 3 == 0, "1-URGENT").otherwise(F.col("o_orderpriority"))
    return orders.withColumn("guess", guess)


SINGLE = "WITH s AS (SELECT o_orderkey, o_orderpriority AS a, CASE WHEN ('0x' || substr(md5('3:' || o_orderkey), 1, 8))::BIGINT % 3 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS p FROM orders)"


@query(SINGLE + ", l AS (SELECT a AS x FROM s UNION SELECT p FROM s) SELECT i.x AS actual, j.x AS predicted, count(s.a) AS n FROM l i CROSS JOIN l j LEFT JOIN s ON s.a = i.x AND s.p = j.x GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return legacy.confusion_matrix(_single(spark, sf), "o_orderpriority", "guess")


@query(SINGLE + """, l AS (SELECT a AS x FROM s UNION SELECT p FROM s), c AS (SELECT x AS label, count(*) FILTER (a = x) AS support, count(*) FILTER (p = x) AS called, count(*) FILTER (a = x AND p = x) AS tp FROM l, s GROUP BY 1),
m AS (SELECT label, coalesce(tp / nullif(called, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(called + support, 0), 0) AS f1, support, tp FROM c)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support)::DOUBLE, 6), round(sum(tp) / sum(support)::DOUBLE, 6), round(sum(tp) / sum(support)::DOUBLE, 6), sum(support)::BIGINT FROM m
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM m
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support)::DOUBLE, 6), round(sum(recall * support) / sum(support)::DOUBLE, 6), round(sum(f1 * support) / sum(support)::DOUBLE, 6), sum(support)::BIGINT FROM m""")
def classification_report(spark, sf):
    return rounded(legacy.classification_report(_single(spark, sf), "o_orderpriority", "guess"))


@query("""WITH x AS (SELECT l_orderkey AS patch_id, l_quantity AS b, l_linenumber * 100.0::DOUBLE AS g, l_discount * 1000 AS r, l_tax * 5000 AS n FROM lineitem)
SELECT patch_id, round(avg((n / 10000 - r / 10000) / (n / 10000 + r / 10000 + 1e-6::DOUBLE)), 9) AS ndvi, round(avg((g / 10000 - n / 10000) / (g / 10000 + n / 10000 + 1e-6::DOUBLE)), 9) AS ndwi,
round(avg(b / 10000), 9) AS b02_mean, round(stddev_pop(b / 10000), 9) AS b02_std, round(avg(g / 10000), 9) AS b03_mean, round(stddev_pop(g / 10000), 9) AS b03_std, round(avg(r / 10000), 9) AS b04_mean, round(stddev_pop(r / 10000), 9) AS b04_std, round(avg(n / 10000), 9) AS b08_mean, round(stddev_pop(n / 10000), 9) AS b08_std FROM x GROUP BY 1""")
def legacy_features(spark, sf):
    px = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "patch_id")
    return rounded(legacy.legacy_features(px, ["patch_id"], F.col("l_quantity"), F.col("l_linenumber") * 100.0, F.col("l_discount") * 1000, F.col("l_tax") * 5000), 9)


@query("SELECT o_orderpriority AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS index FROM orders GROUP BY 1")
def label_index(spark, sf):
    return legacy.indexed(table(spark, sf, "orders"), "o_orderpriority").withColumn("index", F.col("index").cast("bigint"))


@query(SQL + """, n AS (SELECT count(DISTINCT patch_id) AS n FROM lab), c AS (SELECT class, count(*) AS n FROM lab GROUP BY 1), x AS (SELECT a.class AS a, b.class AS b, count(*) AS n_both FROM lab a JOIN lab b ON a.patch_id = b.patch_id AND a.class < b.class GROUP BY 1, 2)
SELECT a, b, n_both, round(ln(n_both * n.n / (ca.n * cb.n)::DOUBLE) / -ln(n_both / n.n::DOUBLE), 6) AS npmi FROM x JOIN c ca ON ca.class = a JOIN c cb ON cb.class = b, n""")
def label_cooccurrence_npmi(spark, sf):
    lists = standin.labels(spark, sf).groupBy("patch_id").agg(F.array_sort(F.collect_set("class")).alias("l"))
    # pairs of the labels of one patch: at most the square of the classes
    pair = lists.select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_both"))
    one = lists.select(F.explode("l").alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    total = lists.agg(F.count("*").alias("total"))
    x = pair.join(F.broadcast(one.select(F.col("c").alias("a"), F.col("n").alias("n_a"))), "a").join(F.broadcast(one.select(F.col("c").alias("b"), F.col("n").alias("n_b"))), "b").crossJoin(F.broadcast(total))
    return rounded(x.select("a", "b", "n_both", (F.log(F.col("n_both") * F.col("total") / (F.col("n_a") * F.col("n_b"))) / -F.log(F.col("n_both") / F.col("total"))).alias("npmi")))


@query(SQL + "SELECT tile, country, count(*) AS n, round(avg(true_label), 6) AS rate FROM pred GROUP BY GROUPING SETS ((tile, country), (country), ())")
def breakdown_grouping_sets(spark, sf):
    cells = standin.label_cells(spark, sf, standin.patches(spark, sf))
    cells.createOrReplaceTempView("_cells")
    return rounded(spark.sql("SELECT tile, country, count(*) AS n, avg(label) AS rate FROM _cells GROUP BY GROUPING SETS ((tile, country), (country), ())"))


@query("""WITH g AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v - avg(v) OVER (PARTITION BY vec_id) AS z FROM (SELECT vec_id, unnest(range(64)) AS i, round(unnest(embedding)::DOUBLE * 1000, 0) AS v FROM embeddings)),
p AS (SELECT a.vec_id, sum(a.z * b.z) AS s, count(*) AS w FROM g a JOIN g b ON a.vec_id = b.vec_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY 1), q AS (SELECT vec_id, sum(z * z) AS s, count(*) AS n FROM g GROUP BY 1)
SELECT p.vec_id, round(q.n / p.w::DOUBLE * p.s / q.s, 6) AS moran FROM p JOIN q USING (vec_id)""")
def morans_i(spark, sf):
    from pyspark.sql import Window

    cells = _cells(_rasters(spark, sf), "a").withColumn("z", F.col("v") - F.avg("v").over(Window.partitionBy("vec_id")))
    cells = cells.select("vec_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"), "z")
    step = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))))
    near = cells.withColumn("o", step).select("vec_id", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), F.col("z").alias("zn"))
    top = cells.join(near, ["vec_id", "x", "y"]).groupBy("vec_id").agg(F.sum(F.col("z") * F.col("zn")).alias("s"), F.count("*").alias("w"))
    low = cells.groupBy("vec_id").agg(F.sum(F.col("z") * F.col("z")).alias("q"), F.count("*").alias("n"))
    return rounded(top.join(low, "vec_id").select("vec_id", (F.col("n") / F.col("w") * F.col("s") / F.col("q")).alias("moran")))


@query(SQL + "SELECT tile, country, n, round(n / sum(n) OVER ()::DOUBLE, 6) AS share FROM (SELECT tile, country, count(*) AS n FROM patch GROUP BY 1, 2)")
def tile_shares(spark, sf):
    return rounded(splits.shares(standin.patches(spark, sf), ["tile", "country"]))



GRID = SQL + f""", px AS (SELECT l_orderkey AS patch_id, round(avg(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1),
pl AS (SELECT tile, patch_id % 8 AS x, patch_id // 8 % 8 AS y, avg(v) AS v FROM patch JOIN px USING (patch_id) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY md5('{standin.SEED}:' || tile || ':' || x || ':' || y), x || ':' || y) - 1 AS r, count(*) OVER (PARTITION BY tile) AS n, avg(v) OVER (PARTITION BY tile) AS mean, var_pop(v) OVER (PARTITION BY tile) AS spread FROM pl),
lk AS (SELECT a.tile, a.r AS i, b.r AS j FROM r a JOIN r b ON a.tile = b.tile AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1))),
dr AS (SELECT -1 AS d, 0::BIGINT AS h UNION ALL SELECT d, 1 + ('0x' || substr(md5('{standin.SEED}:' || d), 1, 8))::BIGINT FROM (SELECT unnest(range(99)) AS d)),
st AS (SELECT tile, n, d, CASE WHEN d < 0 OR n = 1 THEN 0 ELSE 1 + (h - 1) % (n - 1) END AS s FROM (SELECT DISTINCT tile, n FROM r), dr),
mo AS (SELECT lk.tile, d, count(*) AS links, round(sum((p.v - p.mean) * (q.v - p.mean)) / count(*) / any_value(p.spread), 9) AS i FROM lk JOIN st USING (tile) JOIN r p ON p.tile = lk.tile AND p.r = (lk.i + s) % st.n JOIN r q ON q.tile = lk.tile AND q.r = (lk.j + s) % st.n GROUP BY 1, 2)
"""


@query(GRID + "SELECT o.tile, any_value(r.n) AS n, o.links, round(o.i, 6) AS moran, round(-1.0::DOUBLE / (any_value(r.n) - 1), 6) AS expected, (SELECT sum((m.i >= o.i)::INT) / 100.0::DOUBLE FROM mo m WHERE m.tile = o.tile) AS p FROM mo o JOIN r USING (tile) WHERE o.d = -1 GROUP BY o.tile, o.links, o.i")
def morans_grid(spark, sf):
    """Moran's I of the patches' mean price over their places in the tile, with p from 99 permutations."""
    from ..operators import spatial

    price = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("patch_id")).agg(F.round(F.avg("l_extendedprice"), 2).alias("v"))
    places = standin.patches(spark, sf).join(price, "patch_id").select("tile", (F.col("patch_id") % 8).alias("gx"), (F.floor(F.col("patch_id") / 8) % 8).alias("gy"), "v")
    return rounded(spatial.morans_grid(places, ["tile"], "v"))
