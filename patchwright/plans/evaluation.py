"""Queries: metrics, thresholds, regime comparison, paired controls, resampling, training, streaming, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as labels_of
from ..operators import accounting, audit, metrics, ml, sampling, stats
from ..sources.storage import materialise, new_path
from . import standin
from .registry import query, rounded
from .standin import SEED, SQL, ranking_sql, table

KEYS = ["regime", "fold", "class"]
RANKED = SQL + ranking_sql("ev", "regime, fold, class")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ranking(standin.evaluated(spark, sf), KEYS)


def s2(spark: SparkSession, sf: str) -> DataFrame:
    """Scored cells of the official split: patch_id, role, class, true_label, score."""
    p = standin.patches(spark, sf).select("patch_id", F.col("s2_split").alias("role"))
    return standin.predictions(spark, sf, p.where("role <> 'train'")).select("patch_id", "role", "class", "true_label", "score")


@query(RANKED + "SELECT regime, round(avg(m), 6) AS macro, count(m) AS n_classes, sum(c)::BIGINT AS n_cells FROM (SELECT regime, class, avg(ap) AS m, count(ap) AS c FROM cell GROUP BY 1, 2) GROUP BY 1")
def split_ladder_ap(spark, sf):
    return rounded(audit.class_major(cells(spark, sf), "ap"))


@query(RANKED + "SELECT regime, fold, class, n, n_pos, round(ap, 6) AS ap FROM cell")
def per_class_ap(spark, sf):
    return rounded(cells(spark, sf).drop("auroc"))


@query(RANKED + "SELECT regime, fold, class, round(auroc, 6) AS auroc FROM cell")
def per_class_auroc(spark, sf):
    return rounded(cells(spark, sf).select(*KEYS, "auroc"))


@query(SQL + """SELECT regime, fold, class, sum((score >= 500 AND true_label = 1)::INT)::BIGINT AS tp, sum((score >= 500 AND true_label = 0)::INT)::BIGINT AS fp, sum((score < 500 AND true_label = 1)::INT)::BIGINT AS fn,
sum((score < 500 AND true_label = 0)::INT)::BIGINT AS tn, round(coalesce(2.0::DOUBLE * sum((score >= 500 AND true_label = 1)::INT) / nullif(sum((score >= 500)::INT) + sum(true_label), 0), 0), 6) AS f1 FROM ev GROUP BY 1, 2, 3""")
def per_class_f1(spark, sf):
    c = metrics.confusion(standin.evaluated(spark, sf), KEYS, F.lit(500))
    return rounded(c.withColumn("f1", metrics.f1_of(F.col("tp"), F.col("fp"), F.col("fn"))))


BUNDLE = SQL + ranking_sql("ev", "regime, fold, class") + """, okap AS (SELECT ev.* FROM ev JOIN cell c USING (regime, fold, class) WHERE c.ap IS NOT NULL), okau AS (SELECT ev.* FROM ev JOIN cell c USING (regime, fold, class) WHERE c.auroc IS NOT NULL)""" + ranking_sql("okap", "regime, fold", "pa") + ranking_sql("okau", "regime, fold", "pu") + """,
cf AS (SELECT regime, fold, class, sum((score >= 500 AND true_label = 1)::INT) AS tp, sum((score >= 500 AND true_label = 0)::INT) AS fp, sum((score < 500 AND true_label = 1)::INT) AS fn, count(*) AS n FROM ev GROUP BY 1, 2, 3),
f AS (SELECT regime, fold, avg(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)) AS f1_macro, coalesce(2.0::DOUBLE * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0) AS f1_micro, (sum(fp) + sum(fn)) / sum(n)::DOUBLE AS hamming FROM cf GROUP BY 1, 2),
ex AS (SELECT regime, fold, avg(ok::INT) AS subset_accuracy FROM (SELECT regime, fold, patch_id, bool_and((score >= 500) = (true_label = 1)) AS ok FROM ev GROUP BY 1, 2, 3) GROUP BY 1, 2),
mm AS (SELECT regime, fold, avg(ap) AS ap_macro, count(ap) AS ap_used, avg(auroc) AS auroc_macro, count(auroc) AS auroc_used FROM cell GROUP BY 1, 2)
"""


@query(BUNDLE + "SELECT regime, fold, round(ap_macro, 6) AS ap_macro, ap_used, round(auroc_macro, 6) AS auroc_macro, auroc_used, round(f1_macro, 6) AS f1_macro, round(f1_micro, 6) AS f1_micro, round(pa.ap, 6) AS ap_micro, round(pu.auroc, 6) AS auroc_micro FROM mm JOIN f USING (regime, fold) JOIN pa USING (regime, fold) JOIN pu USING (regime, fold)")
def macro_micro_metrics(spark, sf):
    return rounded(metrics.macro_micro(standin.evaluated(spark, sf), ["regime", "fold"], F.lit(500)))


@query(BUNDLE + "SELECT regime, fold, round(hamming, 6) AS hamming, round(subset_accuracy, 6) AS subset_accuracy FROM f JOIN ex USING (regime, fold)")
def hamming_subset(spark, sf):
    return rounded(metrics.hamming_subset(standin.evaluated(spark, sf), ["regime", "fold"], F.lit(500)))


S2SQL = SQL + ", v AS (SELECT patch_id, s2_split AS role, class, true_label, score FROM pred WHERE s2_split <> 'train')"
CURVE = S2SQL + """, c0 AS (SELECT class, score, sum(true_label) AS pos, count(*) AS n FROM v WHERE role = 'validation' GROUP BY 1, 2),
c1 AS (SELECT *, sum(pos) OVER (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS k, sum(pos) OVER (PARTITION BY class) AS p FROM c0),
pts AS (SELECT class, score AS threshold, tp / k::DOUBLE AS precision, tp / nullif(p, 0)::DOUBLE AS recall, coalesce(2.0::DOUBLE * tp / nullif(k + p, 0), 0) AS f1 FROM c1),
best AS (SELECT class, threshold::DOUBLE AS threshold, f1 AS val_f1 FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY round(f1, 12) DESC, threshold) AS r FROM pts) WHERE r = 1)
"""


@query(CURVE + "SELECT class, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pts")
def pr_curve(spark, sf):
    return rounded(metrics.pr_points(s2(spark, sf).where("role = 'validation'"), ["class"]).drop("all_pos"))


def thresholds(spark, sf):
    return metrics.tune_threshold(s2(spark, sf).where("role = 'validation'"), ["class"], 500.0)


@query(CURVE + "SELECT class, threshold, round(val_f1, 6) AS val_f1 FROM best")
def tune_threshold(spark, sf):
    return rounded(thresholds(spark, sf))


@query(CURVE + """, t AS (SELECT v.class, threshold, val_f1, sum((score >= threshold AND true_label = 1)::INT) AS tp, sum((score >= threshold)::INT) AS k, sum(true_label) AS p FROM v JOIN best USING (class) WHERE role = 'test' GROUP BY ALL)
SELECT class, threshold, round(val_f1, 6) AS val_f1, round(coalesce(2.0::DOUBLE * tp / nullif(k + p, 0), 0), 6) AS test_f1 FROM t""")
def threshold_apply_test(spark, sf):
    tuned = thresholds(spark, sf)
    test = s2(spark, sf).where("role = 'test'").join(F.broadcast(tuned), "class")  # one row per class
    c = metrics.confusion(test, ["class", "threshold", "val_f1"], F.col("threshold"))
    return rounded(c.select("class", "threshold", "val_f1", metrics.f1_of(F.col("tp"), F.col("fp"), F.col("fn")).alias("test_f1")))


@query(S2SQL + ", full_ids AS (SELECT patch_id FROM v WHERE NOT (class = 'ECONOMY' AND score % 10 = 0) GROUP BY 1 HAVING count(DISTINCT class) = (SELECT count(*) FROM cls)) SELECT class, count(*) AS n, sum(true_label)::BIGINT AS n_pos FROM v WHERE patch_id IN (SELECT patch_id FROM full_ids) AND NOT (class = 'ECONOMY' AND score % 10 = 0) GROUP BY 1")
def label_matrix_common_ids(spark, sf):
    some = s2(spark, sf).where("NOT (class = 'ECONOMY' AND score % 10 = 0)")
    n = table(spark, sf, "part").select("p_type").distinct().count()
    return metrics.common_matrix(some, [], n).groupBy("class").agg(F.count("*").alias("n"), F.sum("true_label").alias("n_pos"))


@query(S2SQL + ", i AS (SELECT class, row_number() OVER (ORDER BY class) - 1 AS k FROM cls) SELECT patch_id, " + ", ".join(f"max(CASE WHEN k = {i} THEN score END) AS p_{i:02d}" for i in range(6)) + " FROM v JOIN i USING (class) WHERE role = 'test' GROUP BY 1")
def label_matrix_pivot(spark, sf):
    names = [r[0] for r in table(spark, sf, "part").select("p_type").distinct().orderBy("p_type").collect()]  # the class vocabulary
    wide = s2(spark, sf).where("role = 'test'").groupBy("patch_id").pivot("class", names).agg(F.max("score"))
    return wide.select("patch_id", *(F.col(f"`{n}`").alias(f"p_{i:02d}") for i, n in enumerate(names)))


@query(RANKED + "SELECT regime, round(avg(m), 6) AS macro, count(m) AS n_classes, sum(c)::BIGINT AS n_cells FROM (SELECT regime, class, avg(auroc) AS m, count(auroc) AS c FROM cell WHERE class <> 'ECONOMY' GROUP BY 1, 2) GROUP BY 1")
def class_major_macro(spark, sf):
    return rounded(audit.class_major(cells(spark, sf), "auroc", exclude=["ECONOMY"]))


@query(SQL + ranking_sql("ev", "regime, class") + "SELECT regime, class, n, n_pos, round(ap, 6) AS ap, round(auroc, 6) AS auroc FROM cell")
def pooled_metric(spark, sf):
    return rounded(metrics.ranking(standin.evaluated(spark, sf), ["regime", "class"]))


IMPUTED = RANKED + """, pr AS (SELECT country AS fold, class, avg(true_label) AS stand_in FROM pred GROUP BY 1, 2), im AS (SELECT regime, fold, class, coalesce(CASE WHEN regime = 's4' AND fold = 'ASIA' AND class = 'ECONOMY' THEN NULL ELSE ap END, stand_in) AS ap FROM cell LEFT JOIN pr USING (fold, class))"""


@query(IMPUTED + "SELECT regime, round(avg(m), 6) AS macro, count(m) AS n_classes, sum(c)::BIGINT AS n_cells FROM (SELECT regime, class, avg(ap) AS m, count(ap) AS c FROM im GROUP BY 1, 2) GROUP BY 1")
def imputed_19class(spark, sf):
    hole = (F.col("regime") == "s4") & (F.col("fold") == "ASIA") & (F.col("class") == "ECONOMY")
    with_hole = cells(spark, sf).withColumn("ap", F.when(~hole, F.col("ap")))
    rate = standin.label_cells(spark, sf, standin.patches(spark, sf)).groupBy(F.col("country").alias("fold"), "class").agg(F.avg("label").alias("stand_in"))
    return rounded(audit.class_major(audit.imputed(with_hole, rate, ["fold", "class"]), "ap"))


GAPS = [("s1", "s2"), ("s2", "s3"), ("s2", "s4"), ("s1", "s4")]


@query(RANKED + ", m AS (SELECT regime, avg(m) AS v FROM (SELECT regime, class, avg(ap) AS m FROM cell GROUP BY 1, 2) GROUP BY 1) " + " UNION ALL ".join(f"SELECT '{a}-{b}' AS gap, round(100 * ((SELECT v FROM m WHERE regime = '{a}') - (SELECT v FROM m WHERE regime = '{b}')), 6) AS points" for a, b in GAPS))
def optimism_gap(spark, sf):
    return rounded(audit.gaps(audit.class_major(cells(spark, sf), "ap"), GAPS))


@query(SQL + "SELECT 's3' AS regime, s3_fold::VARCHAR AS fold, round(((SELECT count(*) FROM split) - count(*)) / (SELECT count(*) FROM split WHERE s2_split = 'train')::DOUBLE, 6) AS ratio FROM split GROUP BY 2 UNION ALL SELECT 's4', s4_fold, round(((SELECT count(*) FROM split) - count(*)) / (SELECT count(*) FROM split WHERE s2_split = 'train')::DOUBLE, 6) FROM split GROUP BY 2")
def train_size_ratio(spark, sf):
    p = standin.split(spark, sf)
    total = p.agg(F.count("*").alias("n_all"), F.sum((F.col("s2_split") == "train").cast("int")).alias("n_train"))
    folds = p.select(F.inline(F.array(F.struct(F.lit("s3").alias("regime"), F.col("s3_fold").cast("string").alias("fold")), F.struct(F.lit("s4").alias("regime"), F.col("s4_fold").alias("fold")))))
    n = folds.groupBy("regime", "fold").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row
    return rounded(n.select("regime", "fold", ((F.col("n_all") - F.col("n")) / F.col("n_train")).alias("ratio")))


def _sides(spark, sf):
    """The official test part, and the same patches under leave-country-out with another score."""
    a = s2(spark, sf).where("role = 'test'").join(standin.patches(spark, sf).select("patch_id", "country"), "patch_id")
    return a, a.withColumn("score", (F.col("score") * 7 + F.col("patch_id") * 13) % 1000)


PAIRED = SQL + """, a AS (SELECT country, patch_id, class, true_label, score FROM pred WHERE s2_split = 'test'), b AS (SELECT country, patch_id, class, true_label, (score * 7 + patch_id * 13) % 1000 AS score FROM a)""" + ranking_sql("a", "country, class", "ra") + ranking_sql("b", "country, class", "rb") + """,
d AS (SELECT country, 100 * (avg(CASE WHEN rb.ap IS NOT NULL THEN ra.ap END) - avg(CASE WHEN ra.ap IS NOT NULL THEN rb.ap END)) AS delta_ap, 100 * (avg(CASE WHEN rb.auroc IS NOT NULL THEN ra.auroc END) - avg(CASE WHEN ra.auroc IS NOT NULL THEN rb.auroc END)) AS delta_auroc, count(ra.ap + rb.ap) AS n_classes FROM ra JOIN rb USING (country, class) GROUP BY 1),
sh AS (SELECT country, count(*) AS n, count(*) / (SELECT count(*) FROM patch)::DOUBLE AS share FROM patch GROUP BY 1)
"""


def deltas(spark, sf):
    left, right = _sides(spark, sf)
    pair = audit.paired(left, right, ["country", "patch_id", "class"])
    ra, rb = metrics.ranking(pair, ["country", "class"]), metrics.ranking(pair, ["country", "class"], label="true_b", score="score_b")
    both = ra.select("country", "class", F.col("ap").alias("ap_a"), F.col("auroc").alias("auroc_a")).join(rb.select("country", "class", F.col("ap").alias("ap_b"), F.col("auroc").alias("auroc_b")), ["country", "class"])
    diff = lambda m: 100 * (F.avg(F.when(F.col(f"{m}_b").isNotNull(), F.col(f"{m}_a"))) - F.avg(F.when(F.col(f"{m}_a").isNotNull(), F.col(f"{m}_b"))))
    return both.groupBy("country").agg(diff("ap").alias("delta_ap"), diff("auroc").alias("delta_auroc"), F.count(F.col("ap_a") + F.col("ap_b")).alias("n_classes"))


@query(PAIRED + "SELECT country, round(delta_ap, 6) AS delta_ap, round(delta_auroc, 6) AS delta_auroc, n_classes FROM d")
def paired_region_delta(spark, sf):
    return rounded(deltas(spark, sf))


@query(PAIRED + """, j AS (SELECT a.patch_id AS x, b.patch_id AS y, a.true_label AS t, b.true_label AS u FROM a FULL JOIN b ON a.country = b.country AND a.patch_id = b.patch_id AND a.class = b.class)
SELECT count(*) FILTER (x IS NULL OR y IS NULL) AS unpaired, (SELECT count(*) - count(DISTINCT (country, patch_id, class)) FROM a) + (SELECT count(*) - count(DISTINCT (country, patch_id, class)) FROM b) AS repeated, count(*) FILTER (t <> u) AS label_differs FROM j""")
def paired_identity(spark, sf):
    left, right = _sides(spark, sf)
    return audit.pairing_faults(left, right, ["country", "patch_id", "class"])


@query(PAIRED + "SELECT count(delta_ap) AS n, round(quantile_cont(delta_ap, 0.5), 6) AS median, round(quantile_cont(delta_ap, 0.25), 6) AS q1, round(quantile_cont(delta_ap, 0.75), 6) AS q3, round(quantile_cont(delta_ap, 0.75) - quantile_cont(delta_ap, 0.25), 6) AS iqr, round(sum(delta_ap * n) / sum(n), 6) AS weighted_mean FROM d JOIN sh USING (country)")
def paired_summary(spark, sf):
    d = deltas(spark, sf).join(standin.patches(spark, sf).groupBy("country").agg(F.count("*").alias("n")), "country")
    return rounded(stats.summary(d, "delta_ap").crossJoin(F.broadcast(audit.weighted_mean(d, [], "delta_ap", "n"))))  # one row


# Two published lists of ten differences.
DELTAS = {"all_positive": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], "five_against": [1, 2, 3, -5, 4, 6, 7, 8, 9, 10]}


def _golden() -> str:
    rows = ", ".join(f"('{k}', {v}::DOUBLE)" for k, vs in DELTAS.items() for v in vs)
    return f"WITH d AS (SELECT * FROM (VALUES {rows}) t(list, v))"


@query(_golden() + """, r AS (SELECT list, v, rank() OVER (PARTITION BY list ORDER BY abs(v)) + (count(*) OVER (PARTITION BY list, abs(v)) - 1) / 2.0::DOUBLE AS r FROM d),
o AS (SELECT list, count(*) AS n, sum(CASE WHEN v > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN v < 0 THEN r ELSE 0 END) AS w_minus FROM r GROUP BY 1), i AS (SELECT list, r, row_number() OVER (PARTITION BY list ORDER BY r) - 1 AS i FROM r),
p AS (SELECT list, s, sum(CASE WHEN (s >> i::BIGINT) & 1 = 1 THEN r ELSE 0 END) AS w FROM i, (SELECT unnest(range(1024))::BIGINT AS s) GROUP BY 1, 2)
SELECT o.list, o.n, w_plus, w_minus, least(w_plus, w_minus) AS statistic, round(least(1.0::DOUBLE, 2 * avg((w <= least(w_plus, w_minus))::INT)), 9) AS p_value, 'exact' AS method FROM o JOIN p USING (list) GROUP BY ALL""")
def wilcoxon_exact(spark, sf):
    out = None
    for name, values in DELTAS.items():
        one = stats.wilcoxon(spark.createDataFrame([(float(v),) for v in values], "delta double"), "delta").withColumn("list", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 9)


@query("""WITH r AS (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0::DOUBLE AS y FROM customer),
c AS (SELECT c_mktsegment, count(*) AS n, corr(x, y) AS rho FROM r GROUP BY 1), a AS (SELECT *, n - 2 AS df, atan2(abs(rho * sqrt((n - 2) / (1 - rho * rho))), sqrt((n - 2)::DOUBLE)) AS th FROM c),
t AS (SELECT *, list_sum(list_transform(range(0, (df - CASE WHEN df % 2 = 1 THEN 3 ELSE 2 END) // 2 + 1), lambda k: coalesce(list_product(list_transform(range(1, k + 1), lambda j: cos(th) * cos(th) * CASE WHEN df % 2 = 1 THEN 2.0::DOUBLE * j / (2 * j + 1) ELSE (2.0::DOUBLE * j - 1) / (2 * j) END)), 1))) AS total FROM a)
SELECT c_mktsegment, n, round(rho, 6) AS rho, round(greatest(0, 1 - CASE WHEN df % 2 = 1 THEN 2 / pi() * (th + sin(th) * cos(th) * total) ELSE sin(th) * total END), 6) AS p_value FROM t""")
def spearman_rho(spark, sf):
    return rounded(stats.spearman(table(spark, sf, "customer"), "c_acctbal", "c_nationkey", ["c_mktsegment"]))


DRAWS, REPS = 100, 1000

#: CTE `mean` (country, class, mean_ap) beside raw and pk: the thinned cells.
MATCHED = SQL + ", e AS (SELECT country, class, patch_id, true_label, score FROM pred), tg AS (SELECT class, avg(true_label) AS t FROM pred WHERE s2_split = 'test' GROUP BY 1)" + ranking_sql("e", "country, class", "raw") + f""", sz AS (SELECT country, class, sum(true_label)::BIGINT AS pos, sum(1 - true_label)::BIGINT AS neg FROM e GROUP BY 1, 2),
pl AS (SELECT *, round_even(pos * (1 - t) / t, 0)::BIGINT AS nn, round_even(neg * t / (1 - t), 0)::BIGINT AS np FROM sz JOIN tg USING (class) WHERE pos > 0 AND neg > 0 AND t > 0 AND t < 1),
pk AS (SELECT country, class, CASE WHEN nn <= neg THEN 'subsample_neg' ELSE 'subsample_pos' END AS mode, CASE WHEN nn <= neg THEN pos ELSE np END AS tp, CASE WHEN nn <= neg THEN nn ELSE neg END AS tn FROM pl WHERE nn <= neg OR (np > 0 AND np <= pos)),
rk AS (SELECT e.*, pk.tp AS take_pos, pk.tn AS take_neg, row_number() OVER (PARTITION BY country, class, true_label ORDER BY md5('{SEED}:' || country || ':' || class || ':' || patch_id), patch_id) - 1 AS r, count(*) OVER (PARTITION BY country, class, true_label) AS n FROM e JOIN pk USING (country, class)),
kp AS (SELECT * FROM rk, (VALUES {", ".join(f"({d}, {p}::BIGINT, {c}::BIGINT)" for d, p, c in sampling.thinning(DRAWS, SEED))}) x(draw, factor, shift) WHERE (r * factor + shift) % n < CASE WHEN true_label = 1 THEN take_pos ELSE take_neg END)""" + ranking_sql("kp", "country, class, draw", "dc") + ", mean AS (SELECT country, class, avg(ap) AS mean_ap FROM dc GROUP BY 1, 2)"


def matched(spark, sf):
    pred = standin.predictions(spark, sf, standin.patches(spark, sf).select("patch_id", "country", "s2_split"))
    target = pred.where("s2_split = 'test'").groupBy("class").agg(F.avg("true_label").alias("prevalence"))
    return sampling.prior_matched(pred, target, ["country", "class"], ["class"], DRAWS, SEED)


@query(MATCHED + " SELECT country, class, round(raw.ap, 6) AS raw_ap, round(mean_ap, 6) AS mean_ap, mode, (pk.tp + pk.tn)::BIGINT AS n_kept FROM mean JOIN raw USING (country, class) JOIN pk USING (country, class)")
def prior_matched_ap(spark, sf):
    return rounded(matched(spark, sf))


@query(MATCHED + ", t2 AS (SELECT * FROM pred WHERE s2_split = 'test')" + ranking_sql("t2", "class", "rf") + """, g AS (SELECT class, avg(raw.ap) AS raw, avg(mean_ap) AS matched FROM mean JOIN raw USING (country, class) GROUP BY 1)
SELECT round(100 * (avg(rf.ap) - avg(raw)), 6) AS raw_gap, round(100 * (avg(rf.ap) - avg(matched)), 6) AS matched_gap, round(100 * (avg(matched) - avg(raw)), 6) AS explained FROM g JOIN rf USING (class) WHERE rf.ap IS NOT NULL""")
def prior_matched_gap(spark, sf):
    """The gap between the official test part and the countries, raw, after matching priors, and what that explains."""
    test = metrics.ranking(s2(spark, sf).where("role = 'test'"), ["class"])
    return rounded(sampling.prior_gap(matched(spark, sf), test))


def _boot_sql(cluster: str, source: str) -> str:
    return f""", e AS ({source}), nm AS (SELECT {cluster} AS cl, row_number() OVER (ORDER BY md5('{SEED}:' || {cluster}), {cluster}) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT {cluster} FROM e)),
dw AS (SELECT rep, ('0x' || substr(md5('{SEED}:' || rep || ':' || j), 1, 8))::BIGINT % n AS k FROM (SELECT unnest(range({REPS})) AS rep), (SELECT n, unnest(range(n)) AS j FROM (SELECT max(n) AS n FROM nm))),
tm AS (SELECT rep, cl, count(*) AS w FROM dw JOIN nm USING (k) GROUP BY 1, 2),
small AS (SELECT {cluster}, class, score, sum(true_label) AS pos, count(*) AS n FROM e GROUP BY 1, 2, 3),
c0 AS (SELECT rep, class, score, sum(w * pos) AS pos, sum(w * n) AS n FROM small JOIN tm ON cl = {cluster} GROUP BY 1, 2, 3), c1 AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k FROM c0 WINDOW w AS (PARTITION BY rep, class ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
c2 AS (SELECT rep, class, sum(pos * (tp::DOUBLE / k)) / nullif(sum(pos), 0)::DOUBLE AS ap, sum((n - pos) * (tp - pos / 2.0::DOUBLE)) / nullif(sum(pos)::DOUBLE * (sum(n) - sum(pos)), 0) AS auroc FROM c1 GROUP BY 1, 2),
c3 AS (SELECT rep, avg(ap) AS ap_macro, avg(auroc) AS auroc_macro FROM c2 GROUP BY 1)
SELECT count(*) AS n_replicates, round(avg(ap_macro), 6) AS ap_macro_mean, round(quantile_cont(ap_macro, 0.025), 6) AS ap_macro_low, round(quantile_cont(ap_macro, 0.975), 6) AS ap_macro_high, round(avg(auroc_macro), 6) AS auroc_macro_mean, round(quantile_cont(auroc_macro, 0.025), 6) AS auroc_macro_low, round(quantile_cont(auroc_macro, 0.975), 6) AS auroc_macro_high FROM c3"""


def _s2_test(spark, sf):
    return standin.predictions(spark, sf, standin.patches(spark, sf).where("s2_split = 'test'").select("patch_id", "tile"))


def _s2_interval(spark, sf, cluster):
    return rounded(sampling.interval(sampling.bootstrap_many(_s2_test(spark, sf), cluster, REPS, SEED), []))


@query(SQL + _boot_sql("tile", "SELECT patch_id, tile, class, true_label, score FROM pred WHERE s2_split = 'test'"))
def tile_bootstrap_ci(spark, sf):
    return _s2_interval(spark, sf, "tile")


@query(SQL + _boot_sql("patch_id", "SELECT patch_id, tile, class, true_label, score FROM pred WHERE s2_split = 'test'"))
def patch_bootstrap_ci(spark, sf):
    return _s2_interval(spark, sf, "patch_id")


@query(SQL + _boot_sql("tile", "SELECT patch_id, tile, class, true_label, score FROM pred WHERE s1_split = 'test'"))
def tile_bootstrap_1000(spark, sf):
    """The same on the test part of the random split."""
    test = standin.split(spark, sf).where("s1_split = 'test'").select("patch_id", "tile")
    return rounded(sampling.interval(sampling.bootstrap_many(standin.predictions(spark, sf, test), "tile", REPS, SEED), []))


@query(S2SQL + """, t AS (SELECT *, rank() OVER (PARTITION BY patch_id ORDER BY score DESC, class) AS r FROM v WHERE role = 'test'), q AS (SELECT patch_id, max(CASE WHEN true_label = 1 THEN r END) AS deepest, max(CASE WHEN r = 1 THEN 1 - true_label END) AS miss FROM t GROUP BY 1),
l AS (SELECT a.patch_id, avg((b.score >= a.score)::INT) AS loss FROM t a JOIN t b ON a.patch_id = b.patch_id AND a.true_label = 1 AND b.true_label = 0 GROUP BY 1)
SELECT round(avg(miss), 6) AS one_error, round(avg(deepest - 1), 6) AS coverage, (SELECT round(avg(loss), 6) FROM l) AS ranking_loss FROM q""")
def ranking_loss_coverage(spark, sf):
    lists = s2(spark, sf).where("role = 'test'").groupBy("patch_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "class", "true_label"))).alias("l"))
    def loss(l):
        pos, neg = F.filter(l, lambda x: x["true_label"] == 1), F.filter(l, lambda x: x["true_label"] == 0)
        bad = F.aggregate(pos, F.lit(0), lambda s, p: s + F.size(F.filter(neg, lambda q: q["minus"] <= p["minus"])))
        return bad / F.nullif((F.size(pos) * F.size(neg)).cast("double"), F.lit(0.0))

    deepest = F.array_max(F.transform("l", lambda x, i: F.when(x["true_label"] == 1, i)))
    return rounded(lists.agg(F.avg((1 - F.get("l", 0)["true_label"]).cast("double")).alias("one_error"), F.avg(deepest.cast("double")).alias("coverage"), F.avg(loss(F.col("l"))).alias("ranking_loss")))


PIXELS = ("f_000", "f_001", "f_002", "f_003")


def _training_rows(spark, sf, regimes=labels_of.REGIMES):
    """(rows, label columns, classes): four pixel statistics per patch as features, six labels, the split columns of these regimes.

    Pixels are reduced to a row a patch before anything is joined to it, labels to bits; a patch without a known label has zeros.
    The official split is a column of the patch; the others need sizes and ranks over all patches, which are written for them."""
    items = table(spark, sf, "lineitem")
    px = items.groupBy(F.col("l_orderkey").alias("patch_id")).agg(F.avg("l_quantity").alias("f_000"), F.avg("l_extendedprice").alias("f_001"), F.max("l_discount").alias("f_002"), F.count("*").cast("double").alias("f_003"))
    classes = [r[0] for r in table(spark, sf, "part").select("p_type").distinct().orderBy("p_type").collect()]  # the class vocabulary
    names = [f"lbl_{i:02d}" for i in range(len(classes))]
    bits = standin.label_bits(spark, sf, classes)
    patches = standin.places(spark, sf).join(px, "patch_id").join(bits, "patch_id", "left")
    if set(regimes) <= {"s2"}:
        splits_of = ["s2_split"]
    else:
        patches = standin.split_of(materialise(patches, "patches")).withColumn("s3_fold", F.col("s3_fold").cast("string"))
        splits_of = ["s1_split", "s2_split", "s3_fold", "s4_fold"]
    return patches.select("patch_id", *PIXELS, *splits_of, *(standin.has_bit(i).alias(c) for i, c in enumerate(names))), names, classes


def _training(spark, sf, regimes=labels_of.REGIMES):
    """The same, written: what scales, fits and scores reads them again."""
    rows, names, classes = _training_rows(spark, sf, regimes)
    return materialise(rows, "rows"), names, classes


def _vectors(spark, sf):
    """The same as scaled vectors, with the official roles."""
    rows, names, classes = _training(spark, sf, ("s2",))
    rows = rows.withColumn("role", F.col("s2_split"))
    return ml.feature_vectors(rows, PIXELS, ["patch_id", "role"], ["patch_id", "role", *names]), names, classes


@query()
def binary_relevance_lr(spark, sf):
    v, labels, classes = _vectors(spark, sf)
    return ml.binary_relevance(v, labels, ml.Run("s2", learner="lr"), classes)[0]


@query()
def binary_relevance_rf(spark, sf):
    v, labels, classes = _vectors(spark, sf)
    return ml.binary_relevance(v, labels, ml.Run("s2", learner="rf"), classes)[0]


@query(SQL + "SELECT class AS label_name, role, count(*) AS n, sum(true_label)::DOUBLE AS n_pos FROM (SELECT class, s2_split AS role, true_label, max(true_label) FILTER (s2_split = 'train') OVER (PARTITION BY class) AS able FROM pred) WHERE able = 1 AND role <> 'train' GROUP BY 1, 2")
def training_scored(spark, sf):
    """What a run scores: each label with a training positive, on its validation and test rows."""
    v, labels, classes = _vectors(spark, sf)
    out = ml.binary_relevance(v, labels, ml.Run("s2", learner="lr"), classes)[0]
    inside = out.where("probability > 0 AND probability < 1")
    return inside.groupBy("label_name", "role").agg(F.count("*").alias("n"), F.sum("true_label").alias("n_pos"))


@query()
def hp_grid(spark, sf):
    """Macro AP on the validation part for each point of the grid of both learners, over all labels."""
    v, labels, classes = _vectors(spark, sf)
    cells = ml.grid_cells(v, labels, classes, ml.grid(ml.Run("s2")))
    return rounded(metrics.macro(cells, ["run_id"], ["ap"]).select("ap_macro", "ap_used", "run_id"))


@query(SQL + """, t AS (SELECT count(DISTINCT patch_id) AS n, count(DISTINCT patch_id) FILTER (s2_split = 'train') AS n_train FROM pred)
SELECT 's2_lr_reg0.01_seed42' AS run_id, 's2' AS regime, '' AS fold, 'lr' AS learner, 42 AS seed, 0.01::DOUBLE AS reg_param, n AS n_joined_rows, n_train AS n_train_rows, true AS cpu_bounded, true AS energy_follows FROM t""")
def run_stats(spark, sf):
    """The record of a run as it was written: parameters, rows, CPU time within cores x wall time, energy by its formula."""
    rows, labels, classes = _training(spark, sf)
    root = new_path(spark, "run")
    ml.run_all(rows, PIXELS, ["patch_id", "s1_split", "s2_split", "s3_fold", "s4_fold"], labels, classes, [ml.Run("s2", max_iter=10)], root)
    cpu, cores = F.col("total_executor_cpu_time_seconds"), spark.sparkContext.defaultParallelism
    bounded = (cpu > 0) & (cpu <= F.col("wall_clock_seconds") * cores * 1.05)
    follows = F.abs(F.col("co2e_grams") - cpu * accounting.WATTS_PER_CORE * accounting.FACILITY / 3_600_000 * accounting.GRAMS_PER_KWH) < 1e-9
    kept = ("run_id", "regime", "fold", "learner", "seed", "reg_param", "n_joined_rows", "n_train_rows")
    return ml.records(spark, root).select(*kept, bounded.alias("cpu_bounded"), follows.alias("energy_follows"))


LADDER = SQL + """, r AS (SELECT 's1' AS regime, '' AS fold, s1_split AS role, class, true_label FROM pred UNION ALL SELECT 's2', '', s2_split, class, true_label FROM pred
UNION ALL SELECT 's3', f, CASE WHEN s3_fold::VARCHAR = f THEN 'test' ELSE 'train' END, class, true_label FROM pred, (SELECT DISTINCT s3_fold::VARCHAR AS f FROM split)
UNION ALL SELECT 's4', f, CASE WHEN s4_fold = f THEN 'test' ELSE 'train' END, class, true_label FROM pred, (SELECT DISTINCT s4_fold AS f FROM split)),
able AS (SELECT regime, fold, class FROM r WHERE role = 'train' GROUP BY ALL HAVING sum(true_label) > 0)
SELECT regime || CASE WHEN fold = '' THEN '' ELSE '_' || fold END || '_lr_reg0.01_seed42' AS run_id, count(*) AS n_scored, count(DISTINCT class) AS n_labels, sum(true_label)::DOUBLE AS n_pos FROM r JOIN able USING (regime, fold, class) WHERE role <> 'train' GROUP BY 1
"""


@query(LADDER)
def experiment_ladder(spark, sf):
    """Every fold of every regime, trained and scored; what each run has scored."""
    rows, labels, classes = _training(spark, sf)
    rows = rows.persist()
    folds = {c: [r[0] for r in rows.select(c).distinct().orderBy(c).collect()] for c in ("s3_fold", "s4_fold")}  # fold names
    runs = ml.ladder({"s1": [None], "s2": [None], "s3": folds["s3_fold"], "s4": folds["s4_fold"]}, ml.Run("s1"))
    out = ml.run_all(rows, PIXELS, ["patch_id", "s1_split", "s2_split", "s3_fold", "s4_fold"], labels, classes, runs, new_path(spark, "ladder"))[0]
    rows.unpersist()
    return out.groupBy("run_id").agg(F.count("*").alias("n_scored"), F.count_distinct("label_name").alias("n_labels"), F.sum("true_label").alias("n_pos"))


@query()
def single_label_forest(spark, sf):
    """The older single-label path: order priority from four pixel statistics, on the quarter held out by hash."""
    px = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("patch_id")).agg(F.avg("l_quantity").alias("a"), F.avg("l_extendedprice").alias("b"), F.max("l_discount").alias("c"), F.count("*").cast("double").alias("d"))
    rows = px.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("patch_id"), "o_orderpriority"), "patch_id")
    train, test = ml.hash_split(rows, 0.75, SEED)
    return ml.single_label_votes(train, test, ["a", "b", "c", "d"], "o_orderpriority").select("patch_id", "o_orderpriority", "label_index", "prediction")


@query("SELECT user_id, true AS complete FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def complete_groups_stream(spark, sf):
    """The events as a stream that ends (AvailableNow), with the seen kinds as state."""
    from ..streaming.complete_groups import complete_groups_stream as stream

    batch = table(spark, sf, "events")
    kinds = [r[0] for r in batch.select("event_type").distinct().orderBy("event_type").collect()]  # the kinds of a complete group
    root = new_path(spark, "stream")
    events = spark.readStream.schema(batch.schema).parquet(f"{sf}/events.parque[t]").select("user_id", "event_type")
    out = stream(events, "user_id", "event_type", kinds)
    out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id bigint, n_events bigint, complete boolean").parquet(f"{root}/out").select("user_id", "complete")
