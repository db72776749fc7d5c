"""Queries over sources and sinks: what is written is read again; and the parts of the older path that are measured."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import REGIMES, evaluated_roles
from ..operators import accounting, ml
from ..schema import prefixed, with_patch_id
from ..sources import tables
from ..sources.storage import new_path
from . import standin
from .registry import query, rounded
from .relational import SINGLE, _single, band_stats
from .standin import SQL, table


@query(SQL + "SELECT s2_split AS role, class, count(*) AS n, sum(score)::BIGINT AS total FROM pred WHERE s2_split = 'test' AND class <> 'ECONOMY' GROUP BY 1, 2")
def partitioned_predictions(spark, sf):
    """Predictions in folders by role and class, written twice: a repeated run replaces its own folders; filters prune them."""
    root = new_path(spark, "predictions")
    rows = standin.predictions(spark, sf, standin.patches(spark, sf).select("patch_id", F.col("s2_split").alias("role")))
    tables.write_partitioned(rows, root, ["role", "class"])
    tables.write_partitioned(rows.where("class = 'ECONOMY'"), root, ["role", "class"])
    read = tables.predictions(spark, root).where("role = 'test' AND class <> 'ECONOMY'")
    return read.groupBy("role", "class").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total, min(c_name) AS first_name FROM customer GROUP BY 1")
def csv_round_trip(spark, sf):
    path = new_path(spark, "csv")
    customers = table(spark, sf, "customer")
    tables.write_csv(customers, path)
    read = tables.csv(spark, path, customers.schema)
    return read.groupBy("c_mktsegment").agg(F.count("*").alias("n"), (F.round(F.sum("c_acctbal"), 2) + F.lit(0.0)).alias("total"), F.min("c_name").alias("first_name"))


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def json_round_trip(spark, sf):
    """A small statistics document: written as JSON and read with its schema."""
    path = new_path(spark, "json")
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tables.write_json(nation.groupBy("r_name").agg(F.count("*").alias("n")), path)
    return tables.json_documents(spark, path, "r_name string, n bigint", lines=True)


@query("SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_orderkey) AS n_keys FROM orders GROUP BY 1")
def append_resume(spark, sf):
    """An interrupted run goes on: what is there is left out of what is appended."""
    path = new_path(spark, "append")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    tables.append_missing(orders.where("o_orderkey % 3 <> 0"), path, ["o_orderkey"])
    tables.append_missing(orders, path, ["o_orderkey"])
    tables.append_missing(orders, path, ["o_orderkey"])
    return tables.parquet(spark, path).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_keys"))


@query("SELECT 'missing' AS label, false AS trained, NULL::BIGINT AS n UNION ALL SELECT 'there', true, (SELECT count(*) FROM region)")
def missing_label_is_none(spark, sf):
    """A label that was not trained has no folder."""
    root = new_path(spark, "labels")
    table(spark, sf, "region").write.parquet(f"{root}/there")
    found = {k: tables.parquet_or_none(spark, f"{root}/{k}") for k in ("missing", "there")}
    return spark.createDataFrame([(k, d is not None, None if d is None else d.count()) for k, d in found.items()], "label string, trained boolean, n bigint")


@query(" UNION ALL ".join(f"SELECT '{r}' AS regime, '{x}' AS role" for r in REGIMES for x in (("validation", "test") if r in ("s1", "s2") else ("test",))))
def evaluated_roles_table(spark, sf):
    return spark.createDataFrame([(r, x) for r in REGIMES for x in evaluated_roles(r)], "regime string, role string")


@query("SELECT l_orderkey AS patch_id, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_pop(l_quantity), 6) AS l_quantity_std, round(quantile_cont(l_quantity, 0.1), 6) AS l_quantity_p10, round(quantile_cont(l_quantity, 0.5), 6) AS l_quantity_p50, round(quantile_cont(l_quantity, 0.9), 6) AS l_quantity_p90, round(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 6) AS l_quantity_iqr FROM lineitem GROUP BY 1")
def prefixed_columns(spark, sf):
    """Columns by prefix, and the id column under its own name whichever alias it came with."""
    source = with_patch_id(band_stats(spark, sf).withColumnRenamed("patch_id", "name"))
    return source.select("patch_id", *prefixed(source, "l_quantity_"))


@query(SINGLE + """, c AS (SELECT a AS x, count(*) AS s, count(*) FILTER (a = p) AS tp, (SELECT count(*) FROM s q WHERE q.p = s.a) AS called FROM s GROUP BY 1),
w AS (SELECT s / sum(s) OVER ()::DOUBLE AS w, coalesce(tp / nullif(called, 0)::DOUBLE, 0) AS pr, tp / s::DOUBLE AS re FROM c)
SELECT round(sum(w * coalesce(2.0::DOUBLE * pr * re / nullif(pr + re, 0), 0)), 6) AS f1, (SELECT round(avg((a = p)::INT), 6) FROM s) AS accuracy, round(sum(w * pr), 6) AS "weightedPrecision", round(sum(w * re), 6) AS "weightedRecall" FROM w""")
def single_label_metrics(spark, sf):
    """The older path's four figures, each by an evaluator of its own."""
    s = _single(spark, sf)
    names = sorted(r[0] for r in s.select("o_orderpriority").distinct().collect())  # the label vocabulary
    index = lambda c: (F.array_position(F.array(*(F.lit(n) for n in names)), F.col(c)) - 1).cast("double")
    found = ml.single_label_metrics(s.select(index("o_orderpriority").alias("label_index"), index("guess").alias("prediction")))
    return rounded(spark.createDataFrame([found], "f1 double, accuracy double, weightedPrecision double, weightedRecall double"))


@query("SELECT count(*) AS n_rows, 4 AS n_batches, (SELECT count(*) FROM events) AS n_progress FROM events")
def stream_rate(spark, sf):
    """Four files at one a batch: the rate is bounded, and a listener has seen each batch."""
    from ..streaming.progress import ProgressLog, parquet_stream

    root = new_path(spark, "rate")
    events = table(spark, sf, "events")
    events.repartition(4).write.parquet(f"{root}/in")
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        run = parquet_stream(spark, f"{root}/in", events.schema, 1).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(log)
    seen = log.frame(spark).where(F.col("rows") > 0).agg(F.count("*").cast("int").alias("n_batches"), F.sum("rows").alias("n_progress"))
    return spark.read.schema(events.schema).parquet(f"{root}/out").agg(F.count("*").alias("n_rows")).crossJoin(F.broadcast(seen))  # one row


@query("SELECT count(*) AS n, 20 AS n_later, true AS grows, true AS bounded FROM lineitem")
def cpu_time(spark, sf):
    """CPU seconds of a job over lineitem: they grow by each of 20 further jobs, and stay within cores x wall time (a twentieth over for clocks)."""
    cores = spark.sparkContext.defaultParallelism
    with accounting.measured(spark) as one:
        n = table(spark, sf, "lineitem").select(F.sha2(F.concat_ws(",", "*"), 256).alias("h")).agg(F.count("h").alias("n")).first()[0]
    totals = [accounting.usage(spark).cpu_seconds]
    for _ in range(20):
        table(spark, sf, "nation").count()
        totals.append(accounting.usage(spark).cpu_seconds)
    steps = [a < b for a, b in zip(totals, totals[1:], strict=False)]
    bounded = 0 < one.used.cpu_seconds <= 1.05 * cores * one.wall_seconds
    return spark.createDataFrame([(n, len(steps), all(steps), bounded)], "n bigint, n_later int, grows boolean, bounded boolean")
