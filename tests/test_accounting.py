"""Task accounting against Spark's own record while that is whole, and beyond its bound."""

from pyspark.sql import functions as F

from patchwright.operators import accounting


def from_status(spark):
    """CPU seconds of the stages that Spark still has a record of."""
    jvm, sc = spark._jvm, spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(jvm.double, 0), none)
    return {(s.stageId(), s.attemptId()): s.executorCpuTime() / 1e9 for s in (stages.apply(k) for k in range(stages.size()))}


def load(spark):
    spark.range(0, 400_000, 1, 4).select(F.sum(F.length(F.sha2(F.col("id").cast("string"), 512)))).collect()


def test_equals_sparks_record(spark):
    accounting.usage(spark)
    seen = from_status(spark)
    with accounting.measured(spark) as cost:
        for _ in range(3):
            load(spark)
    now = from_status(spark)
    want = sum(v for k, v in now.items() if k not in seen)
    assert abs(cost.used.cpu_seconds - want) <= 0.05 * want
    assert cost.used.stages >= 3 and cost.used.tasks >= 12 and cost.used.failed_stages == 0
    assert 0 < cost.used.cpu_seconds <= 1.05 * 4 * cost.wall_seconds


def test_never_falls_beyond_what_spark_keeps(spark):
    """More stages than Spark keeps a record of: totals go on rising."""
    load(spark)
    before, last = accounting.usage(spark), 0.0
    for k in range(1_100):
        spark.sparkContext._jsc.sc().range(0, 1, 1, 1).count()
        if k % 100 == 0:
            now = accounting.usage(spark).cpu_seconds
            assert now >= last
            last = now
    after = accounting.usage(spark)
    assert after.stages - before.stages == 1_100 and after.cpu_seconds > before.cpu_seconds


def test_failed_stages_and_energy(spark):
    before = accounting.usage(spark)
    try:
        spark.range(10).select(F.raise_error(F.lit("no"))).collect()
    except Exception:
        pass
    assert (accounting.usage(spark) - before).failed_stages == 1
    used = accounting.Usage(cpu_seconds=3600.0)
    assert used.energy_kwh() == 0.015 and used.co2e_grams() == 6.0 and used.energy_kwh(watts=30, facility=2.0) == 0.06
    assert spark.range(1).select(accounting.per_cpu_hour(F.lit(0.5), F.lit(1800)).alias("v"), accounting.per_cpu_hour(F.lit(0.5), F.lit(0)).alias("w")).first() == (1.0, None)
