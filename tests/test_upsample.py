"""Upsampling computes its source once, not once a target cell."""

from pyspark.sql import functions as F

from patchwright.functions import raster


def test_source_is_computed_once(spark):
    source = F.array(*(F.rand(k) for k in range(4)))  # another value at every evaluation
    u = spark.range(1).select(raster.upsample(source, 2, 6).alias("u")).first().u
    rows = [u[k : k + 6] for k in range(0, 36, 6)]
    assert len(set(u)) == 4 and all(r[:3] == [r[0]] * 3 and r[3:] == [r[3]] * 3 for r in rows)
    assert rows[0] == rows[2] and rows[3] == rows[5]
