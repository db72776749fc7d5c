"""Cells of the stand-in data are made after all joins of patches."""

from patchwright.plans import standin


def test_no_join_carries_cells(spark, small):
    plan = standin.evaluated(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate explode(_every")]
    assert "Join" not in above and "Aggregate" not in above


def test_patches_without_labels_have_all_cells(spark, small):
    of = spark.createDataFrame([(1, "a"), (-5, "b"), (-5, "c")], "patch_id bigint, note string")
    cells = standin.label_cells(spark, small, of)
    assert cells.columns == ["patch_id", "note", "class", "label"]
    rows, names = cells.collect(), {r["class"] for r in standin.labels(spark, small).select("class").distinct().collect()}
    own = {r["class"] for r in standin.labels(spark, small).where("patch_id = 1").collect()}
    assert own and len(rows) == 3 * len(names) and {r["class"] for r in rows if r.label == 1} == own
    assert all(r.label == int(r.patch_id == 1 and r["class"] in own) for r in rows)
