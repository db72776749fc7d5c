"""The older single-label path: features, confusion matrix, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spectral import legacy_index


def legacy_features(pixels: DataFrame, keys: Sequence[str], blue: Column, green: Column, red: Column, nir: Column) -> DataFrame:
    """NDVI and NDWI means, and mean and std of four scaled bands, per patch."""
    aggs = [F.avg(legacy_index(nir, red)).alias("ndvi"), F.avg(legacy_index(green, nir)).alias("ndwi")]
    for name, c in (("b02", blue), ("b03", green), ("b04", red), ("b08", nir)):
        aggs += [F.avg(c / 10000.0).alias(f"{name}_mean"), F.stddev_pop(c / 10000.0).alias(f"{name}_std")]
    return pixels.groupBy(*keys).agg(*aggs)


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n) over the sorted union of both label sets, zeros included."""
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    names = counts.select(F.explode(F.array("actual", "predicted")).alias("label")).distinct()
    grid = names.select(F.col("label").alias("actual")).crossJoin(F.broadcast(names.select(F.col("label").alias("predicted"))))  # label names only
    return grid.join(counts, ["actual", "predicted"], "left").fillna(0, ["n"])


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support) per class, then accuracy, macro and weighted averages."""
    both = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    side = both.select(F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called"), F.lit(0).cast("bigint").alias("tp")))).alias("x")).select("x.*")
    per = side.groupBy("label").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("tp").alias("tp"))
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0)), F.lit(0.0))
    per = per.withColumn("precision", ratio("tp", "called")).withColumn("recall", ratio("tp", "support"))
    per = per.withColumn("f1", F.coalesce(2.0 * F.col("tp") / F.nullif((F.col("called") + F.col("support")).cast("double"), F.lit(0.0)), F.lit(0.0)))
    cols = ["precision", "recall", "f1"]
    macro = per.agg(F.lit("macro avg").alias("label"), *(F.avg(c).alias(c) for c in cols), F.sum("support").alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("label"), *((F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in cols), F.sum("support").alias("support"))
    accuracy = per.agg(F.lit("accuracy").alias("label"), *((F.sum("tp") / F.sum("support")).alias(c) for c in cols), F.sum("support").alias("support"))
    return per.select("label", *cols, "support").unionByName(accuracy).unionByName(macro).unionByName(weighted)


def indexed(df: DataFrame, label: str) -> DataFrame:
    """(label, index, n): labels numbered by falling frequency, equals by name, like a string indexer."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("index", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "label")) - 1)  # one row per label
