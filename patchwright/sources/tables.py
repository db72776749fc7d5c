"""Table, document and raster sources, and sinks, by what the pipeline does with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from .storage import discard, materialise


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def parquet_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """None where nothing was written: a label that was not trained."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def predictions(spark: SparkSession, root: str) -> DataFrame:
    """All runs as one frame; regime, fold, learner, label and role come from the folders, so filters on them prune."""
    return spark.read.option("basePath", root).parquet(root)


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def json_documents(spark: SparkSession, path: str, schema: StructType | str | None = None, lines: bool = False) -> DataFrame:
    """JSON documents: one a file, over any number of lines, or one a line."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def synthetic_rasters(spark: SparkSession, patches: int, size: int, bands: Sequence[str], seed: int = 42) -> DataFrame:
    """Random rasters of size x size values from 500 to 3999."""
    cells = lambda b: F.transform(F.sequence(F.lit(1), F.lit(size * size)), lambda i: 500 + F.pmod(F.xxhash64(F.lit(seed), F.lit(b), F.col("id"), i), F.lit(3500)).cast("int"))
    return spark.range(patches).select(F.col("id").cast("string").alias("patch_id"), *(cells(b).alias(b) for b in bands))


def synthetic_predictions(spark: SparkSession, patches: int, classes: int, positive: float = 0.15, seed: int = 42) -> DataFrame:
    """Labels with noisy scores; class 0 is all positive."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id", "class"), F.lit(1_000_003)) / 1_000_003.0
    base = spark.range(patches).withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    label = F.when(F.col("class") == 0, 1).otherwise((u(1) < positive).cast("int"))
    return base.select(F.col("id").cast("string").alias("patch_id"), "class", label.alias("true_label"), F.round(0.5 * label + 0.5 * u(2), 3).alias("score"))


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], one_file_each: bool = False) -> None:
    """Parquet under by=value folders; only the folders in df are replaced, so a repeated run is idempotent. Without one_file_each a hot folder stays spread over its tasks."""
    (df.repartition(*by) if one_file_each else df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a line, properly escaped. For documents that are small by nature (statistics, thresholds), in one file."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_missing(df: DataFrame, path: str, key: Sequence[str]) -> int:
    """Appends the rows whose key is not yet there: the resume of an interrupted run. Returns how many.

    They are written aside before, so that what is counted is what is appended."""
    done = parquet_or_none(df.sparkSession, path)
    fresh = materialise(df if done is None else df.join(done.select(*key), list(key), "left_anti"), "fresh")
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    discard(fresh)
    return n


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A report table of the first rows of a small frame."""
    rows = df.limit(limit).collect()
    head = f"# {title}\n\n| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows)
