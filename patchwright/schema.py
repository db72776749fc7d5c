"""Schemas, the class vocabulary and the guards that stop a pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

N_FEATURES = 110


def _struct(**fields) -> StructType:
    return StructType([StructField(k, t) for k, t in fields.items()])


METADATA = _struct(patch_id=StringType(), labels=ArrayType(StringType()), split=StringType(), country=StringType(), s1_name=StringType(), s2v1_name=StringType(), contains_seasonal_snow=BooleanType(), contains_cloud_or_shadow=BooleanType())
SPLITS = _struct(patch_id=StringType(), s1_split=StringType(), s2_split=StringType(), s3_fold=LongType(), s4_fold=StringType(), s1_split_seed123=StringType(), s1_split_seed7=StringType())
PREDICTIONS = _struct(patch_id=StringType(), role=StringType(), label_idx=IntegerType(), label_name=StringType(), true_label=DoubleType(), probability=DoubleType())
RUN_STATS = _struct(run_id=StringType(), regime=StringType(), fold=StringType(), learner=StringType(), seed=LongType(), n_joined_rows=LongType(), n_train_rows=LongType(), wall_clock_seconds=DoubleType())


def feature_columns(n: int = N_FEATURES) -> list[str]:
    return [f"f_{i:03d}" for i in range(n)]


def label_columns(n: int) -> list[str]:
    return [f"lbl_{i:02d}" for i in range(n)]


def features_schema(n_labels: int, n_features: int = N_FEATURES) -> StructType:
    ids = _struct(patch_id=StringType(), tile=StringType(), gx=LongType(), gy=LongType(), month=LongType(), year=LongType(), country=StringType(), split_official=StringType())
    return StructType([*ids.fields, *(StructField(c, LongType()) for c in label_columns(n_labels)), *(StructField(c, FloatType()) for c in feature_columns(n_features))])


def prefixed(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def with_patch_id(df: DataFrame, aliases: Sequence[str] = ("name", "patch_name")) -> DataFrame:
    """The id column under its own name, whichever alias it came with."""
    if "patch_id" in df.columns:
        return df
    found = [a for a in aliases if a in df.columns]
    if not found:
        raise ValueError(f"no id column among {df.columns}")
    return df.withColumnRenamed(found[0], "patch_id")


def require_features(columns: Sequence[str], metadata: Sequence[str]) -> list[str]:
    """The leak guard: metadata may never be a model input."""
    leaks = sorted(set(columns) & set(metadata) | {c for c in columns if c.startswith("lbl_")})
    if leaks:
        raise ValueError(f"metadata among the features: {leaks}")
    return list(columns)


def unknown_classes(df: DataFrame, labels: str, classes: Sequence[str]) -> DataFrame:
    """(class, side): classes only in the data, or only in the vocabulary. Empty where both agree."""
    seen = df.select(F.explode(labels).alias("class")).distinct()
    known = df.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    return seen.exceptAll(known).select("class", F.lit("data").alias("side")).unionByName(known.exceptAll(seen).select("class", F.lit("vocabulary").alias("side")))


def require_classes(df: DataFrame, labels: str, classes: Sequence[str]) -> DataFrame:
    wrong = unknown_classes(df, labels, classes).collect()
    if wrong:
        raise ValueError(f"label set differs from the vocabulary: {[tuple(r) for r in wrong]}")
    return df


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
