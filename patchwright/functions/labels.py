"""Label lists: multi-hot columns, dominant label, weights, roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

REGIMES = ("s1", "s2", "s3", "s4")


def parse_labels(text: Column) -> Column:
    """A label list out of its JSON text; null where it is no list."""
    return F.from_json(text, "array<string>")


def multi_hot(labels: Column, classes: Sequence[str]) -> list[Column]:
    return [F.array_contains(labels, c).cast("int").alias(f"lbl_{i:02d}") for i, c in enumerate(classes)]


def dominant_label(labels: Column, areas: Column | None = None) -> Column:
    """The class of the largest area (of equals the first by name), else the first label, else Unknown."""
    first = F.get(labels, 0)
    if areas is None:
        return F.coalesce(first, F.lit("Unknown"))
    best = F.array_min(F.transform(F.map_entries(areas), lambda e: F.struct((-e["value"]).alias("area"), e["key"].alias("name"))))["name"]
    return F.coalesce(best, first, F.lit("Unknown"))


def class_weight(label: Column, n_total: Column, n_pos: Column) -> Column:
    """Balanced weights total / (2 n of the class); 1 for a class that is absent."""
    n_neg = n_total - n_pos
    w_pos = F.when(n_pos > 0, n_total / (2.0 * n_pos)).otherwise(1.0)
    w_neg = F.when(n_neg > 0, n_total / (2.0 * n_neg)).otherwise(1.0)
    return F.when(label == 1, w_pos).otherwise(w_neg)


def role(regime: str, fold: str | int | None = None) -> Column:
    """The role of a patch under a regime: s1 and s2 carry it, s3 and s4 test on one fold and train on the rest."""
    if regime == "s1":
        return F.col("s1_split" if fold is None else f"s1_split_{fold}")
    if regime == "s2":
        return F.col("s2_split")
    if regime in ("s3", "s4"):
        return F.when(F.col(f"{regime}_fold") == F.lit(fold), "test").otherwise("train")
    raise ValueError(f"unknown regime {regime}")


def evaluated_roles(regime: str) -> tuple[str, ...]:
    """The roles a regime scores; only the first two have a validation part to tune on."""
    if regime not in REGIMES:
        raise ValueError(f"unknown regime {regime}")
    return ("validation", "test") if regime in ("s1", "s2") else ("test",)
