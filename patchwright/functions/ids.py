"""Scene identifiers and archive paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the form of a scene id.
SCENE_ID = r"^(S2[AB])_(MSIL2A)_(\d{8}T\d{6})_(N\d{4})_(R\d{3})_(T\w{5})_(\d+)_(\d+)$"


def parse_scene_id(scene: Column, strict: bool = False) -> Column:
    """struct(tile, gx, gy, year, month); an id of another form is null, or an error if strict."""
    def group(n: int) -> Column:
        return F.regexp_extract(scene, SCENE_ID, n)

    taken = group(3)
    fields = F.struct(
        group(6).alias("tile"),
        group(7).cast("bigint").alias("gx"),
        group(8).cast("bigint").alias("gy"),
        F.substring(taken, 1, 4).cast("bigint").alias("year"),
        F.substring(taken, 5, 2).cast("bigint").alias("month"),
    )
    ok = F.when(scene.rlike(SCENE_ID), fields)
    return F.coalesce(ok, F.raise_error(F.concat(F.lit("not a scene id: "), F.coalesce(scene, F.lit("null")))).cast("struct<tile:string,gx:bigint,gy:bigint,year:bigint,month:bigint>")) if strict else ok


def folder_name(scene: Column) -> Column:
    """The id without its last two tokens."""
    return F.regexp_extract(scene, r"^(.*)_[^_]*_[^_]*$", 1)


def path_parts(path: Column) -> Column:
    """struct(depth, top, folder, patch, band, extension) of an archive member's path."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    return F.struct(
        F.size(parts).alias("depth"),
        F.get(parts, 0).alias("top"),
        F.when(F.size(parts) >= 3, F.element_at(parts, -3)).alias("folder"),
        F.when(F.size(parts) >= 2, F.element_at(parts, -2)).alias("patch"),
        F.regexp_extract(name, r"_([^_.]+)\.[^.]*$", 1).alias("band"),
        F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"),
    )


def has_suffix(text: Column, suffixes: list[str]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | F.endswith(text, F.lit(s))
    return out
