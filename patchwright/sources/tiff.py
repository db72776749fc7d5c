"""A reader for baseline GeoTIFF bands: one grey sample of unsigned 8, 16 or 32 bits, strips or tiles, plain or deflate, with or without predictor 2."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SIZES = {1: "B", 3: "H", 4: "I", 16: "Q"}


def decode(data: bytes) -> np.ndarray:
    """The 2-D array of a band; ValueError for anything else."""
    if data[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF")
    e = "<" if data[:2] == b"II" else ">"
    if struct.unpack(e + "H", data[2:4])[0] != 42:
        raise ValueError("not a classic TIFF")
    at = struct.unpack(e + "I", data[4:8])[0]
    n = struct.unpack(e + "H", data[at : at + 2])[0]
    tags: dict[int, list[int]] = {}
    for k in range(n):
        tag, kind, count = struct.unpack(e + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind in _SIZES:
            form = f"{e}{count}{_SIZES[kind]}"
            size = struct.calcsize(form)
            place = at + 10 + 12 * k if size <= 4 else struct.unpack(e + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
            tags[tag] = list(struct.unpack(form, data[place : place + size]))
    one = lambda tag, default=None: tags.get(tag, [default])[0]
    width, height, bits, packing = one(256), one(257), one(258, 1), one(259, 1)
    if one(277, 1) != 1 or bits not in (8, 16, 32) or packing not in (1, 8, 32946):
        raise ValueError(f"unsupported TIFF: {one(277, 1)} samples of {bits} bits, compression {packing}")
    dtype = np.dtype(f"{e}u{bits // 8}")
    tiled = 322 in tags
    tw, th = (one(322), one(323)) if tiled else (width, one(278, height))
    offsets, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    out, across = np.zeros((height, width), dtype.newbyteorder("=")), -(-width // tw)
    for k, (o, c) in enumerate(zip(offsets, counts, strict=True)):
        raw = data[o : o + c]
        block = np.frombuffer(raw if packing == 1 else zlib.decompress(raw), dtype)
        block = block[: len(block) // tw * tw].reshape(-1, tw)
        if one(317, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("="))
        r, q = (k // across * th, k % across * tw) if tiled else (k * th, 0)
        h, w = min(len(block), height - r), min(tw, width - q)
        out[r : r + h, q : q + w] = block[:h, :w]
    return out


def encode(a: np.ndarray, deflate: bool = True) -> bytes:
    """A one-strip little-endian TIFF of a uint16 array."""
    raw = a.astype("<u2").tobytes()
    body = zlib.compress(raw) if deflate else raw
    tags = [(256, 4, a.shape[1]), (257, 4, a.shape[0]), (258, 3, 16), (259, 3, 8 if deflate else 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, a.shape[0]), (279, 4, len(body))]
    at = 8 + len(body) + len(body) % 2
    entries = b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v)) for t, k, v in tags)
    return b"II*\0" + struct.pack("<I", at) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(tags)) + entries + b"\0" * 4


def decode_column(content: Column, zero_fill: int | None = None) -> Column:
    """struct(height, width, values array<int>) of a band, the values of a batch in one buffer; null where it cannot be decoded, or zero_fill^2 zeros if asked for (which hides damage)."""
    @F.arrow_udf("height int, width int, values array<int>")
    def run(column: pa.Array) -> pa.Array:
        images: list[np.ndarray | None] = []
        for data in column:
            try:
                images.append(decode(data.as_buffer().to_pybytes()))
            except (ValueError, TypeError, KeyError, IndexError, AttributeError, struct.error, zlib.error):
                images.append(np.zeros((zero_fill, zero_fill), np.uint16) if zero_fill else None)
        lost = np.array([a is None for a in images], bool)
        ends = np.cumsum([0, *(0 if a is None else a.size for a in images)])
        flat = [a.ravel().astype(np.uint32).view(np.int32) for a in images if a is not None]  # 32 bits keep their pattern
        values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int32()))
        size = [pa.array([0 if a is None else a.shape[k] for a in images], pa.int32()) for k in (0, 1)]
        return pa.StructArray.from_arrays([*size, values], names=["height", "width", "values"], mask=pa.array(lost))

    return run(content)


def files(spark, path: str, band_glob: str = "*.tif") -> DataFrame:
    """Unpacked rasters: path and content of the files of the wanted bands."""
    return spark.read.format("binaryFile").option("pathGlobFilter", band_glob).option("recursiveFileLookup", True).load(path).select("path", "content")


def bands(spark, path: str, patches: DataFrame, wanted: Sequence[str], zero_fill: int | None = None) -> DataFrame:
    """(patch_id, band, status, image) of every wanted band of every patch (column patch_id) from <path>/<patch>/<patch>_<band>.tif, or else <path>/<patch>/<band>.tif.

    status: `named`, `fallback` (by the second name), `damaged` (no readable raster) or `missing` (no file): what fails is a row as well.
    With zero_fill, images of the last two are zero_fill^2 zeros, and the status still says so; else they are null."""
    part = lambda k: F.element_at(F.split("path", "/"), -k)
    found = files(spark, path).select(part(2).alias("patch"), F.regexp_replace(part(1), r"\.tif$", "").alias("stem"), "content")
    own = F.col("stem") == F.concat_ws("_", "patch", F.substring_index("stem", "_", -1))
    band = F.when(own, F.substring_index("stem", "_", -1)).otherwise(F.col("stem"))
    found = found.select("patch", band.alias("b"), own.alias("own"), "content").where(F.col("b").isin(list(wanted)))
    best = found.groupBy("patch", "b").agg(F.max_by(F.struct("own", "content"), F.col("own")).alias("file"))  # at most two files
    cells = patches.select(F.col("patch_id").cast("string").alias("patch_id")).distinct().select("patch_id", F.explode(F.array(*map(F.lit, wanted))).alias("band"))
    joined = cells.join(best, (F.col("patch_id") == F.col("patch")) & (F.col("band") == F.col("b")), "left")
    image = joined.select("patch_id", "band", F.col("file.own").alias("own"), F.col("file").isNotNull().alias("there"), decode_column(F.col("file.content")).alias("image"))
    status = F.when(~F.col("there"), "missing").when(F.col("image").isNull(), "damaged").when(F.col("own"), "named").otherwise("fallback")
    out = image.select("patch_id", "band", status.alias("status"), "image")
    if zero_fill is None:
        return out
    zeros = F.struct(F.lit(zero_fill).alias("height"), F.lit(zero_fill).alias("width"), F.array_repeat(F.lit(0), zero_fill**2).alias("values"))
    return out.withColumn("image", F.coalesce("image", zeros))
