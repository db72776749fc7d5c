"""Queries: archives that are made from given tables, read by ranges of frames, as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import seeded_int
from ..sources import archive, seekable, tiff
from ..sources.storage import new_path
from ..streaming import complete_groups as groups
from .registry import query
from .standin import table

#: Small frames and ranges, so that archives of small tables split as large ones do.
FRAME_BYTES, RANGE_BYTES = 65_536, 262_144
BANDS = ("B02", "B8A", "B11")


def page_members(spark, sf) -> DataFrame:
    """A page is a member: top/folder/patch/patch_B02.html. Null html is an empty member."""
    page = F.concat(F.lit("page"), F.col("page_id").cast("string"))
    path = F.concat(F.lit("top/folder"), (F.col("page_id") % 7).cast("string"), F.lit("/"), page, F.lit("/"), page, F.lit("_B02.html"))
    return table(spark, sf, "pages").select(path.alias("path"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))


def written(spark, members: DataFrame) -> str:
    root = new_path(spark, "archive")
    seekable.write_archives(members, root, FRAME_BYTES).collect()  # a row a task
    return root


def by_folder(members: DataFrame) -> DataFrame:
    return members.groupBy("folder", "extension").agg(
        F.count("*").alias("n"),
        F.max("depth").alias("max_depth"),
        F.count_distinct("patch_id").alias("n_patches"),
        F.sum("size").alias("n_bytes"),
        F.sum(seeded_int("own", F.hex("content"))).alias("checksum"),
        F.min("path").alias("first_path"),
    )


PAGES = """WITH p AS (SELECT page_id, 'folder' || page_id % 7 AS folder, encode(coalesce(html, '')) AS body FROM pages)
SELECT folder, '.html' AS extension, count(*) AS n, 4 AS max_depth, count(DISTINCT page_id) AS n_patches, sum(octet_length(body))::BIGINT AS n_bytes,
sum(('0x' || substr(md5('own:' || hex(body)), 1, 8))::BIGINT)::BIGINT AS checksum, min('top/' || folder || '/page' || page_id || '/page' || page_id || '_B02.html') AS first_path FROM p GROUP BY folder"""


@query(PAGES)
def archive_inventory(spark, sf):
    """Members of archives of all pages by folder and extension, with their bytes, read by ranges of frames."""
    return by_folder(archive.read(spark, written(spark, page_members(spark, sf)), range_bytes=RANGE_BYTES))


@query(PAGES)
def archive_stream(spark, sf):
    """The same by a stream over the arriving archives, in two runs: the second goes on at the offset of the first."""
    root = written(spark, page_members(spark, sf).where(F.instr("path", "folder3") == 0))
    out = new_path(spark, "members")

    def run() -> None:
        members = archive.read_stream(spark, root, range_bytes=RANGE_BYTES)
        members.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()

    run()
    late = written(spark, page_members(spark, sf).where(F.instr("path", "folder3") > 0))
    for k, path in enumerate(archive.archives(late)):
        where, base = archive.store(root)
        where.move(path, f"{base}/late-{k:05d}.tar.zst")
    run()
    return by_folder(spark.read.schema(archive.COLUMNS).parquet(f"{out}/rows"))


def band_members(spark, sf) -> DataFrame:
    """An embedding as three 8 x 8 bands of 16 bits, each a TIFF."""

    @F.arrow_udf("binary")
    def image(values: pa.Array) -> pa.Array:
        return pa.array([tiff.encode(np.array(v, np.uint16).reshape(8, 8)) for v in values.to_pylist()], pa.binary())

    cells = F.transform("embedding", lambda x: (F.round(x.cast("double") * 1000) + 2000).cast("int"))
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.array(*map(F.lit, BANDS))).alias("k", "band"), cells.alias("cells"))
    patch = F.concat(F.lit("patch"), F.col("vec_id").cast("string"))
    path = F.concat(F.lit("top/folder"), (F.col("vec_id") % 2).cast("string"), F.lit("/"), patch, F.lit("/"), patch, F.lit("_"), F.col("band"), F.lit(".tif"))
    return rows.select(path.alias("path"), image(F.transform("cells", lambda c: c + F.col("k"))).alias("content"))


@query(f"""WITH c AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT * FROM (VALUES ('B02', 0), ('B8A', 1)) t(band, k))
SELECT 'patch' || vec_id AS patch_id, band, min(round(x::DOUBLE * 1000) + 2000 + k)::DOUBLE AS low, max(round(x::DOUBLE * 1000) + 2000 + k)::DOUBLE AS high, count(*) AS cells FROM c, b GROUP BY ALL""")
def archive_bands(spark, sf):
    """Pixels of the wanted bands of one folder, decoded from archives of all embeddings; folder and bands are pushed to the reader."""
    members = archive.read(spark, written(spark, band_members(spark, sf)), range_bytes=RANGE_BYTES).where("folder = 'folder0' AND band IN ('B02', 'B8A')")
    cells = members.select("patch_id", "band", F.explode(tiff.decode_column(F.col("content"))["values"]).alias("v"))
    return cells.groupBy("patch_id", "band").agg(F.min(F.col("v").cast("double")).alias("low"), F.max(F.col("v").cast("double")).alias("high"), F.count("*").alias("cells"))


def write_files(members: DataFrame, root: str) -> None:
    """Each row (path, content) as a file of its own under the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = archive.store(root)
        n = 0
        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where.create_dir(f"{base}/{path.rpartition('/')[0]}", recursive=True)
                with where.open_output_stream(f"{base}/{path}", compression=None) as out:
                    out.write(body)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    members.select("path", "content").mapInArrow(run, "n bigint").collect()  # a row a task


@query("""WITH v AS (SELECT vec_id, embedding, b.band, b.k, CASE WHEN (vec_id + k) % 5 = 0 THEN 'missing' WHEN (vec_id + k) % 7 = 0 THEN 'damaged' WHEN (vec_id + k) % 3 = 0 THEN 'fallback' ELSE 'named' END AS status FROM embeddings, (VALUES ('B02', 0), ('B8A', 1), ('B11', 2)) b(band, k)),
c AS (SELECT band, status, vec_id, unnest(embedding) AS x, k FROM v)
SELECT band, status, count(DISTINCT vec_id) AS n, count(*) AS n_values, sum(CASE WHEN status IN ('missing', 'damaged') THEN 0 ELSE round(x::DOUBLE * 1000) + 2000 + k END)::BIGINT AS total FROM c GROUP BY 1, 2""")
def band_files(spark, sf):
    """Bands of all embeddings as single files, some under the second name, damaged or missing: by band and status the images, their cells (zeros where there is none) and sum."""
    where = F.substring_index("path", "/", -2)
    k = F.when(F.col("path").contains("_B02"), 0).when(F.col("path").contains("_B8A"), 1).otherwise(2)
    member = F.regexp_extract("path", r"patch(\d+)_", 1).cast("bigint") + k
    second = F.concat(F.substring_index(where, "/", 1), F.lit("/"), F.substring_index("path", "_", -1))
    own = band_members(spark, sf).where(member % 5 != 0).select(F.when((member % 7 != 0) & (member % 3 == 0), second).otherwise(where).alias("path"), F.when(member % 7 == 0, F.lit(b"II*")).otherwise(F.col("content")).alias("content"))
    root = new_path(spark, "bands")
    write_files(own, root)
    patches = table(spark, sf, "embeddings").select(F.concat(F.lit("patch"), F.col("vec_id").cast("string")).alias("patch_id"))
    values = F.aggregate("image.values", F.lit(0).cast("bigint"), lambda a, x: a + x)
    out = tiff.bands(spark, root, patches, BANDS, zero_fill=8)
    return out.groupBy("band", "status").agg(F.count("*").alias("n"), F.sum(F.size("image.values")).cast("bigint").alias("n_values"), F.sum(values).alias("total"))


@query("""WITH e AS (SELECT *, user_id || '-' || strftime(ts, '%Y%m%d') AS user_day FROM events), k AS (SELECT count(DISTINCT event_type) AS n, max(ts) AS now FROM events),
l AS (SELECT user_day, event_type, max({'ts': ts, 'id': event_id}) AS m, min(ts) AS t0 FROM e GROUP BY 1, 2),
u AS (SELECT user_day, count(*) AS n, min(t0) AS t0, string_agg(event_type || '=' || m.id, ',' ORDER BY event_type) AS members, list(event_type) AS have FROM l GROUP BY 1)
SELECT user_day, u.n = k.n AS complete, members, (SELECT coalesce(string_agg(t, ',' ORDER BY t), '') FROM (SELECT DISTINCT event_type AS t FROM events) x WHERE NOT list_contains(u.have, t)) AS missing
FROM u, k WHERE u.n = k.n OR u.t0 + INTERVAL 10 DAY <= k.now""")
def expiring_groups_stream(spark, sf):
    """The events of a user's day as a stream with an end of ten days: complete ones with their last event of each kind, and those that expired incomplete, with what is missing."""
    batch = table(spark, sf, "events")
    kinds = [r[0] for r in batch.select("event_type").distinct().orderBy("event_type").collect()]  # the kinds of a complete group
    root = new_path(spark, "groups")
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, groups.ROCKSDB)
    try:
        events = spark.readStream.schema(batch.schema).parquet(f"{sf}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
        events = events.withColumn("user_day", F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd"))).withWatermark("ts", "0 seconds")
        out = groups.groups_with_expiry(events, "user_day", "event_type", "event_id", "ts", kinds, 10 * 86_400_000)
        out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    found = spark.read.schema("user_day string, complete boolean, kinds array<string>, last array<bigint>, missing array<string>").parquet(f"{root}/out")
    pair = F.transform(F.arrays_zip("kinds", "last"), lambda x: F.concat_ws("=", x["kinds"], x["last"].cast("string")))
    return found.select("user_day", "complete", F.array_join(pair, ",").alias("members"), F.array_join("missing", ",").alias("missing"))
