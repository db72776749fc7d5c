"""The folder that driver and executors share, for what is written and read again."""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`. Unset, one is made here if the master is local, where all run on this machine; a cluster without one is refused."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="patchwright-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_made: set[str] = set()


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder; what is left there when the driver's Python ends is deleted, with the application's own Hadoop settings."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep, spark.sparkContext._gateway.jvm, spark.sparkContext._jsc.hadoopConfiguration())
    _made.add(path)
    return path


def delete(jvm, conf, path: str) -> None:
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)
    _made.discard(path)


def _sweep(jvm, conf) -> None:
    for path in [*_made]:
        try:
            delete(jvm, conf, path)
        except Exception as e:  # the JVM may be gone; the rest would fail as well
            print(f"patchwright: left {len(_made)} folders beside {path}: {type(e).__name__}", file=sys.stderr)
            return


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage by a written table in the shared folder: survives lost executors, gives Catalyst its size."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a materialised table."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = next((p for p in _made if p.rpartition("/")[2] == name.rpartition("/")[2]), name)
        delete(spark._jvm, spark._jsc.hadoopConfiguration(), path)


def store(path: str):
    """(pyarrow filesystem, path in it) of a folder or file: local, or anything that pyarrow.fs opens by URI (hdfs, s3, gs)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
