"""A stream's progress as rows, and streams of files at a bounded rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import StructType

SCHEMA = "query string, batch bigint, rows bigint, rows_per_second double"


class ProgressLog(StreamingQueryListener):
    """Keeps (query, batch, rows, rows_per_second) of the last `size` batches, and prints every `every` of them if asked to."""

    def __init__(self, size: int = 1000, every: int | None = None) -> None:
        self.size, self.every, self.rows, self.failed = size, every, [], []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows = [*self.rows, (str(p.id), p.batchId, p.numInputRows, float(p.processedRowsPerSecond or 0))][-self.size :]
        if self.every and len(self.rows) % self.every == 0:
            print(f"batch {p.batchId}: {p.numInputRows} rows")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed.append(event.exception)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SCHEMA)


def parquet_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder as a stream; files_per_batch bounds what a batch takes, however much waits."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)
