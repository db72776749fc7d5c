"""A data source over tar archives, plain or zstandard, in any store of `storage.store`, as a batch and as a stream.

An archive that `seekable.write` has made ends with a seek table of its frames, each of which begins at a member: it is
read by ranges of frames, one partition a range, without a byte of the other frames. Any other archive is one partition,
as only reading it from its start tells where its members begin.

Filters on folder, patch and band are pushed into the source, which skips a member before its bytes are read.
Members that are no files or lie under depth 3 are skipped, as are bytes if the schema has no content. What cannot be
read (a damaged frame, a cut archive) becomes a row of its own with `error` and without a path; the members before it and all other ranges are there.

The stream's offset names the archives that have been read whole; what has arrived since is the next batch. A restart
goes on at the offset in the checkpoint. An archive must appear under its name in one step (a rename).
"""

from __future__ import annotations

import os
import tarfile
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

from . import seekable
from .storage import store

FORMAT = "patchwright_tar"
COLUMNS = "archive string, position bigint, path string, depth int, folder string, patch_id string, band string, extension string, size bigint, content binary, error string"
KEYS = ("folder", "patch_id", "band", "extension")
#: Compressed bytes of a range of frames.
RANGE_BYTES = 64_000_000


class Range(InputPartition):
    """Frames of an archive: bytes from start to end, end None: to the end of a file without a seek table."""

    def __init__(self, path: str, start: int = 0, end: int | None = None) -> None:
        self.path, self.start, self.end = path, start, end


def archives(root: str) -> list[str]:
    from pyarrow import fs

    where, base = store(root)
    here = where.get_file_info(base)
    found = where.get_file_info(fs.FileSelector(base)) if here.type == fs.FileType.Directory else [here]
    return sorted(f.path for f in found if f.is_file and f.path.endswith((".tar", ".tar.zst")))


def ranges(root: str, paths: list[str], most: int) -> list[Range]:
    """Runs of frames of at most so many bytes (or one frame); the seek table is all that is read here."""
    where, _ = store(root)
    out = []
    for p in paths:
        frames = seekable.frames(where, p) if p.endswith(".zst") else None
        if frames is None:
            out.append(Range(p))
            continue
        start = end = 0
        for size in frames:
            if end > start and end + size - start > most:
                out.append(Range(p, start, end))
                start = end
            end += size
        if end > start:
            out.append(Range(p, start, end))
    return out


class Members:
    """What batch and stream share: the filters, and the rows of a range."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.options, self.wanted = schema.names, options, {}
        self.most = int(options.get("rangebytes", RANGE_BYTES))

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in KEYS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        name, position = os.path.basename(partition.path), partition.start << 20
        try:
            for row in self.members(partition, name):
                position = row["position"]
                if all(row[n] in v for n, v in self.wanted.items()):
                    yield tuple(row.get(n) for n in self.names)
        except (zstandard.ZstdError, tarfile.TarError, EOFError, OSError) as e:
            if "error" in self.names and not self.wanted:
                lost = {"archive": name, "position": position, "error": f"{type(e).__name__}: {e}"}
                yield tuple(lost.get(n) for n in self.names)
            elif "error" not in self.names:
                raise

    def members(self, part: Range, name: str) -> Iterator[dict]:
        least = int(self.options.get("mindepth", 3))
        where, _ = store(self.options["path"])
        with where.open_input_file(part.path) as raw:
            raw.seek(part.start)
            source = raw if part.end is None else seekable.Piece(raw, part.end - part.start)
            stream = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True) if part.path.endswith(".zst") else source
            stream = Watched(stream)
            with tarfile.open(fileobj=stream, mode="r|") as tar:
                for k, m in enumerate(tar):
                    parts = m.name.split("/")
                    if not m.isfile() or len(parts) < least:
                        continue
                    stem, extension = os.path.splitext(parts[-1])
                    # positions rise along an archive, whatever its ranges: the range's first byte, then the member's number in it
                    row = {"archive": name, "position": (part.start << 20) + k, "path": m.name, "depth": len(parts), "folder": parts[-3] if len(parts) > 2 else None, "patch_id": parts[-2] if len(parts) > 1 else None, "band": stem.rpartition("_")[2], "extension": extension.lower(), "size": m.size}
                    if "content" in self.names and all(row[n] in v for n, v in self.wanted.items()):
                        row["content"] = tar.extractfile(m).read()
                        if len(row["content"]) < m.size:
                            raise EOFError(f"{m.name} is cut")
                    yield row
            if part.end is None and stream.last.strip(b"\0"):
                raise EOFError("the archive has no end: it is cut")


class Watched:
    """A stream that remembers its last block."""

    def __init__(self, stream) -> None:
        self.stream, self.last = stream, b""

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.last = (self.last + data)[-tarfile.BLOCKSIZE :]
        return data


class TarReader(Members, DataSourceReader):
    def partitions(self) -> list[Range]:
        root = self.options["path"]
        return ranges(root, archives(root), self.most) or [Range("")]


class TarStreamReader(Members, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802  (names of the interface)
        return {"archives": []}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"archives": [os.path.basename(p) for p in archives(self.options["path"])]}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        root, seen, now = self.options["path"], set(start["archives"]), set(end["archives"])
        return ranges(root, [p for p in archives(root) if os.path.basename(p) in now - seen], self.most)

    def commit(self, end: dict) -> None:
        pass


class TarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> TarReader:
        return TarReader(schema, {k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema: StructType) -> TarStreamReader:  # noqa: N802
        return TarStreamReader(schema, {k.lower(): v for k, v in self.options.items()})


def _fields(columns: list[str] | None) -> str:
    full = [c.strip().split() for c in COLUMNS.split(",")]
    return ", ".join(f"{n} {t}" for n, t in full if columns is None or n in columns)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, min_depth: int = 3, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The members of an archive, or of all archives in a folder."""
    spark.dataSource.register(TarSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).schema(_fields(columns)).option("minDepth", min_depth).option("rangeBytes", range_bytes).load(path)


def read_stream(spark: SparkSession, path: str, columns: list[str] | None = None, min_depth: int = 3, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The members of the archives of a folder, as they arrive."""
    spark.dataSource.register(TarSource)
    return spark.readStream.format(FORMAT).schema(_fields(columns)).option("minDepth", min_depth).option("rangeBytes", range_bytes).load(path)
