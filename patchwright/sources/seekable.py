"""Tar archives in zstandard frames that begin at members, with the public seek table of frame sizes at the end.

Any zstandard and tar program reads them as one archive. A frame without content, which decoders pass over, says that
frames begin at members; a table without it is not used, as other writers cut frames anywhere.
"""

from __future__ import annotations

import io
import struct
import tarfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import store

# Fixed values of the public seekable format: magic of skippable frames, of the table's frame and of its footer.
SKIPPED, TABLE, FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
ALIGNED = b"frames begin at tar members"
FRAME_BYTES = 8_000_000


class Piece(io.RawIOBase):
    """The next n bytes of an open file, as a file of their own."""

    def __init__(self, raw, n: int) -> None:
        self.raw, self.left = raw, n

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        got = self.raw.read(self.left if n < 0 else min(n, self.left))
        self.left -= len(got)
        return got


def frames(where, path: str) -> list[int] | None:
    """The compressed sizes of the frames; none if the archive has no table, or frames that begin elsewhere than at members."""
    with where.open_input_file(path) as f:
        size = f.size()
        if size < 17:
            return None
        f.seek(size - 9)
        n, descriptor, magic = struct.unpack("<IBI", f.read(9))
        entry = 12 if descriptor & 0x80 else 8
        whole = 8 + n * entry + 9
        if magic != FOOTER or whole > size:
            return None
        f.seek(size - whole)
        table = f.read(whole)
        if struct.unpack("<II", table[:8]) != (TABLE, whole - 8):
            return None
        sizes = [struct.unpack_from("<II", table, 8 + k * entry) for k in range(n)]
        if not n or sizes[-1][1] or sizes[-1][0] != 8 + len(ALIGNED):
            return None
        f.seek(size - whole - sizes[-1][0])
        if f.read(sizes[-1][0])[8:] != ALIGNED:
            return None
        return [compressed for compressed, _ in sizes[:-1]]


def write(out, members: Iterable[tuple[str, bytes]], frame_bytes: int = FRAME_BYTES, level: int = 3) -> int:
    """Writes members (path, bytes) to an open file, about frame_bytes of them a frame; returns how many frames."""
    press, sizes = zstandard.ZstdCompressor(level=level), []

    def frame(data: bytes) -> None:
        packed = press.compress(data)
        out.write(packed)
        sizes.append((len(packed), len(data)))

    held = bytearray()
    for path, body in members:
        info = tarfile.TarInfo(path)
        info.size = len(body)
        held += info.tobuf(tarfile.PAX_FORMAT) + body + b"\0" * (-len(body) % tarfile.BLOCKSIZE)
        if len(held) >= frame_bytes:
            frame(bytes(held))
            held.clear()
    frame(bytes(held) + b"\0" * (2 * tarfile.BLOCKSIZE))
    out.write(struct.pack("<II", SKIPPED, len(ALIGNED)) + ALIGNED)
    sizes.append((8 + len(ALIGNED), 0))
    entries = b"".join(struct.pack("<II", *s) for s in sizes)
    out.write(struct.pack("<II", TABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(sizes), 0, FOOTER))
    return len(sizes) - 1


def write_archives(members: DataFrame, root: str, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """One archive a task from rows (path, content) in their order: (archive, n_members, n_frames). An archive gets its name when it is whole; a repeated task replaces it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0

        def rows() -> Iterator[tuple[str, bytes]]:
            nonlocal n
            for batch in batches:
                for path, body in zip(batch.column(0), batch.column(1), strict=True):
                    n += 1
                    yield path.as_py(), body.as_py() or b""

        where, base = store(root)
        where.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}.tar.zst"
        draft = f"{base}/.{name}-{task.taskAttemptId()}"
        with where.open_output_stream(draft, compression=None) as out:
            n_frames = write(out, rows(), frame_bytes)
        where.move(draft, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"archive": [name], "n_members": [n], "n_frames": [n_frames]})

    return members.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "archive string, n_members bigint, n_frames bigint")
