"""Archives by ranges of frames against the sequential read; the stream; damaged archives."""

import io
import tarfile

import zstandard
from pyarrow import fs

from patchwright.sources import archive, seekable

LOCAL = fs.LocalFileSystem()


def members(n, size=700):
    return [(f"top/folder{k % 5}/patch{k // 3}/patch{k // 3}_B{k % 3:02d}.tif", bytes([k % 251]) * (size + 13 * k % 900)) for k in range(n)]


def build(path, n, frame_bytes=2000):
    with open(path, "wb") as out:
        return seekable.write(out, members(n), frame_bytes)


def sequential(path):
    """Another reader of the whole file."""
    with open(path, "rb") as f, tarfile.open(fileobj=zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True), mode="r|") as tar:
        return [(m.name, tar.extractfile(m).read()) for m in tar]


def got(df):
    return [(r.path, bytes(r.content)) for r in df.orderBy("archive", "position").collect()]


def test_ranges_equal_the_sequential_read(spark, tmp_path):
    path = f"{tmp_path}/a.tar.zst"
    assert build(path, 128) >= 64
    assert sequential(path) == members(128)
    frames = seekable.frames(LOCAL, path)
    df = archive.read(spark, path, range_bytes=4 * max(frames))
    assert 12 <= df.rdd.getNumPartitions() <= 24
    assert got(df) == members(128)
    assert df.where("error IS NOT NULL").count() == 0
    some = archive.read(spark, path, range_bytes=1).where("folder = 'folder2' AND band IN ('B00', 'B02')")
    assert got(some) == [m for m in members(128) if "/folder2/" in m[0] and m[0].endswith(("B00.tif", "B02.tif"))]


def test_other_archives_are_one_range(spark, tmp_path):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for name, body in members(20):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    data = raw.getvalue()
    press = zstandard.ZstdCompressor()
    with open(f"{tmp_path}/cut.tar.zst", "wb") as f:  # frames that begin anywhere
        f.write(b"".join(press.compress(data[k : k + 5000]) for k in range(0, len(data), 5000)))
    with open(f"{tmp_path}/plain.tar", "wb") as f:
        f.write(data)
    assert seekable.frames(LOCAL, f"{tmp_path}/cut.tar.zst") is None
    df = archive.read(spark, str(tmp_path), range_bytes=1)
    assert df.rdd.getNumPartitions() == 2
    assert got(df) == members(20) * 2


def test_a_damaged_frame_becomes_a_row(spark, tmp_path):
    path = f"{tmp_path}/a.tar.zst"
    build(path, 60)
    frames = seekable.frames(LOCAL, path)
    data = bytearray(open(path, "rb").read())
    at = sum(frames[:10])
    data[at : at + frames[10]] = b"\xff" * frames[10]
    open(path, "wb").write(data)
    rows = archive.read(spark, path, range_bytes=1).collect()
    lost = [r for r in rows if r.error is not None]
    assert len(lost) == 1 and lost[0].path is None and lost[0].archive == "a.tar.zst"
    whole = {r.path for r in rows if r.error is None}
    assert len(whole) >= 60 - 4 and whole < {m[0] for m in members(60)}
    open(f"{tmp_path}/b.tar.zst", "wb").write(bytes(data[: at // 2]))  # cut: no table
    rows = archive.read(spark, f"{tmp_path}/b.tar.zst").collect()
    assert sum(r.error is not None for r in rows) == 1 and any(r.path for r in rows)


def test_stream_goes_on_at_its_offset(spark, tmp_path):
    source, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    LOCAL.create_dir(source)

    def run():
        rows = archive.read_stream(spark, source, ["archive", "position", "path", "size"], range_bytes=3000)
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.archive, r.path) for r in spark.read.parquet(out).collect())

    build(f"{source}/b.tar.zst", 30)
    assert run() == [("b.tar.zst", m[0]) for m in sorted(members(30))]
    build(f"{source}/a.tar.zst", 10)  # a later arrival of an earlier name
    assert run() == sorted([("b.tar.zst", m[0]) for m in members(30)] + [("a.tar.zst", m[0]) for m in members(10)])
    assert len(run()) == 40


def test_bands_by_either_name_and_what_is_lost(spark, tmp_path):
    import numpy as np

    from patchwright.sources import tiff

    def put(name, data):
        LOCAL.create_dir(f"{tmp_path}/bands/{name.rpartition('/')[0]}")
        open(f"{tmp_path}/bands/{name}", "wb").write(data)

    one, two = (tiff.encode(np.full((2, 3), k, np.uint16)) for k in (1, 2))
    put("p/p_B02.tif", one)
    put("p/B02.tif", two)
    put("p/B03.tif", two)
    put("q/q_B02.tif", b"II*")
    put("other/B02.tif", one)
    patches = spark.createDataFrame([("p",), ("p",), ("q",), (None,)], "patch_id string")
    for fill in (None, 2):
        got = {(r.patch_id, r.band): (r.status, r.image and list(r.image["values"])) for r in tiff.bands(spark, f"{tmp_path}/bands", patches, ["B02", "B03"], fill).collect()}
        none = [0] * 4 if fill else None
        assert got == {("p", "B02"): ("named", [1] * 6), ("p", "B03"): ("fallback", [2] * 6), ("q", "B02"): ("damaged", none), ("q", "B03"): ("missing", none), (None, "B02"): ("missing", none), (None, "B03"): ("missing", none)}
