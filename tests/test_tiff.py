"""Rasters are read back as they were written, by this library and by a plain writer of other layouts."""

import struct
import zlib

import numpy as np
import pytest

from cinderlake.sources import tiff


def tiled(x, tile=16, order=">", planar=True, deflate=False, big=False):
    """A file in tiles, with bands apart, in either byte order."""
    h, w, bands = x.shape
    down, across = -(-h // tile), -(-w // tile)
    full = np.zeros((down * tile, across * tile, bands), x.dtype)
    full[:h, :w] = x
    layers = [full[..., b : b + 1] for b in range(bands)] if planar else [full]
    blocks = [lay[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile].astype(x.dtype.newbyteorder(order)).tobytes() for lay in layers for i in range(down) for j in range(across)]
    blocks = [zlib.compress(b) for b in blocks] if deflate else blocks
    size, code = (8, 16) if big else (4, 4)
    head = 16 if big else 8
    offsets = [head + sum(map(len, blocks[:k])) for k in range(len(blocks))]
    body = b"".join(blocks)
    tail = head + len(body)
    extra = b""
    entries = [(256, 3, [w]), (257, 3, [h]), (258, 3, [x.dtype.itemsize * 8] * bands), (259, 3, [32946 if deflate else 1]), (277, 3, [bands]), (284, 3, [2 if planar else 1]), (322, 3, [tile]), (323, 3, [tile]), (324, code, offsets), (325, code, [len(b) for b in blocks]), (339, 3, [{"u": 1, "i": 2, "f": 3}[x.dtype.kind]] * bands)]
    table = b""
    for tag, c, v in entries:
        data = struct.pack(order + {3: "H", 4: "I", 16: "Q"}[c] * len(v), *v)
        n = struct.pack(order + ("Q" if big else "I"), len(v))
        if len(data) <= size:
            table += struct.pack(order + "HH", tag, c) + n + data.ljust(size, b"\0")
        else:
            table += struct.pack(order + "HH", tag, c) + n + struct.pack(order + ("Q" if big else "I"), tail + len(extra))
            extra += data
    first = tail + len(extra)
    mark = b"II" if order == "<" else b"MM"
    start = mark + (struct.pack(order + "HHHQ", 43, 8, 0, first) if big else struct.pack(order + "HI", 42, first))
    return start + body + extra + struct.pack(order + ("Q" if big else "H"), len(entries)) + table + struct.pack(order + ("Q" if big else "I"), 0)


def grid(rows, h, w, bands):
    out = np.full((h, w, bands), np.nan)
    for r in rows:
        out[r.row, r.col] = [np.nan if r[f"b{k + 1}"] is None else r[f"b{k + 1}"] for k in range(bands)]
    return out


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(tiff.TiffSource)
    return lambda path, **o: spark.read.format("tiff").options(**o).load(str(path))


@pytest.mark.parametrize("kind, deflate, rows", [("<u2", True, 7), ("<i2", True, 64), ("<f4", True, 5), ("<u1", False, 16), ("<f8", False, 1), ("<i4", True, 3)])
def test_strips_come_back(source, tmp_path, kind, deflate, rows):
    rng = np.random.default_rng(1)
    x = rng.integers(-100 if np.dtype(kind).kind != "u" else 0, 200, (37, 23, 3)).astype(kind)
    (tmp_path / "a.tif").write_bytes(tiff.encoded(x, rows, deflate, (500_000.0, 6_800_000.0, 20.0)))
    h = tiff.header_of(str(tmp_path / "a.tif"))
    assert (h.width, h.height, h.samples, h.place) == (23, 37, 3, (500_000.0, 6_800_000.0, 20.0, -20.0))
    assert (grid(source(tmp_path / "a.tif").collect(), 37, 23, 3) == x).all()


@pytest.mark.parametrize("order, planar, deflate, big, kind", [(">", True, False, False, "u2"), ("<", False, True, False, "f4"), ("<", True, True, True, "i2"), (">", False, False, True, "f8")])
def test_tiles_of_other_writers(source, tmp_path, order, planar, deflate, big, kind):
    x = np.arange(37 * 45 * 2).reshape(37, 45, 2).astype(kind)
    (tmp_path / "t.tiff").write_bytes(tiled(x, 16, order, planar, deflate, big))
    assert (grid(source(f"file://{tmp_path}/t.tiff").collect(), 37, 45, 2) == x).all()
    part = source(tmp_path / "t.tiff", window="14,30,4,40").collect()
    assert {(r.row, r.col) for r in part} == {(i, j) for i in range(14, 18) for j in range(30, 45)}
    assert all(r.b1 == x[r.row, r.col, 0] and r.b2 == x[r.row, r.col, 1] for r in part)


def test_windows_read_their_strips_only(source, tmp_path, monkeypatch):
    x = np.arange(100 * 10, dtype="<u2").reshape(100, 10, 1)
    data = bytearray(tiff.encoded(x, 10, True))
    (tmp_path / "w.tif").write_bytes(data)
    h = tiff.header_of(str(tmp_path / "w.tif"))
    assert h.touched((25, 0, 10, 10)) == [2, 3] and h.touched((0, 0, 100, 10)) == list(range(10)) and h.touched((200, 0, 5, 5)) == [] and h.touched((-5, -5, 6, 6)) == [0]
    # every other strip is spoilt: the window doesn't see it
    for k in range(10):
        if k not in (2, 3):
            data[h.offsets[k] : h.offsets[k] + h.sizes[k]] = bytes(h.sizes[k])
    (tmp_path / "w.tif").write_bytes(data)
    got = source(tmp_path / "w.tif", window="25,0,10,10").collect()
    assert {(r.row, r.col): r.b1 for r in got} == {(i, j): float(x[i, j, 0]) for i in range(25, 35) for j in range(10)}
    assert source(tmp_path / "w.tif", window="500,0,10,10").count() == 0
    monkeypatch.setattr(tiff, "PARTITION_BYTES", 1)
    assert len(tiff.TiffReader({"path": str(tmp_path / "w.tif"), "window": "25,0,10,10"}, 1).partitions()) == 2


def test_chips_as_files(spark, source, tmp_path):
    rows = [(c, r, k, float(c * 1000 + r * 10 + k), float(r)) for c in range(3) for r in range(20) for k in range(9)]
    px = spark.createDataFrame(rows, "chip_id long, row int, col int, a double, b double")
    written = tiff.write(px, ["a", "b"], f"file://{tmp_path}/chips").collect()
    assert sorted(r.chip_id for r in written) == [0, 1, 2]
    back = source(tmp_path / "chips").withColumn("chip", tiff.chip_of("path")).collect()
    assert sorted((int(r.chip), r.row, r.col, r.b1, r.b2) for r in back) == sorted(rows)


def test_missing_samples_and_what_is_not_known(source, tmp_path):
    x = np.array([[[1.0], [-9999.0], [np.nan]]], "<f4")
    (tmp_path / "n.tif").write_bytes(tiff.encoded(x, nodata=-9999.0))
    assert [r.b1 for r in source(tmp_path / "n.tif").orderBy("col").collect()] == [1.0, None, None]
    (tmp_path / "bad.tif").write_bytes(b"nothing")
    with pytest.raises(Exception, match="header|no TIFF"):
        tiff.header_of(str(tmp_path / "bad.tif"))
    lzw = bytearray(tiff.encoded(np.zeros((2, 2, 1), "<u1"), deflate=False))
    at = lzw.index(struct.pack("<HHIHH", 259, 3, 1, 1, 0))
    lzw[at + 8] = 5
    (tmp_path / "lzw.tif").write_bytes(lzw)
    with pytest.raises(ValueError, match="compression 5"):
        tiff.header_of(str(tmp_path / "lzw.tif"))
    with pytest.raises(FileNotFoundError):
        tiff.files_of(str(tmp_path / "none"))
