"""Rasters in TIFF files, as a data source whose partitions are runs of a file's strips or tiles.

Only the strips or tiles that a window touches are read, each by its place in the file, so a small window of a large raster
costs little. Pixels come as rows (path, row, col, b1, b2, ...) in doubles; the sample that a file calls "no data" is null.
Read are plain and deflated samples of 8 to 64 bits, whole or floating, interleaved or by band, with or without
differences of neighbours (predictor 2), of either byte order; other files are an error that names what isn't known.
Paths are of any store that pyarrow opens: local ones, mounted ones, or URIs.

    spark.dataSource.register(TiffSource)
    spark.read.format("tiff").option("window", "row,col,height,width").load(path)

`write` makes such files, one for each chip."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of strips or tiles, about, that one partition reads.
PARTITION_BYTES = 16 << 20

# fixed values: tags, types and codes of the file format
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIEPOINT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
STORED, DEFLATE, OLD_DEFLATE = 1, 8, 32946
KINDS = {1: "u", 2: "i", 3: "f"}


@dataclass
class Header:
    """What a file says of its raster: size, samples, and the place of each strip or tile."""

    width: int
    height: int
    samples: int
    kind: str
    compression: int
    predictor: int
    planar: bool
    block: tuple[int, int]
    tiled: bool
    offsets: list[int]
    sizes: list[int]
    nodata: float | None = None
    #: x, y of the upper left corner, and the pixel's width and height; None where the file doesn't tell.
    place: tuple[float, float, float, float] | None = None
    across: int = field(init=False)
    down: int = field(init=False)

    def __post_init__(self) -> None:
        self.down, self.across = -(-self.height // self.block[0]), -(-self.width // self.block[1])

    def touched(self, window: tuple[int, int, int, int]) -> list[int]:
        """Numbers of the blocks, of the first band if bands lie apart, that the window (row, col, height, width) touches."""
        r, c, h, w = window
        if h <= 0 or w <= 0:
            return []
        rows = range(max(r, 0) // self.block[0], min((r + h - 1) // self.block[0], self.down - 1) + 1)
        cols = range(max(c, 0) // self.block[1], min((c + w - 1) // self.block[1], self.across - 1) + 1)
        return [i * self.across + j for i in rows for j in cols]


def _opened(path: str):
    store, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, place


def files_of(path: str) -> list[str]:
    """The path itself, or the .tif and .tiff files below it in order."""
    store, place = _opened(path)
    head = path[: len(path) - len(place)] if path.endswith(place) else ""
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(place, recursive=True))
    return sorted(head + x.path for x in found if x.is_file and x.path.lower().endswith((".tif", ".tiff")))


def header_of(path: str) -> Header:
    store, place = _opened(path)
    with store.open_input_file(place) as f:

        def read(at: int, n: int) -> bytes:
            got = f.read_at(n, at)
            if len(got) < n:
                raise ValueError(f"{path}: the file ends within its header")
            return got

        start = read(0, 8)
        if start[:2] not in (b"II", b"MM"):
            raise ValueError(f"{path}: no TIFF file")
        order = "<" if start[:2] == b"II" else ">"
        version, first = struct.unpack(order + "HI", start[2:8])
        big = version == 43
        if big:
            (first,) = struct.unpack(order + "Q", read(8, 8))
        elif version != 42:
            raise ValueError(f"{path}: version {version} of the format isn't known")
        size, entry, kind = (8, 20, "Q") if big else (2, 12, "I")
        (count,) = struct.unpack(order + ("Q" if big else "H"), read(first, size))
        raw, tags = read(first + size, entry * count), {}
        for k in range(count):
            e = raw[k * entry : (k + 1) * entry]
            tag, code = struct.unpack(order + "HH", e[:4])
            (n,) = struct.unpack(order + kind, e[4 : 12 if big else 8])
            if code not in TYPES:
                continue
            form = TYPES[code]
            want = struct.calcsize(order + form) * n
            inline = e[12 if big else 8 :]
            data = inline[:want] if want <= len(inline) else read(struct.unpack(order + kind, inline)[0], want)
            tags[tag] = data if code == 2 else struct.unpack(order + form * n, data)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    samples, bits, form = one(SAMPLES, 1), set(tags.get(BITS, (1,))), set(tags.get(FORMAT, (1,)))
    if len(bits) != 1 or len(form) != 1 or next(iter(bits)) not in (8, 16, 32, 64) or next(iter(form)) not in KINDS:
        raise ValueError(f"{path}: samples of {sorted(bits)} bits and format {sorted(form)} aren't known")
    kind = order + KINDS[form.pop()] + str(bits.pop() // 8)
    compression, predictor = one(COMPRESSION, STORED), one(PREDICTOR, 1)
    if compression not in (STORED, DEFLATE, OLD_DEFLATE):
        raise ValueError(f"{path}: compression {compression} isn't known")
    if predictor not in (1, 2) or predictor == 2 and kind[1] == "f":
        raise ValueError(f"{path}: predictor {predictor} isn't known")
    tiled = TILES in tags
    width, height = one(WIDTH, 0), one(HEIGHT, 0)
    block = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(STRIP_ROWS, height), height) or 1, width)
    text = tags.get(NODATA, b"").split(b"\0")[0].strip()
    place = (*tags[TIEPOINT][3:5], tags[SCALE][0], -tags[SCALE][1]) if SCALE in tags and TIEPOINT in tags else None
    return Header(width, height, samples, kind, compression, predictor, one(PLANAR, 1) == 2 and samples > 1, block, tiled, list(tags[TILES if tiled else STRIPS]), list(tags[TILE_BYTES if tiled else STRIP_BYTES]), float(text) if text else None, place)


def _samples(h: Header, data: bytes, rows: int, path: str) -> np.ndarray:
    """A block's samples: rows x columns x bands of the block."""
    if h.compression != STORED:
        data = zlib.decompress(data)
    bands = 1 if h.planar else h.samples
    shape = (rows, h.block[1], bands)
    want = int(np.prod(shape)) * np.dtype(h.kind).itemsize
    if len(data) < want:
        raise ValueError(f"{path}: a block holds {len(data)} of {want} bytes")
    x = np.frombuffer(data[:want], h.kind).reshape(shape)
    if h.predictor == 2:
        x = np.add.accumulate(x.astype(x.dtype.newbyteorder("=")), axis=1, dtype=x.dtype.newbyteorder("="))
    return x


@dataclass
class Blocks(InputPartition):
    path: str
    header: Header
    numbers: list[int]
    window: tuple[int, int, int, int]


def pixels_of(part: Blocks) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and samples (pixels x bands) of each block's part of the window."""
    h = part.header
    r0, c0, high, wide = part.window
    store, place = _opened(part.path)
    with store.open_input_file(place) as f:
        for k in part.numbers:
            i, j = divmod(k, h.across)
            top, left = i * h.block[0], j * h.block[1]
            # the last strip ends with the raster; tiles are always whole
            rows = h.block[0] if h.tiled else min(h.block[0], h.height - top)
            layers = range(h.samples if h.planar else 1)
            own = [k + b * h.across * h.down for b in layers]
            x = np.concatenate([_samples(h, f.read_at(h.sizes[n], h.offsets[n]), rows, part.path) for n in own], axis=2)
            a, z = max(top, r0), min(top + rows, r0 + high, h.height)
            b, y = max(left, c0), min(left + h.block[1], c0 + wide, h.width)
            if a < z and b < y:
                cut = x[a - top : z - top, b - left : y - left]
                row, col = np.mgrid[a:z, b:y]
                yield row.ravel(), col.ravel(), cut.reshape(-1, h.samples).astype(np.float64)


class TiffReader(DataSourceReader):
    def __init__(self, options: dict, bands: int):
        self.options, self.bands = options, bands

    def partitions(self) -> Sequence[InputPartition]:
        found = []
        for path in files_of(self.options["path"]):
            h = header_of(path)
            if h.samples != self.bands:
                raise ValueError(f"{path}: {h.samples} bands where the first file has {self.bands}")
            window = tuple(int(v) for v in self.options["window"].split(",")) if "window" in self.options else (0, 0, h.height, h.width)
            run, size = [], 0
            for k in h.touched(window):
                run.append(k)
                size += h.sizes[k] * (h.samples if h.planar else 1)
                if size >= PARTITION_BYTES:
                    found.append(Blocks(path, h, run, window))
                    run, size = [], 0
            if run:
                found.append(Blocks(path, h, run, window))
        return found or [Blocks("", Header(0, 0, self.bands, "<u1", 1, 1, False, (1, 1), False, [], []), [], (0, 0, 0, 0))]

    def read(self, part: Blocks) -> Iterator[pa.RecordBatch]:
        names = ["path", "row", "col", *[f"b{k + 1}" for k in range(self.bands)]]
        if not part.numbers:
            return
        for row, col, x in pixels_of(part):
            gone = np.isnan(x) if part.header.nodata is None else np.isnan(x) | (x == part.header.nodata)
            bands = [pa.array(x[:, k], mask=gone[:, k]) for k in range(self.bands)]
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(row)), pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), *bands], names=names)


class TiffSource(DataSource):
    """Options: path, of a file or a folder of files with the same number of bands; window, as row,col,height,width."""

    @classmethod
    def name(cls) -> str:
        return "tiff"

    def _bands(self) -> int:
        files = files_of(self.options["path"])
        if not files:
            raise FileNotFoundError(f"{self.options['path']} holds no TIFF file")
        return header_of(files[0]).samples

    def schema(self) -> str:
        return "path string, row int, col int, " + ", ".join(f"b{k + 1} double" for k in range(self._bands()))

    def reader(self, schema) -> TiffReader:
        return TiffReader(dict(self.options), len(schema.fieldNames()) - 3)


def encoded(x: np.ndarray, strip_rows: int = 16, deflate: bool = True, place: tuple[float, float, float] | None = None, nodata: float | None = None) -> bytes:
    """A file of rows x columns x bands in strips; place: x and y of the upper left corner and the pixel's size."""
    h, w, bands = x.shape
    x = np.ascontiguousarray(x).astype(x.dtype.newbyteorder("<"))
    whole = x.dtype.kind in "ui"
    blocks = []
    for r in range(0, h, strip_rows):
        part = x[r : r + strip_rows]
        if deflate and whole:
            part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
        blocks.append(zlib.compress(part.tobytes()) if deflate else part.tobytes())
    entries: list[tuple[int, int, Sequence]] = [
        (WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [x.dtype.itemsize * 8] * bands), (COMPRESSION, 3, [DEFLATE if deflate else STORED]), (PHOTOMETRIC, 3, [1]), (STRIPS, 4, [0] * len(blocks)), (SAMPLES, 3, [bands]),
        (STRIP_ROWS, 4, [strip_rows]), (STRIP_BYTES, 4, [len(b) for b in blocks]), (PREDICTOR, 3, [2 if deflate and whole else 1]), (FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[x.dtype.kind]] * bands),
    ]
    if place:
        entries += [(SCALE, 12, [place[2], place[2], 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, place[0], place[1], 0.0])]
    if nodata is not None:
        entries.append((NODATA, 2, f"{nodata!r}\0".encode()))
    entries.sort(key=lambda e: e[0])

    def packed(code: int, values: Sequence) -> bytes:
        return bytes(values) if code == 2 else struct.pack("<" + TYPES[code] * len(values), *values)

    table = 8 + 2 + 12 * len(entries) + 4
    spare = sum(len(packed(c, v)) for _, c, v in entries if len(packed(c, v)) > 4)
    at = table + spare
    offsets = [at + sum(len(b) for b in blocks[:k]) for k in range(len(blocks))]
    out, extra = struct.pack("<2sHIH", b"II", 42, 8, len(entries)), b""
    for tag, code, values in entries:
        data = packed(code, offsets if tag == STRIPS else values)
        if len(data) > 4:
            out += struct.pack("<HHII", tag, code, len(values), table + len(extra))
            extra += data
        else:
            out += struct.pack("<HHI", tag, code, len(values)) + data.ljust(4, b"\0")
    return out + struct.pack("<I", 0) + extra + b"".join(blocks)


def write(pixels: DataFrame, bands: Sequence[str], folder: str, by: str = "chip_id", kind: str = "<f4", strip_rows: int = 16, deflate: bool = True) -> DataFrame:
    """Write a file for each chip (row, col from 0, and bands) below the folder, named by the chip. Gives rows (by, path, bytes)
    as it is read, once. A chip is of bounded size; pixels that it lacks are not a number, or 0 in samples of whole numbers."""

    def run(chip: pd.DataFrame) -> pd.DataFrame:
        x = np.full((int(chip.row.max()) + 1, int(chip.col.max()) + 1, len(bands)), np.nan if np.dtype(kind).kind == "f" else 0, kind)
        x[chip.row, chip.col] = chip[list(bands)].to_numpy()
        data = encoded(x, strip_rows, deflate)
        key = chip[by].iloc[0]
        path = f"{folder}/{key}.tif"
        store, place = _opened(path)
        store.create_dir(place.rpartition("/")[0], recursive=True)
        with store.open_output_stream(place) as f:
            f.write(data)
        return pd.DataFrame({by: [key], "path": [path], "bytes": [len(data)]})

    return pixels.select(by, "row", "col", *bands).groupBy(by).applyInPandas(run, f"`{by}` {dict(pixels.dtypes)[by]}, path string, bytes long")


def chip_of(path):
    """The name that `write` gave a file, as a column."""
    return F.regexp_extract(path, r"([^/]+)\.tiff?$", 1)
