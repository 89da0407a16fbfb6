"""Helpers that the text operators share: row keys, staged tables, batch slicing and vectorised word scanning."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.staging import staged

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[ \t-\r]+"

#: Bytes of text that one vectorised step takes; bounds the memory of a Python worker.
SLICE_BYTES = 3 << 18
#: Rows of texts in a batch for a Python worker, at most.
BATCH_ROWS = 500


def free(name: str, *frames: DataFrame) -> str:
    """name, with underscores in front until no table has a column of that name in any case of letters."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is taken once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_row_id(docs: DataFrame, name: str) -> DataFrame:
    """docs, staged, with a different number in each row: rows that are equal otherwise can be told apart again."""
    return staged(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def smallest_hashes(rows: DataFrame, h: Column, k: int, name: str = "_h") -> DataFrame:
    """The `k` rows with the smallest values of a 64-bit hash, in order, the same choice at every size.

    Rows are to be distinct: copies would take the places of others. Rows beyond the hash below which k of them surely lie go
    first, so that what is put in order is little more than k rows, however many there are; should fewer lie there, all are
    put in order."""
    n = rows.count()
    hashed = rows.withColumn(name, h)
    share = (k + 8 * k**0.5 + 50) / max(n, 1)
    if share < 1:
        low = hashed.where(F.col(name) <= F.lit(int(-(1 << 63) + share * (1 << 64))))
        if low.count() >= k:
            hashed = low
    return hashed.orderBy(name).limit(k)


def most_frequent(counts: DataFrame, size: int, n: str = "n") -> DataFrame:
    """The rows of the largest counts, `size` of them at most; of equal counts all or none.

    The least count comes from how many rows there are of each: exact up to 4096, above that within powers of 2 ** (1/64),
    so that some thousand numbers reach the driver, and nothing is put in order."""
    large = F.floor(F.log2(n) * 64) / 64
    level = F.when(F.col(n) <= 4096, F.col(n).cast("double")).otherwise(F.pow(F.lit(2.0), large))
    rows = counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows"), F.min(n).alias("least")).collect()
    taken, least = 0, None
    for r in sorted(rows, key=lambda r: -r["level"]):
        taken += r["rows"]
        if taken > size:
            break
        least = r["least"]
    return counts.where(F.col(n) >= least) if least is not None else counts.limit(0)


def row_keys(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """Two non-null longs that agree exactly for rows with the same id and the same text.

    Rows that agree in both are repeated rows; whatever is computed for one holds for the other, so a side
    that is aggregated by these keys can be joined to all of them."""
    i, t = F.col(doc_id), F.col(text)
    return F.coalesce(i.cast("long"), F.lit(0)), F.xxhash64(t, i.isNull(), t.isNull())


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have at most `limit` bytes together (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers BATCH_ROWS rows at a time, or fewer if the session says so.

    An executor holds several copies of the batch of each running task, outside its heap and in two workers; with Spark's
    10 000 rows that is all of a task's texts. The setting stays with the session, as plans are made when they run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving memory back at the end of a task: Python workers wait for further tasks, and would keep it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    """Give unused memory back to the system; tables that are quickly made again go too."""
    _POWERS[:] = [np.ones(1, np.uint64), np.zeros(1, np.uint64), np.ones(1, np.uint64)]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Words of a column of texts as byte ranges, without making strings.

    buf: all texts' bytes; start, end: byte range of each word; first: index of each document's first word,
    with one entry more than there are documents."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        base = off[0]
        self.buf = np.frombuffer(data, np.uint8)[base : off[-1]] if data is not None else np.zeros(0, np.uint8)
        self.offsets = off - base
        n = len(self.buf)
        solid = ~_SPACE[self.buf]
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], before[1:] = False, solid[:-1]
            after[-1], after[:-1] = False, solid[1:]
            inner = self.offsets[(self.offsets > 0) & (self.offsets < n)]
            before[inner] = False
            after[inner - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets, side="left")

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same for equal words anywhere."""
        return mixed(_ranges(self.buf + np.uint64(1), self.start, self.end))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, a public mixing function."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Hashes of ranges are polynomials modulo this prime: two ranges of n values agree for n of its bases at most.
PRIME = (1 << 61) - 1
_BASE = 0x1342543DE82EF95
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
#: Powers of the base, split into 31 lower and 30 upper bits, and of its inverse; longest range whose split sums are exact
#: for values up to SMALL.
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.zeros(1, np.uint64), np.ones(1, np.uint64)]
SMALL, SMALL_RANGE = 1023, 1 << 22


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for any x below 2**64."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for numbers below it."""
    au, al, bu, bl = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    cross = al * bu + au * bl
    # 2 ** 61 is 1: the product of upper parts counts twice, and the cross products' upper bits come round
    return _reduced(np.uint64(2) * au * bu + (cross >> np.uint64(30)) + ((cross & _LOW30) << np.uint64(31)) + al * bl)


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 18)
        found = []
        for b in (_BASE, pow(_BASE, -1, PRIME)):
            p = np.ones(size, np.uint64)
            k = 1
            while k < size:
                more = min(k, size - k)
                p[k : k + more] = _times(p[:more], np.uint64(pow(b, k, PRIME)))
                k *= 2
            found.append(p)
        _POWERS[:] = [found[0] & _LOW31, found[0] >> np.uint64(31), found[1]]
    return _POWERS


def _ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash modulo PRIME of values[start:end] for many ranges at once, from prefix sums."""
    n = len(values)
    low, high, inverse = _powers(n + 1)
    values = values.astype(np.uint64, copy=False)
    small = n == 0 or int(values.max()) <= SMALL and int((end - start).max(initial=0)) <= SMALL_RANGE
    if not small:
        t = _times(_reduced(values), (high[:n] << np.uint64(31)) + low[:n])
    sums = []
    # sums may run over, their differences don't
    for part in (values * low[:n], values * high[:n]) if small else (t & _LOW31, t >> np.uint64(31)):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        sums.append(_reduced(total[end] - total[start]))
    whole = _reduced(sums[0] + _times(sums[1], np.uint64(1 << 31)))
    return _times(whole, inverse[start])


def gram_hashes(words: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of words[start : start + length] for many ranges of word hashes."""
    return mixed(_ranges(words, start, start + length) + np.uint64(0x9E3779B97F4A7C15) * np.asarray(length).astype(np.uint64))
