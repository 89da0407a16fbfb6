"""Whitening of embeddings from an exact scatter in residue numbers.

Entries become whole numbers x = floor(scale * c) + shift. A first pass takes n and the sums S of each dimension, exactly; the
centred vectors n * x - S are whole numbers too. A second pass multiplies them by themselves modulo several primes: below
2**20 a partition's products of residues, a few hundred rows at a time, are exact in double precision, so they are plain
matrix products. The residues are added up in Spark by blocks of rows of the scatter; the Chinese remainder theorem gives
the scatter itself, whole numbers of any size, from as many primes as its bound asks for. Its quotient by n**3 is the
covariance, correctly rounded entry by entry, and numpy's eigh in double precision gives the components. A third pass takes
the covariance of what comes out, and the last one gives the rows.

Memory and what reaches the driver depend on the number of dimensions only (its square times the primes), not on the rows.

Edge cases: rows whose vector is null or holds null or non-finite entries are left out, and so are vectors without entries;
vectors of another length have a fit of their own; null ids stay; repeated rows count and come out each; entries beyond
2**53 / scale count as that, since doubles don't tell neighbouring whole numbers apart there; a deviation that is no long is
null (`deviation_exact` has up to 38 digits); a component whose share of the variance is below 1e-12 (equal vectors, fewer
vectors than dimensions) has a null `whitened` and no part in identity_error, which is null if there are no others;
components of equal eigenvalues may come in any order; an empty table gives an empty one; extra columns are left out, and
none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import released

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows of one step: their sums fit a long, and their products of residues are exact in a double.
STEP = 512
#: Entries of one step.
STEP_ENTRIES = 1 << 20
#: Rows of the scatter that are one row of the shuffle.
BLOCK = 8
#: Least share of the variance that a component is whitened at.
LEAST_SHARE = 1e-12

_OUT = "vec_id long, n long, deviation long, deviation_exact decimal(38,0), parts array<struct<component:int,whitened:double,explained:double>>, identity_error double"


def primes(below: int = 1 << 20) -> Iterator[int]:
    """Primes in falling order."""
    small = [p for p in range(2, int(below**0.5) + 1) if all(p % q for q in range(2, int(p**0.5) + 1))]
    return (x for x in range(below - 1, 1, -1) if all(x % p for p in small if p * p <= x))


class Fit:
    """What the passes so far know of the vectors of one length."""

    def __init__(self, n: int, sums: list[int], low: list[int], high: list[int]):
        self.n, self.sums = n, sums
        # whether n * x - S is a long
        self.small = max(n * max(map(abs, (*low, *high))), *map(abs, sums)) < 1 << 61
        self.reach = max(max(abs(n * a - s), abs(n * b - s)) for s, a, b in zip(sums, low, high, strict=True))
        self.primes: list[int] = []
        product, bound = 1, 2 * n * self.reach**2 + 1
        for p in primes():
            if product > bound:
                break
            self.primes.append(p)
            product *= p
        self.projection = np.zeros((len(sums), 0))
        self.explained: list[float | None] = []
        self.error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in Python's numbers where they don't fit a long."""
        if self.small:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def deviations(self, d: np.ndarray) -> list[int]:
        """Sums of squares of the rows, exact: by limbs of 24 bits where a long can't hold them."""
        if d.dtype == object:
            return (d * d).sum(1).tolist()
        if d.shape[1] * self.reach**2 < 1 << 63:
            return (d * d).sum(1).tolist()
        a = np.abs(d)
        limbs = [a & 0xFFFFFF, (a >> 24) & 0xFFFFFF, a >> 48]
        total = np.zeros(len(d), object)
        for i, x in enumerate(limbs):
            for j, y in enumerate(limbs):
                total = total + (x * y).sum(1).astype(object) * (1 << 24 * (i + j))
        return total.tolist()

    def solve(self, scatter: np.ndarray, components: int) -> None:
        """Components from the exact scatter of n * x - S."""
        cube = self.n**3
        covariance = np.array([[v / cube for v in row] for row in scatter.tolist()])
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
        trace = sum(scatter[k, k] for k in range(len(scatter))) / cube
        self.explained = [float(e) / trace if trace else None for e in values]
        fine = values > LEAST_SHARE * trace
        self.projection = np.where(fine, vectors / np.sqrt(np.where(fine, values, 1.0)), np.nan)

    def whitened(self, d: np.ndarray) -> np.ndarray:
        return (d / self.n).astype(np.float64) @ self.projection


def remaindered(residues: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The whole numbers, of either sign, with these residues, by the Chinese remainder theorem."""
    product = 1
    for p in moduli:
        product *= p
    total = np.zeros(residues[0].shape, object)
    for r, p in zip(residues, moduli, strict=True):
        rest = product // p
        total = (total + r.astype(object) * (rest * pow(rest, -1, p))) % product
    return np.where(total > product // 2, total - product, total)


def _levels(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of vectors of one length: length, places in the batch, whole numbers."""
    lists = b.column("v")
    size = lists.value_lengths().to_numpy()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    first = np.cumsum(size) - size
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        step = max(1, min(STEP, STEP_ENTRIES // max(dim, 1)))
        for k in range(0, len(rows) if dim else 0, step):
            own = rows[k : k + step]
            c = flat[first[own, None] + np.arange(dim)]
            with np.errstate(over="ignore"):
                x = np.floor(np.clip(c * SCALE, -(2.0**53), 2.0**53)).astype(np.int64) + SHIFT
            yield dim, own, x


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for b in batches:
        for dim, _, x in _levels(b):
            n, s, low, high = found.get(dim) or (0, np.zeros(dim, object), x[0], x[0])
            found[dim] = [n + len(x), s + x.sum(0).astype(object), np.minimum(low, x.min(0)), np.maximum(high, x.max(0))]
    for dim, (n, s, low, high) in found.items():
        total = pa.array([Decimal(v) for v in s.tolist()], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), total, pa.array(low), pa.array(high)], names=["dim", "k", "n", "s", "low", "high"])


def _products(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits: dict[int, Fit] = shared.value
        found: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for dim, _, x in _levels(b):
                fit = fits[dim]
                for p in fit.primes:
                    r = (x % p * (fit.n % p) - np.array([s % p for s in fit.sums], np.int64)) % p
                    r = np.where(r > p // 2, r - p, r).astype(np.float64)
                    found[dim, p] = (found.get((dim, p), 0) + (r.T @ r).astype(np.int64)) % p
        for (dim, p), g in found.items():
            at = range(0, dim, BLOCK)
            kind = [pa.array([v] * len(at), pa.int32()) for v in (dim, p)]
            blocks = pa.array([k // BLOCK for k in at], pa.int32())
            yield pa.RecordBatch.from_arrays([*kind, blocks, pa.array([g[k : k + BLOCK].astype(np.int32).tobytes() for k in at], pa.binary())], names=["dim", "prime", "block", "sums"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int, int], np.ndarray] = {}
    for b in batches:
        for dim, p, k, s in zip(*[b.column(c).to_pylist() for c in ("dim", "prime", "block", "sums")], strict=True):
            total[dim, p, k] = (total.get((dim, p, k), 0) + np.frombuffer(s, np.int32).astype(np.int64)) % p
    keys = [pa.array([x[j] for x in total], pa.int32()) for j in range(3)]
    yield pa.RecordBatch.from_arrays([*keys, pa.array([v.astype(np.int32).tobytes() for v in total.values()], pa.binary())], names=["dim", "prime", "block", "sums"])


def _moments(shared):
    """Sums of the whitened values, which are centred, and of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits: dict[int, Fit] = shared.value
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, _, x in _levels(b):
                w = fits[dim].whitened(fits[dim].centred(x))
                found[dim] = found.get(dim, 0.0) + np.vstack([w.sum(0), w.T @ w])
        for dim, m in found.items():
            i, j = (v.ravel() for v in np.indices(m.shape))
            yield pa.RecordBatch.from_arrays([pa.array([dim] * m.size, pa.int32()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m.ravel())], names=["dim", "i", "j", "s"])

    return run


def _rows(shared):
    kind = pa.struct([("component", pa.int32()), ("whitened", pa.float64()), ("explained", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits: dict[int, Fit] = shared.value
        for b in batches:
            for dim, own, x in _levels(b):
                fit = fits[dim]
                d = fit.centred(x)
                w = fit.whitened(d)
                many, k = w.shape
                exact = fit.deviations(d)
                parts = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), pa.array(w.ravel(), from_pandas=True), pa.array(fit.explained * many, pa.float64())], fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("vec_id").take(pa.array(own)), pa.array([fit.n] * many, pa.int64()), pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()),
                        pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0)), pa.ListArray.from_arrays(pa.array(np.arange(many + 1, dtype=np.int32) * k), parts),
                        pa.array([fit.error] * many, pa.float64()),
                    ],
                    names=["vec_id", "n", "deviation", "deviation_exact", "parts", "identity_error"],
                )

    return run


def fit(src: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """src: v, vectors without null or non-finite entries. A fit for each length of vectors."""
    spark = src.sparkSession
    v = src.select("v")
    found: dict[int, list] = {}
    sums = v.mapInArrow(released(_sums), "dim int, k int, n long, s decimal(38,0), low long, high long")
    # as many rows as the vectors have dimensions
    for r in sums.groupBy("dim", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim", "k").collect():
        found.setdefault(r.dim, []).append((r.n, int(r.s), r.low, r.high))
    fits = {dim: Fit(rows[0][0], *[list(c) for c in zip(*[x[1:] for x in rows], strict=True)]) for dim, rows in found.items()}
    if not fits:
        return fits
    shared = spark.sparkContext.broadcast(fits)
    parts = v.mapInArrow(released(_products(shared)), "dim int, prime int, block int, sums binary")
    # dealt by block: the residues of one block come from all tasks, and are added up as they come
    residues: dict[tuple[int, int], np.ndarray] = {(dim, p): np.zeros((dim, dim), np.int64) for dim, f in fits.items() for p in f.primes}
    for r in parts.repartition("dim", "prime", "block").mapInArrow(_add_up, "dim int, prime int, block int, sums binary").collect():
        part = np.frombuffer(r.sums, np.int32).reshape(-1, r.dim)
        residues[r.dim, r.prime][r.block * BLOCK : r.block * BLOCK + len(part)] = part
    for dim, f in fits.items():
        f.solve(remaindered([residues[dim, p] for p in f.primes], f.primes), components)
    shared.destroy()
    shared = spark.sparkContext.broadcast(fits)
    moments = v.mapInArrow(released(_moments(shared)), "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s"))
    tables = {dim: np.zeros((len(f.explained) + 1, len(f.explained))) for dim, f in fits.items()}
    for r in moments.collect():
        tables[r.dim][r.i, r.j] = r.s
    for dim, f in fits.items():
        mean, square = tables[dim][0] / f.n, tables[dim][1:] / f.n
        error = np.abs(square - np.outer(mean, mean) - np.eye(len(mean)))
        f.error = float(np.nanmax(error)) if np.isfinite(error).any() else None
    shared.destroy()
    return fits


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, deviation_exact, whitened, explained, identity_error) of vectors (vec_id, embedding)."""
    v = F.col("embedding")
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c))
    src = vectors.where(v.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fits = fit(src, components)
    shared = vectors.sparkSession.sparkContext.broadcast(fits)
    rows = src.mapInArrow(released(_rows(shared)), _OUT)
    return rows.select("vec_id", "n", "deviation", "deviation_exact", "identity_error", F.inline("parts")).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"
    )
