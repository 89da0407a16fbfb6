"""Quality classifier: random-indexing word vectors, pooled by document, and a two-layer network.

Every word gives two tokens, its letters and its shape (which kinds of characters follow each other, to the word's end),
each in one of BUCKETS by its hash. A token has a sparse random index of a few signs; its vector is the sum of the
indices of the tokens around it, over all documents, and a part of its own index. These sums are added up in Spark,
block by block of buckets, in as many tasks as there are blocks and in streams of bounded size. A document is the mean
of its tokens' vectors with the log of its length, and a network with one hidden layer, in numpy, gives the
probability, at a temperature fitted on rows kept apart.

The network is fitted on a bounded sample of the labelled rows, SAMPLE of them: of the distinct labels those of the smallest
hashes, and of the different rows with their ids likewise. Vectors cover all documents.

Edge cases: null text is the empty text, which is scored too; texts and words of any length are read whole; labels of null
quality or id are left out; repeated labels and repeated rows are learned from once; an id with both labels is learned from
with both; labels of one class only give all texts its share, smoothed by half a row
of either; if there is nothing to learn from, all scores are 0.5; a null
id is not held out; repeated rows are scored each; an empty table gives an empty one; input columns named like the result's
are replaced, others stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import Words, give_back, gram_hashes, mixed, released, slices, small_batches, smallest_hashes

BUCKETS = 1 << 15
DIM = 64
#: Signs in a random index.
SIGNS = 4
REACH = 2
SAMPLE = 20_000
HIDDEN = 32
#: Buckets whose sums are one row of the shuffle.
BLOCK = 64
#: Bytes of text that one step counts or scores.
SLICE = 1 << 20

_KIND = np.zeros(256, np.uint8)
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
for _k in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)):
    _KIND[_k] = 4 + _k % 60


def _index() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's random index."""
    h = mixed((np.arange(BUCKETS * SIGNS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).reshape(BUCKETS, SIGNS)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0).astype(np.float32)


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' letters and of their shapes."""
    lower = w.buf + np.where((w.buf >= 65) & (w.buf <= 90), 32, 0).astype(np.uint8)
    kind = _KIND[w.buf]
    letter = (kind == 1) | (kind == 2)
    solid = np.zeros(len(w.buf), bool)
    solid[w.start] = True
    change = solid.copy()
    change[1:] |= kind[1:] != kind[:-1]
    out = []
    for keep, values in ((letter, lower + np.uint64(1)), (change, kind + np.uint64(300))):
        rank = np.concatenate([[0], np.cumsum(keep)])
        a, z = rank[w.start], rank[w.end]
        out.append((gram_hashes(values[keep], a, z - a) % np.uint64(BUCKETS)).astype(np.int64))
    return out[0], out[1]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sign = _index()
    sums = np.zeros(BUCKETS * DIM, np.float64)
    for whole in batches:
        for b in slices(whole, "text", SLICE):
            w = Words(b.column("text"))
            if not len(w):
                continue
            letters, shapes = tokens(w)
            doc = np.repeat(np.arange(b.num_rows), np.diff(w.first))
            for step in range(1, REACH + 1):
                same = doc[step:] == doc[:-step]
                for x, y in ((letters, letters), (shapes, letters), (shapes, shapes)):
                    for at, by in ((x[step:], y[:-step]), (x[:-step], y[step:])):
                        at, by = at[same], by[same]
                        flat = (at[:, None] * DIM + place[by]).ravel()
                        sums += np.bincount(flat, sign[by].ravel(), BUCKETS * DIM)
    blocks = sums.astype(np.float32).reshape(-1, BLOCK * DIM)
    some = np.flatnonzero(blocks.any(1))
    yield pa.record_batch([some.astype(np.int32), pa.array([blocks[k].tobytes() for k in some], pa.binary())], names=["block", "sums"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, s in zip(b.column("block").to_pylist(), b.column("sums").to_pylist(), strict=True):
            total[k] = total.get(k, 0.0) + np.frombuffer(s, np.float32).astype(np.float64)
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], names=["block", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of all buckets, from the words around them in all documents."""
    parts = docs.select("text").mapInArrow(released(_contexts), "block int, sums binary")
    # dealt by block: the sums of one block come from all tasks, and are added up as they come
    rows = parts.repartition("block").mapInArrow(_add_up, "block int, sums binary").toArrow()
    sums = np.zeros((BUCKETS // BLOCK, BLOCK * DIM), np.float32)
    for k, s in zip(rows.column("block").to_pylist(), rows.column("sums"), strict=True):
        sums[k] = np.frombuffer(s.as_buffer(), np.float32)
    del rows
    give_back()
    sums = sums.reshape(BUCKETS, DIM)
    place, sign = _index()
    own = np.zeros((BUCKETS, DIM), np.float32)
    np.add.at(own, (np.arange(BUCKETS)[:, None], place), sign)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    common = unit(sums).mean(0)
    return unit(unit(sums) - common) + unit(own)


def features(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    w = Words(texts)
    size = np.diff(w.first)
    out = np.zeros((len(size), 2 * DIM + 1), np.float32)
    out[:, -1] = np.log1p(size)
    some = np.flatnonzero(size)
    if len(some):
        for k, t in enumerate(tokens(w)):
            out[some, k * DIM : (k + 1) * DIM] = np.add.reduceat(vectors[t], w.first[some], axis=0) / size[some, None]
    return out


class Network:
    """Two layers; probabilities at a fitted temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 40, batch: int = 128, rate: float = 0.004):
        rng = np.random.default_rng(5)
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        x = self._scaled(x)
        order = rng.permutation(len(x))
        # a sixth for the temperature alone, at every size
        apart, own = order[: len(x) // 6], order[len(x) // 6 :]
        # all scores are 0.5 to begin with
        self.p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), np.zeros(1)]
        self.temperature = 1.0
        if y.min() == y.max():
            # nothing to tell apart: every text has the smoothed share
            self.p[3] += np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
            return
        m, v, t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for e in range(epochs):
            for _ in range(max(-(-len(own) // batch), 8)):
                k = own[rng.integers(0, len(own), min(batch, len(own)))]
                h = np.tanh(x[k] @ self.p[0] + self.p[1])
                d = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3][0]))) - y[k]) / len(k)
                dh = d[:, None] * self.p[2] * (1 - h**2)
                g = [x[k].T @ dh + 1e-4 * self.p[0], dh.sum(0), h.T @ d + 1e-4 * self.p[2], np.array([d.sum()])]
                t += 1
                for j in range(4):
                    m[j] = 0.9 * m[j] + 0.1 * g[j]
                    v[j] = 0.999 * v[j] + 0.001 * g[j] ** 2
                    self.p[j] -= rate * (1 - e / epochs) * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        z = self._logit(x[apart])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        # a few rows hardly move it from 1
        loss = [np.sum(np.logaddexp(0, z / s) - y[apart] * z / s) + np.log(s) ** 2 for s in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8).astype(np.float64)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit(self._scaled(x)) / self.temperature, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int = SAMPLE) -> Network | None:
    """docs: doc_id, text; labels: doc_id, quality. None if there are no labelled rows."""
    known = labels.select("doc_id", F.col("quality").alias("quality")).where("quality is not null and doc_id is not null").distinct()
    # bounded by `sample`, so the labels can be sent to the texts
    drawn = F.broadcast(smallest_hashes(known, F.xxhash64("doc_id", "quality"), sample).select("doc_id", "quality"))
    labelled = docs.select("doc_id", "text").join(drawn, "doc_id").select("text", "quality", F.xxhash64("doc_id", "text", "quality").alias("h"))
    # an id may have any number of rows, of which the sample takes `sample` different ones as well
    kept = smallest_hashes(labelled.select("h").distinct(), F.xxhash64("h"), sample).select("h")
    rows = labelled.join(F.broadcast(kept), "h", "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                x = features(b.column("text"), shared.value)
                yield pa.record_batch([b.column("h"), pa.array([r.tobytes() for r in x], pa.binary()), b.column("quality").cast(pa.int32())], names=["h", "x", "y"])

    # rows of one hash are repeated rows
    found = rows.mapInArrow(released(run), "h long, x binary, y int").groupBy("h").agg(F.min("x").alias("x"), F.min("y").alias("y")).toArrow()
    shared.destroy()
    if not found.num_rows:
        return None
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(found.num_rows, -1)
    y = found.column("y").to_numpy().astype(np.float64)
    order = np.argsort(found.column("h").to_numpy())  # the rows come in any order
    return Network(x[order], y[order])


def score(docs: DataFrame, vectors: np.ndarray, network: Network | None, out: str = "score") -> DataFrame:
    """docs (without a column of that name) and the score of its text."""
    src = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out])
    if network is None:
        return src.withColumn(out, F.lit(0.5))
    names = src.columns
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                p = network(features(b.column("text"), vectors))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*names, out])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema)
    return src.mapInArrow(released(run), f"{fields}{out} double")


def held_out(doc_id, folds: int, out: int):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == out, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, out: int = 1, sample: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text and others) with held_out and score, learned from labels outside the held-out fold."""
    small_batches(docs.sparkSession)
    src = docs.drop("held_out", "score")
    vectors = word_vectors(src)
    network = train(src, labels.where(~held_out(F.col("doc_id"), folds, out)), vectors, sample)
    return score(src.withColumn("held_out", held_out(F.col("doc_id"), folds, out)), vectors, network)
