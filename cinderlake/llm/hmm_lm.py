"""Hidden Markov language model.

Tokens are lower-cased words and an end for each text. Counts of all training tokens are made in Spark. The most
frequent FREQUENT tokens, about, are symbols of their own. The others' emissions are tied, as in class-based models: a
token has the symbol of its class, one of CLASSES by its last bytes, times its own share of the class by its count,
which no state changes and which smoothing leaves room in for unseen tokens, so the probabilities of all sequences
add up to one. A state's preference among rare tokens couldn't be told from so few of each. Baum-Welch starts from the
counts of all training tokens, which each state's emissions spread by fixed noise, and every round goes over all training
texts: each partition's expected counts are added up in Spark, block by block of symbols. The scaled forward recursion
gives each text's exact likelihood.

Counts of the most frequent tokens, KNOWN at most, are sent to all tasks (a bounded table); other tokens of a text are
joined with the counts by their hash. Tokens are told by 64-bit hashes.

Edge cases: null text is the empty text: one end token; texts and tokens of any length are read whole; repeated rows are
scored each; rows with a null id are learned from; tokens of equal counts are all frequent or all not; if there is
nothing to learn from, all states are alike; an empty table gives an empty one; extra columns are left out, and none
can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.chain import Chain
from cinderlake.llm.common import Words, give_back, gram_hashes, most_frequent, released, slices, staged

STATES = 8
FREQUENT = 1 << 15
CLASSES = 1 << 10
KNOWN = 1 << 19
ROUNDS = 4
#: Deviation of the logarithm of a first emission from the symbol's frequency: near equal states take many rounds to part.
SPREAD = 0.5
#: Share of the overall symbol frequencies in each state's.
SMOOTH = 0.005
BLOCK = 256
STEP = 200_000

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
#: The end token's hash; words' hashes are of other values but for one chance in 2**64.
END = np.int64(-1)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and classes of all tokens, ends included, and the first of each text."""
    w = Words(texts)
    data = _LOWER[w.buf] + np.uint64(1)
    h = gram_hashes(data, w.start, w.end - w.start).view(np.int64)
    last = np.minimum(w.end - w.start, 3)
    c = (gram_hashes(data, w.end - last, last) % np.uint64(CLASSES)).astype(np.int32)
    ends = w.first[1:]
    first = w.first + np.arange(len(w.first))
    return np.insert(h, ends, END), np.insert(c, ends, 0), first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "text"):
            h, c, _ = _tokens(b.column("text"))
            keys, at, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.record_batch([keys, c[at], n], names=["h", "cls", "n"])


class Vocabulary:
    """Counts and symbols of the most frequent tokens, and totals of all."""

    def __init__(self, counts: DataFrame, frequent: int = FREQUENT, known: int = KNOWN):
        top = most_frequent(counts, known).toArrow()
        h, n, cls = (top.column(c).to_numpy() for c in ("h", "n", "cls"))
        first = np.lexsort((h, -n))
        h, n, cls = h[first], n[first], cls[first]
        # of equal counts all or none
        limit = len(n) if len(n) <= frequent else int(np.searchsorted(-n, -n[frequent], side="left"))
        symbol = np.where(np.arange(len(h)) < limit, np.arange(len(h)) + CLASSES, cls)
        order = np.argsort(h)
        self.h, self.n, self.symbol = h[order], n[order], symbol[order].astype(np.int32)
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        self.tokens, self.distinct = int(total[0]), int(total[1])
        # classes hold all tokens but the frequent ones; at most CLASSES rows come back
        rows = counts.groupBy("cls").agg(F.sum("n"), F.count("*")).collect()
        self.class_n, self.class_v = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in rows:
            self.class_n[r[0]], self.class_v[r[0]] = r[1], r[2]
        np.subtract.at(self.class_n, cls[:limit], n[:limit])
        np.subtract.at(self.class_v, cls[:limit], 1)
        self.size = CLASSES + limit
        self.symbol_n = np.concatenate([self.class_n, n[:limit]])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the table, and whether the token is there."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return at, self.h[at] == h

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))

    def within(self, n: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Log share of a token with this count in its class."""
        return np.log10((n + 0.1) / (self.class_n[cls] + 0.1 * (self.class_v[cls] + 1)))


_CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, own double, symbols array<int>, rare array<struct<h:bigint,cls:int,tf:int>>"


def _encode(shared):
    rare_type = pa.struct([("h", pa.int64()), ("cls", pa.int32()), ("tf", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        for whole in batches:
            for b in slices(whole, "text"):
                h, c, first = _tokens(b.column("text"))
                size = np.diff(first)
                keys, at, inverse = np.unique(h, return_index=True, return_inverse=True)
                place, there = v.find(keys)
                n = np.where(there, v.n[place] if len(v.n) else 0, 0)
                cls = c[at]
                symbol = np.where(there, v.symbol[place] if len(v.n) else 0, cls)
                base = np.where(there, v.base(n), 0.0)
                own = np.where(there & (symbol < CLASSES), v.within(n, cls), 0.0)
                sums = lambda x: np.add.reduceat(x[inverse], first[:-1]) if len(size) else np.zeros(0)
                doc = np.repeat(np.arange(len(size)), size)
                far = ~there[inverse]
                pair, tf = np.unique(doc[far] * np.int64(len(keys)) + inverse[far], return_counts=True)
                row, key = pair // max(len(keys), 1), pair % max(len(keys), 1)
                rare = pa.StructArray.from_arrays([pa.array(keys[key]), pa.array(cls[key]), pa.array(tf.astype(np.int32))], fields=list(rare_type))
                edges = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"), b.column("held_out"), pa.array(size.astype(np.int64)), pa.array(sums(there.astype(np.int64)).astype(np.int64)),
                        pa.array(sums(base)), pa.array(sums(own)),
                        pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(symbol[inverse].astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(edges), rare),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "own", "symbols", "rare"],
                )

    return run


class Model:
    """start: K; trans: K x K; emit: symbols x K."""

    def __init__(self, start: np.ndarray, trans: np.ndarray, emit: np.ndarray):
        self.start, self.trans, self.emit = start, trans, emit

    @classmethod
    def first(cls, symbol_n: np.ndarray, states: int) -> Model:
        rng = np.random.default_rng(3)
        counts = (symbol_n[:, None] + 0.5) * np.exp(SPREAD * rng.normal(size=(len(symbol_n), states)))
        trans = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return cls(np.full(states, 1 / states), trans, counts / counts.sum(0))

    @classmethod
    def of_counts(cls, emit: np.ndarray, trans: np.ndarray, symbol_n: np.ndarray) -> Model:
        states = emit.shape[1]
        prior = (symbol_n + 0.5) / (symbol_n + 0.5).sum()
        emit = emit + (SMOOTH * emit.sum(0) + 1.0) * prior[:, None]
        trans = trans + 0.1
        trans = trans / trans.sum(1, keepdims=True)
        return cls(np.full(states, 1 / states), trans, emit / emit.sum(0))

    def chain(self, symbols: np.ndarray, first: np.ndarray) -> Chain:
        return Chain(self.emit[symbols], first, self.start, self.trans)

    def expected(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # counts bear single precision; likelihoods are taken in double
        gamma, pairs = Chain(self.emit.astype(np.float32)[symbols], first, self.start, self.trans).posteriors(pairs=True)
        k = len(self.start)
        emit = np.stack([np.bincount(symbols, gamma[:, j], len(self.emit)) for j in range(k)], 1)
        return emit, pairs


def _sequences(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    lists = b.column("symbols")
    total = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    at = 0
    while at < len(lists):
        to = max(at + 1, int(np.searchsorted(total, total[at] + STEP, side="right")) - 1)
        yield at, to, lists.slice(at, to - at).flatten().to_numpy(), total[at : to + 1] - total[at]
        at = to


def _expect(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        emit, trans = np.zeros_like(model.emit), np.zeros_like(model.trans)
        for b in batches:
            for _, _, symbols, first in _sequences(b):
                e, t = model.expected(symbols, first)
                emit += e
                trans += t
        rows = np.concatenate([trans, emit]).astype(np.float32)
        some = [i for i in range(0, len(rows), BLOCK) if rows[i : i + BLOCK].any()]
        yield pa.record_batch([pa.array([i // BLOCK for i in some], pa.int32()), pa.array([rows[i : i + BLOCK].tobytes() for i in some], pa.binary())], names=["block", "sums"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, s in zip(b.column("block").to_pylist(), b.column("sums").to_pylist(), strict=True):
            total[k] = total.get(k, 0.0) + np.frombuffer(s, np.float32).astype(np.float64)
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "sums"])


def baum_welch(coded: DataFrame, v: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """coded: symbols of the training texts, all of which every round takes."""
    spark = coded.sparkSession
    model = Model.first(v.symbol_n, states)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        sums = coded.select("symbols").mapInArrow(released(_expect(shared)), "block int, sums binary")
        # dealt by block: the sums of one block come from all tasks, and are added up as they come
        rows = sums.repartition("block").mapInArrow(_add_up, "block int, sums binary").toArrow()
        table = np.zeros((states + v.size, states))
        for k, s in zip(rows.column("block").to_pylist(), rows.column("sums"), strict=True):
            part = np.frombuffer(s.as_buffer(), np.float64).reshape(-1, states)
            table[k * BLOCK : k * BLOCK + len(part)] = part
        if table.sum() > 0:
            model = Model.of_counts(table[states:], table[:states], v.symbol_n)
        shared.destroy()
        del rows
        give_back()
    return model


def _likelihood(shared):
    schema = pa.schema([("rid", pa.int64()), ("log10", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = b.column("rid").to_numpy()
            for at, to, symbols, first in _sequences(b):
                yield pa.record_batch([rid[at:to], shared.value.chain(symbols, first).log_z / np.log(10)], schema=schema)

    return run


def score(docs: DataFrame, folds: int = 10, out: int = 0, states: int = STATES, rounds: int = ROUNDS, frequent: int = FREQUENT, known: int = KNOWN) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), learned outside the held-out fold."""
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == out, F.lit(False))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    counts = staged(src.where(~F.col("held_out")).select("text").mapInArrow(released(_count), "h long, cls int, n long").groupBy("h").agg(F.min("cls").alias("cls"), F.sum("n").alias("n")), "counts")
    v = Vocabulary(counts, frequent, known)
    give_back()
    shared = spark.sparkContext.broadcast(v)
    coded = staged(src.mapInArrow(released(_encode(shared)), _CODED).withColumn("rid", F.monotonically_increasing_id()), "coded")
    shared.destroy()
    model = spark.sparkContext.broadcast(baum_welch(coded.where(~F.col("held_out")), v, states, rounds))
    likely = coded.select("rid", "symbols").mapInArrow(released(_likelihood(model)), "rid long, log10 double")
    rare = coded.select("rid", F.explode("rare").alias("r")).select("rid", "r.h", "r.cls", "r.tf")
    totals = spark.createDataFrame([(k, float(v.class_n[k]), float(v.class_v[k])) for k in range(CLASSES)], "cls int, class_n double, class_v double")
    n = F.coalesce(F.col("n"), F.lit(0))
    found = rare.join(counts.select("h", "n"), "h", "left").join(F.broadcast(totals), "cls")  # CLASSES rows
    found = found.groupBy("rid").agg(
        F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("far_known"),
        F.sum(F.col("tf") * F.log10((n + 0.1) / F.lit(v.tokens + 0.1 * (v.distinct + 1)))).alias("far_base"),
        F.sum(F.col("tf") * F.log10((n + 0.1) / (F.col("class_n") + 0.1 * (F.col("class_v") + 1)))).alias("far_own"),
    )
    out_rows = coded.select("rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "own").join(likely, "rid").join(found, "rid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out_rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("far_known")).cast("long").alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("far_base")).alias("base_score"), (F.col("log10") + F.col("own") + zero("far_own")).alias("score"),
    )
