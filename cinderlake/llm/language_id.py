"""Language identification with a linear-chain conditional random field over words.

Each word has features of its affixes (one to three bytes at either end), its n-grams of two and three bytes and
the word itself (the lexicon), hashed into one table of weights for each language; transitions between languages
are learned too. Forward-backward labels every word of a text, so text that switches between languages keeps both;
a document's language is the one with most of its words' probability, and that share is its score.

The field is trained on a bounded sample of labelled text: SAMPLE distinct runs of RUN characters at most (a text is cut
into as many as it takes), those of the smallest hashes, the same choice at every size. All documents are labelled over
their whole texts.

Edge cases: null texts and texts without a letter are `und` with score 0; texts and words of any length are labelled whole;
of languages with equal shares the first by name is told; if there is nothing to learn from, all texts are `und`; rows
with a null id are learned from; repeated rows are labelled each; an empty table gives an empty one; extra columns are
left out, and none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.chain import Chain
from cinderlake.llm.common import Words, give_back, gram_hashes, released, slices, smallest_hashes

SAMPLE = 2_500
#: Characters of a run of text that the sample takes; a word at a run's border is two.
RUN = 20_000
BUCKETS = 1 << 18
EPOCHS = 4
#: Longest word, in bytes, that is one position of the chain; longer ones are runs of so many bytes, each a position.
WORD_BYTES = 64

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


def _features(w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of the words at these places, one after another, and each word's first."""
    data = _LOWER[w.buf] + np.uint64(1)
    start, end = w.start[at], w.end[at]
    size = end - start
    found = [(gram_hashes(data, start, size), np.uint64(11))]
    for n in (1, 2, 3):
        short = np.minimum(n, size)
        found.append((gram_hashes(data, start, short), np.uint64(20 + n)))
        found.append((gram_hashes(data, end - short, short), np.uint64(30 + n)))
    whole = np.stack([(h * np.uint64(64) + kind) for h, kind in found], 1)
    parts = [(whole.ravel(), np.repeat(np.arange(len(at)), whole.shape[1]))]
    for n in (2, 3):
        count = np.maximum(size - n + 1, 0)
        row = np.repeat(np.arange(len(at)), count)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + start[row]
        parts.append((gram_hashes(data, place, n) * np.uint64(64) + np.uint64(40 + n), row))
    key = np.concatenate([k for k, _ in parts])
    row = np.concatenate([r for _, r in parts])
    order = np.argsort(row, kind="stable")
    bucket = ((key[order] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64) % BUCKETS
    return bucket, np.searchsorted(row[order], np.arange(len(at)))


def _runs(texts: pa.Array) -> Words:
    """The words, long ones (text without spaces) as runs of WORD_BYTES bytes; runs share two bytes, so no n-gram is lost."""
    w = Words(texts)
    step = WORD_BYTES - 2
    count = np.maximum(-(-(w.end - w.start - 2) // step), 1)
    if (count > 1).any():
        total = np.concatenate([[0], np.cumsum(count)])
        start = np.repeat(w.start, count) + step * (np.arange(total[-1]) - np.repeat(total[:-1], count))
        w.start, w.end, w.first = start, np.minimum(start + WORD_BYTES, np.repeat(w.end, count)), total[w.first]
    return w


def _distinct(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct word, and the number of the distinct word at each place."""
    _, at, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
    return at, inverse


class Field:
    def __init__(self, langs: list[str], weights: np.ndarray, trans: np.ndarray):
        self.langs, self.weights, self.trans = langs, weights, trans

    def _chain(self, scores: np.ndarray, first: np.ndarray) -> Chain:
        e = np.exp(np.clip(scores - scores.max(1)[:, None], -30, 0)) + 1e-12
        return Chain(e, first, np.full(len(self.langs), 1 / len(self.langs)), np.exp(self.trans))

    def scores(self, w: Words) -> np.ndarray:
        at, inverse = _distinct(w)
        bucket, first = _features(w, at)
        return np.add.reduceat(self.weights[bucket], first, axis=0)[inverse]

    def shares(self, w: Words) -> np.ndarray:
        """For each document, the words' probabilities of each language, summed."""
        out = np.zeros((len(w.first) - 1, len(self.langs)))
        if len(w):
            gamma, _ = self._chain(self.scores(w), w.first).posteriors()
            some = np.flatnonzero(np.diff(w.first))
            out[some] = np.add.reduceat(gamma, w.first[some], axis=0)
        return out

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], epochs: int = EPOCHS, batch: int = 24, rate: float = 0.15) -> Field:
        langs = sorted(set(labels))
        k = len(langs)
        self = cls(langs, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)))
        g2, t2 = np.full((BUCKETS, k), 1e-3, np.float32), np.full((k, k), 1e-3)
        gold = np.array([langs.index(x) for x in labels])
        rng = np.random.default_rng(11)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                w = _runs(pa.array([texts[j] for j in pick], pa.large_string()))
                if not len(w):
                    continue
                at, inverse = _distinct(w)
                bucket, first = _features(w, at)
                scores = np.add.reduceat(self.weights[bucket], first, axis=0)[inverse]
                gamma, pairs = self._chain(scores, w.first).posteriors(pairs=True)
                size = np.diff(w.first)
                label = np.repeat(gold[pick], size)
                miss = -gamma
                miss[np.arange(len(label)), label] += 1
                per_word = np.stack([np.bincount(inverse, miss[:, c], len(at)) for c in range(k)], 1)
                count = np.diff(np.append(first, len(bucket)))
                spread = np.repeat(per_word, count, axis=0)
                keys, place = np.unique(bucket, return_inverse=True)
                grad = np.stack([np.bincount(place, spread[:, c], len(keys)) for c in range(k)], 1) / len(label)
                g2[keys] += grad**2
                self.weights[keys] += rate * grad / np.sqrt(g2[keys])
                seen = np.zeros((k, k))
                np.add.at(seen, (gold[pick], gold[pick]), np.maximum(size - 1, 0))
                step = (seen - pairs) / len(label)
                t2 += step**2
                self.trans = np.clip(self.trans + rate * step / np.sqrt(t2), -8, 8)
        return self


def train(docs: DataFrame, sample: int = SAMPLE, run: int = RUN) -> Field | None:
    """docs: text, lang. None if there is no labelled row."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("text", "lang").alias("h"))
    runs = F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.char_length("text") - 1) / run), F.lit(0)).cast("int"))).alias("k")
    # the smallest hashes of distinct runs, at any size; texts are met afterwards, as many as the sample has runs
    keys = F.broadcast(smallest_hashes(usable.select("h", runs).distinct(), F.xxhash64("h", "k"), sample).select("h", "k"))
    met = usable.join(keys, "h").select("h", "k", "lang", F.substring("text", F.col("k") * run + 1, F.lit(run)).alias("text"))
    rows = met.groupBy("h", "k").agg(F.min(F.struct("lang", "text")).alias("row")).orderBy(F.xxhash64("h", "k"), "h", "k").select("row.text", "row.lang").toArrow()
    if not rows.num_rows:
        return None
    field = Field.fit(rows.column("text").to_pylist(), rows.column("lang").to_pylist())
    del rows
    give_back()
    return field


def predict(docs: DataFrame, field: Field | None) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score); docs: doc_id, held_out, text."""
    src = docs.select("doc_id", "held_out", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if field is None:
        return src.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(field)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = shared.value
        for whole in batches:
            for b in slices(whole, "text"):
                share = field.shares(_runs(b.column("text")))
                total = share.sum(1)
                there = b.column("letters").to_numpy(zero_copy_only=False) & (total > 0)
                best = share.argmax(1)
                score = np.where(there, share.max(1) / np.where(total > 0, total, 1), 0.0)
                names = [field.langs[k] if ok else "und" for k, ok in zip(best, there, strict=True)]
                yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(names), np.clip(score, 0, 1)], schema=schema)

    return src.mapInArrow(released(run), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, out: int = 2) -> DataFrame:
    """Train on the rows outside the held-out fold and label all rows."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == out, F.lit(False))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held.alias("held_out"))
    return predict(src, train(src.where(~F.col("held_out"))))
