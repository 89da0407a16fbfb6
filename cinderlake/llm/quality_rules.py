"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams, with DataFrame functions only.

A text's tokens are its runs of letters, of digits and of other visible characters. Each token, and each with the one before
it, falls into one of BUCKETS by its XXH64. Two multinomials over buckets are counted: one of all documents (the raw
corpus), one of trusted documents, smoothed towards the raw one, so that a bucket which neither knows much of weighs nothing.
A document's ratio is the sum over its n-grams of the log of the trusted over the raw probability, divided by their number.
It is held against one threshold: the ratio that all but a share of STRAY of the trusted documents reach (0 at most). For
this, trusted documents come in two halves by their ids' hashes, and each half is measured by the other's multinomial, as
their own n-grams would flatter them. Nothing is drawn by lot: a document's verdict depends on its text and the counts.

The raw counts and all verdicts cover all documents, the trusted multinomial and the threshold all trusted documents. Trusted
ids are put together by blocks of 64, a bit each, and joined with the documents as Spark sees fit.

A word is in a repeated window if the text has its window of words twice or more: windows of equal XXH64 whose words agree.

Edge cases: null text is the empty text, which fails the base rules; a null id is never trusted; rows that share a trusted id
are all trusted; repeated rows count and are judged each; without trusted documents all ratios and the threshold are 0, so
the base rules alone decide; texts of any length are taken whole (one row's work, linear but for a sort of the windows of
texts that repeat one); an empty table gives an empty one; input columns named like a result's are replaced, others stay as
they are whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import WORD, free, let, staged
from cinderlake.operators.numbering import numbered

TOKEN = r"\p{L}+|\p{N}+|[^\p{L}\p{N}\s]+"
SYMBOLS = r"[#*$%&|<>]"
BUCKETS = 1 << 14
#: Share of the trusted documents that may stay below the threshold.
STRAY = 0.002
#: Words of a window that may repeat; a text fails with fewer words than LEAST or more than REPEATED % of them repeated.
WINDOW, LEAST, REPEATED = 5, 10, 20

RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept")


def placed(hashes: Column) -> Column:
    """Windows' hashes and places in order, null unless some hash repeats, as in most texts none does."""
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(pairs))


def repeated_words(words: Column, pairs: Column, window: int = WINDOW) -> Column:
    """How many words are in windows that occur twice or more; pairs: of `placed`."""

    def same(a: Column, b: Column) -> Column:
        alike = a["h"] == b["h"]
        for k in range(window):
            alike = alike & (F.get(words, a["i"] + k) == F.get(words, b["i"] + k))
        return F.coalesce(alike, F.lit(False))

    # equal windows stand side by side
    again = F.filter(pairs, lambda p, k: same(p, F.get(pairs, k - 1)) | same(p, F.get(pairs, k + 1)))
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    reach = lambda s, k, all_: F.least(F.lit(window), F.coalesce(F.get(all_, k + 1) - s, F.lit(window)))
    covered = let(starts, lambda all_: F.aggregate(F.transform(all_, lambda s, k: reach(s, k, all_)), F.lit(0), lambda a, x: a + x))
    return F.coalesce(covered, F.lit(0)).cast("long")


def window_hashes(words: Column, window: int = WINDOW) -> Column:
    starts = F.sequence(F.lit(0), F.size(words) - window)
    return F.when(F.size(words) >= window, F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))).otherwise(F.array().cast("array<bigint>"))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def grams(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Buckets, a power of two of them, of the tokens and of each with the one before it, from the tokens' hashes."""
    bucket = lambda h: h.bitwiseAND(buckets - 1)
    # the first token has none before it, and XXH64 takes it alone once more
    pairs = F.transform(hashes, lambda h, i: bucket(F.xxhash64(F.get(hashes, i - 1), h)))
    return F.concat(F.transform(hashes, bucket), pairs)


def _tokens(text: Column) -> Column:
    """Hashes of a text's tokens."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))


def _blocks(trusted: DataFrame) -> DataFrame:
    """Rows (block, bits) of the trusted ids: 64 ids a block, and a bit for each that is trusted."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("id")).where("id is not null")
    # shifts take the lower six bits of a place
    return ids.groupBy(F.shiftright("id", 6).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(id & 63 AS INT))")).alias("bits"))


def _sided(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (text, half): by its id's hash for a trusted document, else null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.shiftright(F.col("doc_id").cast("long"), 6).alias("block"))
    trusted = F.expr("shiftright(bits, CAST(id & 63 AS INT)) & 1L") == 1
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int")
    return rows.join(blocks, "block", "left").select("text", F.when(trusted, half).alias("half"))


def _quantile(ratios: DataFrame, share: float) -> float | None:
    """The ratio below which a share of them lies, between its two neighbours in order; null of none. One range sort, of
    which two rows reach the driver."""
    ranked = numbered(ratios, "ratio")
    at = (ratios.count() - 1) * share
    if at < 0:
        return None
    low = math.floor(at)
    near = [r.ratio for r in ranked.where(F.col("number").isin(low + 1, low + 2)).select("ratio").orderBy("number").collect()]
    return near[0] + (near[-1] - near[0]) * (at - low)


def counted(docs: DataFrame, blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, raw, first, second): n-grams of all documents, and of the trusted ones of each half, for every bucket."""
    sided = _sided(docs, blocks).select("half", _tokens(F.col("text")).alias("tokens"))
    found = sided.select("half", F.explode(grams(F.col("tokens"), buckets)).alias("bucket")).groupBy("bucket", "half").count()
    side = lambda k: F.sum(F.when(F.col("half") == k, F.col("count")).otherwise(0))
    sums = found.groupBy("bucket").agg(F.sum("count").alias("raw"), side(0).alias("first"), side(1).alias("second"))
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(sums, "bucket", "left")
    return every.select("bucket", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("raw", "first", "second")])


def weights(counts: DataFrame, target: Column, buckets: int = BUCKETS) -> DataFrame:
    """One row with the array of the buckets' log ratios: the target's counts, smoothed by one n-gram a bucket dealt as the raw
    corpus has them, against the raw corpus."""
    raw_n, target_n = (counts.agg(F.sum(c)).scalar() for c in (F.col("raw"), target))
    raw = (F.col("raw") + 1.0) / (raw_n + float(buckets))
    ratio = F.log((target + buckets * raw) / (target_n + float(buckets)) / raw)
    told = counts.select(F.struct("bucket", F.when(target_n > 0, ratio).otherwise(0.0).alias("w")).alias("x"))
    # one row for each of the buckets
    return told.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["w"]).alias("w"))


def _mean(found: Column, weight) -> Column:
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, g: a + weight(g)) / F.size(found)).otherwise(F.lit(0.0))


def trusted_ratios(docs: DataFrame, blocks: DataFrame, counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows (ratio) of the trusted documents, each by the other half's multinomial."""
    one, two = (weights(counts, F.col(c), buckets).scalar() for c in ("first", "second"))
    own = _sided(docs, blocks).where("half is not null").select("half", _tokens(F.col("text")).alias("tokens"))
    found = own.select("half", grams(F.col("tokens"), buckets).alias("grams")).withColumn("w", F.when(F.col("half") == 0, two).otherwise(one))
    return found.select(_mean(F.col("grams"), lambda g: F.get("w", g.cast("int"))).alias("ratio"))


def judge(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, stray: float = STRAY) -> DataFrame:
    """docs (doc_id, text and others) with the base counts, base_failed, ratio and kept; trusted: doc_id."""
    own = [c for c in docs.columns if c.lower() not in RESULT]
    src = docs.select(*[F.col(f"`{c}`") for c in own])
    blocks = staged(_blocks(trusted), "trusted")
    counts = staged(counted(src, blocks, buckets), "grams")
    threshold = min(0.0, _quantile(staged(trusted_ratios(src, blocks, counts, buckets), "ratios"), stray) or 0.0)
    text, words, windows, pairs, tokens, found, w = (free(f"_{c}", src) for c in ("text", "words", "windows", "pairs", "tokens", "grams", "w"))
    df = src.withColumn(text, F.coalesce(F.col("text"), F.lit("")))
    # each step is used more than once by the next, so that Spark keeps it apart and takes it once
    df = df.withColumns({words: F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), tokens: _tokens(F.col(text))})
    df = df.withColumns({windows: window_hashes(F.col(words)), found: grams(F.col(tokens), buckets)}).drop(tokens)
    df = df.withColumn(pairs, placed(F.col(windows))).drop(windows)
    df = df.withColumn(w, weights(counts, F.col("first") + F.col("second"), buckets).scalar())
    n, again = F.size(words).cast("long"), repeated_words(F.col(words), F.col(pairs))
    base = df.select(
        *[F.col(f"`{c}`") for c in own], n.alias("n_words"), F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"), F.regexp_count(F.col(text), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        duplicate_lines(F.col(text)).alias("n_dup_lines"), again.alias("n_repeat_words"), _mean(F.col(found), lambda g: F.get(w, g.cast("int"))).alias("ratio"),
    )
    base = base.withColumn("base_failed", (F.col("n_words") < LEAST) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words")))
    return base.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= F.lit(threshold))).select(*[F.col(f"`{c}`") for c in own], *RESULT)
