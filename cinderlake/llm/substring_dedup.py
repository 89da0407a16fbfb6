"""Exact removal of repeated word windows with prefix-partitioned suffix trees.

A suffix matters only if the first `window` words of it start somewhere else too. Suffixes are dealt out by
prefixes of variable length: the prefix of a suffix runs to the end of the rarest-looking `gram` words of its
window (the gram with the smallest hash, leftmost first), so equal windows always share the prefix, and about one
position in twelve names the group of all suffixes around it (an anchor). A first pass counts anchors and keeps
those that occur twice: an exact filter, since a repeated window has a repeated anchor. Equal surroundings of an
anchor collapse into one counted context before any tree is built, so thousands of copies weigh as one. A group
of contexts that fits in memory gets a suffix tree, grown level by level; its internal nodes at depth `window` are
the repeats. A group above `group_limit` contexts is split by longer prefixes, up to the whole window, whose node
is then just a count.

Words are told by hashes modulo the prime 2**61 - 1 over their bytes, and windows by those of their words, beside the
gram that they share: no strings of a known form agree, as they do modulo powers of two, and chance leaves some 122 bits.

Edge cases: null text has no words; repeated rows count as separate documents; a text of fewer than `window`
words keeps all; texts and words of any length are read whole; null ids are kept; an empty table gives an empty one; an
input column named like a result column is replaced, others stay as they are whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import Words, free, gram_hashes, released, row_keys, slices, staged

WINDOW = 35
#: Words of a gram; windows of 35 words then have 24 grams to choose the anchor from.
GRAM = 12
#: Contexts of one anchor that one tree may hold: some 100 MB of a worker while it grows.
GROUP_LIMIT = 5_000

_ANCHOR = "k1 long, k2 long, gram long, ctx long, pos int, lo int, cnt int"


def _argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest of h[i : i + width] for each i, by doubling."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, span = np.arange(len(h)), 1
    while span * 2 <= width:
        a, b = at[: len(at) - span], at[span:]
        at = np.where(h[a] <= h[b], a, b)
        span *= 2
    a, b = at[:n], at[width - span : width - span + n]
    return np.where(h[a] <= h[b], a, b)


def _windows(first: np.ndarray, n: int, window: int) -> np.ndarray:
    """Whether the window that starts at each word ends within the same document."""
    ok = np.ones(n, bool)
    doc_end = np.repeat(first[1:], np.diff(first))
    ok &= np.arange(n) + window <= doc_end
    return ok


def _find_anchors(window: int, gram: int):
    width = window - gram + 1
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("gram", pa.int64()), ("ctx", pa.int64()), ("pos", pa.int32()), ("lo", pa.int32()), ("cnt", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                w = Words(b.column("text"))
                n = len(w)
                if n < window:
                    continue
                words = w.hashes()
                grams = gram_hashes(words, np.arange(n - gram + 1), gram)
                best = _argmin(grams, width)
                starts = np.flatnonzero(_windows(w.first, n, window)[: len(best)])
                if not len(starts):
                    continue
                best = best[starts]
                new = np.concatenate([[True], best[1:] != best[:-1]])
                at = np.flatnonzero(new)
                anchor, lo = best[at], starts[at]
                cnt = np.diff(np.append(at, len(best)))
                ctx = gram_hashes(words, lo, cnt + window - 1) ^ (anchor - lo).astype(np.uint64)
                doc = np.searchsorted(w.first, anchor, side="right") - 1
                k1, k2 = (b.column(c).to_numpy() for c in ("k1", "k2"))
                yield pa.record_batch([k1[doc], k2[doc], grams[anchor].view(np.int64), ctx.view(np.int64), (anchor - w.first[doc]).astype(np.int32), (anchor - lo).astype(np.int32), cnt.astype(np.int32)], schema=schema)

    return run


def _cut_contexts(window: int):
    """The word hashes of the contexts that are listed beside each text."""
    schema = pa.schema([("gram", pa.int64()), ("ctx", pa.int64()), ("n", pa.int64()), ("lo", pa.int32()), ("cnt", pa.int32()), ("nctx", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                w = Words(b.column("text"))
                words = w.hashes()
                reps = b.column("reps")
                flat = reps.flatten()
                doc = np.repeat(np.arange(b.num_rows), reps.value_lengths().to_numpy())
                got = {c: flat.field(c).to_numpy() for c in ("gram", "ctx", "n", "pos", "lo", "cnt", "nctx")}
                at = w.first[doc] + got["pos"] - got["lo"]
                cut = [words[a : a + c].tobytes() for a, c in zip(at, got["cnt"] + window - 1, strict=True)]
                yield pa.record_batch([got["gram"], got["ctx"], got["n"], got["lo"], got["cnt"], got["nctx"], pa.array(cut, pa.binary())], schema=schema)

    return run


def suffix_tree_repeats(group: np.ndarray, words: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Grow the suffix trees of many groups level by level; true for suffixes below an internal node at depth `window`.

    group: the prefix group of each suffix; words: word hashes, one row per suffix, `window` columns; n: how often
    the suffix occurs. Nodes with one leaf are dropped as soon as they appear."""
    node, alive = group, np.arange(len(group))
    for depth in range(window + 1):
        if depth:
            order = np.lexsort((words[alive, depth - 1], node))
            a, b = node[order], words[alive[order], depth - 1]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            node = np.empty(len(order), np.int64)
            node[order] = np.cumsum(new) - 1
        else:
            node = np.unique(group, return_inverse=True)[1]
        leaves = np.bincount(node, weights=n[alive]) if len(node) else np.zeros(0)
        more = leaves[node] > 1 if len(node) else np.zeros(0, bool)
        alive, node = alive[more], node[more]
        if not len(alive):
            break
    out = np.zeros(len(group), bool)
    out[alive] = True
    return out


def _grow_trees(window: int, at_once: int = 20_000):
    """Batches come sorted by gram; a tree group never spans two steps."""
    schema = pa.schema([("gram", pa.int64()), ("ctx", pa.int64()), ("mask", pa.int64())])

    def solve(t: pa.Table) -> pa.RecordBatch:
        cnt, lo, n = (t.column(c).to_numpy() for c in ("cnt", "lo", "n"))
        gram = t.column("gram").to_numpy()
        raw = t.column("words").combine_chunks()
        flat = np.frombuffer(b"".join(raw.to_pylist()), np.uint64)
        begin = np.concatenate([[0], np.cumsum(cnt + window - 1)])[:-1]
        row = np.repeat(np.arange(len(cnt)), cnt)
        step = np.arange(len(row)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
        key = np.stack([np.unique(gram, return_inverse=True)[1][row], lo[row] - step], 1)
        group = key[:, 0] * 4096 + key[:, 1]
        hit = np.zeros(len(row), bool)
        bounds = np.flatnonzero(np.concatenate([[True], key[1:, 0] != key[:-1, 0]]))
        bounds = np.append(bounds, len(row))
        i = 0
        while i < len(bounds) - 1:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + 100_000, side="right")) - 1)
            a, b = bounds[i], bounds[j]
            pick = begin[row[a:b], None] + step[a:b, None] + np.arange(window)
            hit[a:b] = suffix_tree_repeats(group[a:b], flat[pick], n[row[a:b]], window)
            i = j
        mask = np.zeros(len(cnt), np.int64)
        np.bitwise_or.at(mask, row, np.where(hit, np.int64(1) << step.astype(np.int64), 0))
        return pa.record_batch([t.column("gram").combine_chunks(), t.column("ctx").combine_chunks(), mask], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= at_once:
                t = pa.Table.from_batches(held)
                g = t.column("gram").to_numpy()
                cut = int(np.searchsorted(g, g[-1], side="left")) if g[0] <= g[-1] else 0
                if cut:
                    yield solve(t.slice(0, cut))
                    held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if rows:
            yield solve(pa.Table.from_batches(held))

    return run


def _split_windows(window: int):
    """For groups too large for a tree: each suffix by its longest prefix, the whole window."""
    schema = pa.schema([("gram", pa.int64()), ("ctx", pa.int64()), ("step", pa.int32()), ("n", pa.int64()), ("prefix", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cnt, n = b.column("cnt").to_numpy(), b.column("n").to_numpy()
            if not len(cnt):
                continue
            flat = np.frombuffer(b"".join(b.column("words").to_pylist()), np.uint64)
            begin = np.concatenate([[0], np.cumsum(cnt + window - 1)])[:-1]
            row = np.repeat(np.arange(len(cnt)), cnt)
            step = np.arange(len(row)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
            prefix = gram_hashes(flat, begin[row] + step, window)
            yield pa.record_batch([b.column("gram").to_numpy()[row], b.column("ctx").to_numpy()[row], step.astype(np.int32), n[row], prefix.view(np.int64)], schema=schema)

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Rows (k1, k2, hits): for each document with repeats, the anchors with the bits of their repeated windows.

    docs: doc_id, text and the keys k1, k2 of `row_keys`."""
    src = docs.select("doc_id", "text", "k1", "k2")
    anchors = src.mapInArrow(released(_find_anchors(window, gram)), _ANCHOR)
    # joins are with tables of their own, so that an anchor that very many texts share can be split among tasks
    twice = staged(anchors.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"), "grams")
    found = staged(anchors.join(twice, "gram").select("gram", "ctx", "k1", "k2", "pos", "lo", "cnt"), "anchors")
    contexts = found.groupBy("gram", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos", "lo", "cnt")).alias("rep"))
    contexts = staged(contexts, "contexts")
    sizes = staged(contexts.groupBy("gram").agg(F.count("*").alias("nctx")), "sizes")
    contexts = contexts.join(sizes, "gram")
    same = contexts.where("nctx = 1 and n > 1").select("gram", "ctx", F.expr("shiftleft(1L, rep.cnt) - 1 AS mask"))
    listed = (
        contexts.where("nctx > 1")
        .select("rep.k1", "rep.k2", F.struct("gram", "ctx", "n", "rep.pos", "rep.lo", "rep.cnt", "nctx").alias("rep"))
        .groupBy("k1", "k2")
        .agg(F.collect_list("rep").alias("reps"))
    )
    one_each = src.join(listed, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    cut = staged(one_each.mapInArrow(released(_cut_contexts(window)), "gram long, ctx long, n long, lo int, cnt int, nctx long, words binary"), "cut")
    small = cut.where(F.col("nctx") <= group_limit).repartition("gram").sortWithinPartitions("gram")
    trees = small.mapInArrow(released(_grow_trees(window)), "gram long, ctx long, mask long")
    split = cut.where(F.col("nctx") > group_limit).mapInArrow(_split_windows(window), "gram long, ctx long, step int, n long, prefix long")
    again = staged(split.groupBy("gram", "prefix").agg(F.sum("n").alias("c")).where("c > 1").select("gram", "prefix"), "prefixes")
    large = split.join(again, ["gram", "prefix"]).groupBy("gram", "ctx").agg(F.expr("bit_or(shiftleft(1L, step))").alias("mask"))
    masks = staged(same.unionByName(trees).unionByName(large).where("mask != 0"), "masks")
    return (
        found.join(masks, ["gram", "ctx"])
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct((F.col("pos") - F.col("lo")).alias("at"), "mask")).alias("hits"))
    )


def _apply_removal(schema: pa.Schema, window: int, keep_text: bool, hits_at: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                w = Words(b.column("text"))
                hits = b.column(hits_at)
                flat = hits.flatten()
                doc = np.repeat(np.arange(b.num_rows), np.nan_to_num(hits.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                at, mask = w.first[doc] + flat.field("at").to_numpy(), flat.field("mask").to_numpy()
                edge = np.zeros(len(w) + 1, np.int64)
                for bit in range(int(mask.max(initial=0)).bit_length()):
                    s = at[(mask >> bit) & 1 > 0] + bit
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed = np.concatenate([[0], np.cumsum(gone)])
                n_removed = removed[w.first[1:]] - removed[w.first[:-1]]
                raw, kept = w.buf.tobytes(), []
                for i in range(b.num_rows):
                    a, z = w.first[i], w.first[i + 1]
                    own = np.arange(a, z)[~gone[a:z]]
                    kept.append(b" ".join([raw[s:e] for s, e in zip(w.start[own].tolist(), w.end[own].tolist(), strict=True)]))
                out = {"n_words": np.diff(w.first), "n_removed": n_removed}
                if keep_text:
                    out["kept"] = pa.array(kept, pa.binary()).cast(pa.string())
                else:
                    out["kept_sha256"] = pa.array([hashlib.sha256(k).hexdigest() for k in kept])
                yield pa.record_batch([out[f.name] if f.name in out else b.column(f.name) for f in schema], schema=schema)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_limit: int = GROUP_LIMIT, keep_text: bool = True) -> DataFrame:
    """docs with n_words, n_removed and kept, the words that no repeated window covers, joined by one space.

    With keep_text=False, kept_sha256 takes the place of kept. Windows are judged on the input."""
    from pyspark.sql.pandas.types import to_arrow_schema

    result = {"n_words", "n_removed", "kept" if keep_text else "kept_sha256"}
    src = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in result])
    k1, k2 = row_keys()
    keyed = src.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))
    n1, n2, at = free("k1", src), free("k2", src), free("hits", src)
    hits = staged(repeated_windows(keyed, window, gram, group_limit).toDF(n1, n2, at), "hits")
    joined = src.withColumns({n1: k1, n2: k2}).join(hits, [n1, n2], "left").drop(n1, n2)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name != at and (keep_text or f.name != "text")]
    ddl = ", ".join([*fields, "n_words long", "n_removed long", "kept string" if keep_text else "kept_sha256 string"])
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], ddl).schema)
    return joined.mapInArrow(released(_apply_removal(arrow, window, keep_text, at)), ddl)
