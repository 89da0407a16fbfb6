"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt into tiles of some thousands by the population counts of their two halves. The
distance of two fingerprints is at least the sum of the differences of these counts, so a tile meets only tiles
whose counts differ by the radius or less; all other pairs of tiles are skipped, and no close pair is lost.
Within a pair of tiles, numpy compares everything by exclusive-or and bit counts. A pair of tiles reports a
spanning star of each group that it finds, not all pairs, so groups of thousands stay linear in size; links of
equal components come out of them by star joins.

Edge cases: null and empty texts have the fingerprint zero and link like any other; repeated rows share it; texts are
read whole, of any length; null ids never become a component's id unless all ids of the component are null; an
empty table gives an empty one; columns that are kept keep their names, whatever they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import Words, free, gram_hashes, mixed, released, slices, staged, with_row_id
from cinderlake.operators.graph import representatives, spanning

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints in a tile, about.
TILE = 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def simhashes(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text, as int64 bits."""
    w = Words(texts)
    n = len(w)
    size = w.end - w.start
    begin = np.cumsum(size + 1) - (size + 1)
    shift = np.repeat(w.start - begin, size)
    flat = np.arange(int(size.sum())) + np.repeat(np.arange(n), size)
    joined = np.full(int(size.sum()) + n, 32, np.uint8)
    joined[flat] = _LOWER[w.buf[flat + shift]]
    raw = joined.tobytes()
    words = np.diff(w.first)
    count = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    doc_first = np.cumsum(count) - count
    total = int(count.sum())
    left = np.repeat(w.first[:-1] - doc_first, count) + np.arange(total)
    right = np.minimum(left + shingle, np.repeat(w.first[1:], count)) - 1
    digest = xxhash.xxh64_digest
    ends = begin[right] + size[right] if n else right
    h = np.frombuffer(b"".join([digest(raw[a:b], seed) for a, b in zip((begin[left] if n else left).tolist(), ends.tolist(), strict=True)]), np.uint8)
    out = np.zeros(len(words), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        bits = np.unpackbits(h.reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, doc_first[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > count[some, None], axis=1).view(">u8").ravel()
    return out.view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, out: str = "fp") -> DataFrame:
    """docs (without a column of that name) and the fingerprint of its text as a long."""
    src = docs.select(*[c for c in docs.columns if c != out])
    names = src.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                own = [b.column(c) for c in names if c != "text"]
                yield pa.RecordBatch.from_arrays([*own, pa.array(simhashes(b.column("text"), shingle, seed))], names=[*[c for c in names if c != "text"], out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "text")
    return src.mapInArrow(released(run), f"{fields}, {out} long")


def _compare(radius: int, rows: int = 256):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def pair(x: np.ndarray, y: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        both = x if y is None else np.concatenate([x, y])
        other, shift = (x, 0) if y is None else (y, len(x))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for at in range(0, len(x), rows):
            i, j = np.nonzero(np.bitwise_count(x[at : at + rows, None] ^ other[None, :]) <= radius)
            if y is None:
                new = i + at < j
                i, j = i[new], j[new]
            found.append((i + at, j + shift))
            held += len(i)
            if held > 500_000:
                found = [spanning(*map(np.concatenate, zip(*found, strict=True)), len(both))]
                held = len(found[0][0])
        node, root = spanning(*map(np.concatenate, zip(*found, strict=True)), len(both))
        return both[node].view(np.int64), both[root].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[k].as_buffer(), np.uint64) if b.column(c)[k].is_valid else None for c in ("a", "b"))
                u, v = pair(x, y)
                if len(u):
                    yield pa.record_batch([u, v], schema=schema)

    return run


def _pack(tiles: DataFrame) -> DataFrame:
    """Tiles with their fingerprints as one binary."""
    schema = pa.schema([("lo", pa.int32()), ("hi", pa.int32()), ("sub", pa.int32()), ("fps", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("fps")
            packed = [lists[k].values.to_numpy().tobytes() for k in range(b.num_rows)]
            yield pa.record_batch([b.column("lo"), b.column("hi"), b.column("sub"), pa.array(packed, pa.binary())], schema=schema)

    return tiles.mapInArrow(run, "lo int, hi int, sub int, fps binary")


def close_links(classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of distinct fingerprints within the radius.

    classes: one row per distinct fingerprint, column fp."""
    keyed = classes.select("fp", F.expr("bit_count(fp & 4294967295L) AS lo"), F.expr("bit_count(shiftrightunsigned(fp, 32)) AS hi"))
    # 33 x 33 keys at most, whatever the input
    parts = keyed.groupBy("lo", "hi").agg(F.ceil(F.count("*") / tile).cast("long").alias("parts"))
    tiles = keyed.join(F.broadcast(parts), ["lo", "hi"]).groupBy("lo", "hi", F.expr("cast(pmod(xxhash64(fp, 7), parts) as int)").alias("sub")).agg(F.collect_list("fp").alias("fps"))
    tiles = staged(_pack(tiles), "tiles")
    near = [(a, b) for a in range(radius + 1) for b in range(-radius, radius + 1) if a + abs(b) <= radius and (a, b) >= (0, 0)]
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in near])
    left = tiles.select("lo", "hi", F.col("sub").alias("sub_a"), F.col("fps").alias("a"), F.explode(steps).alias("step"))
    left = left.select(F.expr("lo + step.a AS lo"), F.expr("hi + step.b AS hi"), "sub_a", "a", F.expr("step.a = 0 and step.b = 0 AS own"))
    # a tile goes to each tile that it meets, so pairs are dealt out by tiles, not by their few counts
    left = left.join(F.broadcast(parts), ["lo", "hi"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))).where("not own or sub_a <= sub")
    right = tiles.select("lo", "hi", "sub", F.col("fps").alias("b"))
    pairs = left.join(right.hint("merge"), ["lo", "hi", "sub"])
    same: Column = F.col("own") & (F.col("sub_a") == F.col("sub"))
    pairs = pairs.select("a", F.when(~same, F.col("b")).alias("b"))
    return pairs.mapInArrow(released(_compare(radius)), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, tile: int = TILE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, columns of `keep`, fp, root, component_id) for each row of docs.

    component_id is the smallest doc_id reachable; root is the component's smallest fingerprint."""
    own = staged(fingerprints(docs.select("doc_id", *keep, "text"), shingle, seed), "simhash")
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = representatives(close_links(classes, radius, tile))
    member = staged(classes.join(roots, classes.fp == roots.u, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "members")
    # a table of its own, so that the rows of one root can be split among tasks
    ids = staged(member.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    return own.join(member.join(ids, "root").select("fp", "root", "component_id"), "fp").select("doc_id", *keep, "fp", "root", "component_id")


def _kept(keyed: DataFrame, found: DataFrame, group: str, row: str) -> DataFrame:
    """Of each group, the row with the smallest doc_id. found: doc_id, the row's number and its group."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)
    first = found.groupBy(group).agg(F.min(order).alias("first")).select(F.col(f"first.{row}").alias(row))
    return keyed.join(first, row, "left_semi").drop(row)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without near copies: of each group, the row with the smallest doc_id stays."""
    row = free("_row", docs)
    keyed = with_row_id(docs, row)
    return _kept(keyed, near_duplicates(keyed.select("doc_id", "text", row), keep=(row,), **options), "root", row)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- near copies by similarity of word shingles ---------------------------------------------------------------------

#: Words of 64 bits in a wide fingerprint, and the radii of the first and of all: at a similarity of 0.8 a bit differs
#: with probability 0.15 (0.19 between sets of four and five shingles), so both lie nearly four deviations out or more.
WIDE = 4
FIRST_RADIUS = 24
WIDE_RADIUS = 76


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word shingles of each text, in order, and where each text's begin, with one entry more."""
    w = Words(texts)
    low = _LOWER[w.buf] + np.uint64(1)
    words = np.diff(w.first)
    count = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    doc = np.repeat(np.arange(len(words)), count)
    left = np.repeat(w.first[:-1] - (np.cumsum(count) - count), count) + np.arange(len(doc))
    size = np.minimum(shingle, np.repeat(w.first[1:], count) - left)
    own = gram_hashes(gram_hashes(low, w.start, w.end - w.start), left, size)
    order = np.lexsort((own, doc))
    own, doc = own[order], doc[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    return own[new], np.searchsorted(doc[new], np.arange(len(words) + 1))


def wide_fingerprints(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each text's set of shingles, the size of the set, and WIDE words of SimHash over it."""
    own, first = shingle_sets(texts, shingle)
    size = np.diff(first)
    some = np.flatnonzero(size)
    sets, bits = np.zeros(len(size), np.uint64), np.zeros((len(size), WIDE), np.uint64)
    if len(some):
        sets[some] = np.add.reduceat(mixed(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first[some])
        for k in range(WIDE):
            flat = np.unpackbits(mixed(own + np.uint64(k + 1) * np.uint64(0xD1342543DE82EF95)).view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(flat, first[some], axis=0, dtype=np.int32)
            bits[some, k] = np.packbits(2 * ones > size[some, None], axis=1).view(np.uint64).ravel()
    return sets.view(np.int64), size.astype(np.int64), bits


def _compare_wide(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Stars (u, v) over the sets of two tiles whose wide fingerprints are within both radii."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for b in batches:
        for k in range(b.num_rows):
            x, y = (np.frombuffer(b.column(c)[k].as_buffer(), np.uint64).reshape(-1, 1 + WIDE) if b.column(c)[k].is_valid else None for c in ("a", "b"))
            both = x if y is None else np.concatenate([x, y])
            other, shift = (x, 0) if y is None else (y, len(x))
            right = np.ascontiguousarray(other[:, 1])
            found: list[tuple[np.ndarray, np.ndarray]] = []
            held = 0
            for at in range(0, len(x), rows):
                i, j = np.nonzero(np.bitwise_count(x[at : at + rows, 1, None] ^ right[None, :]) <= FIRST_RADIUS)
                i += at
                if y is None:
                    i, j = i[i < j], j[i < j]
                near = np.bitwise_count(x[i, 1:] ^ other[j, 1:]).sum(1) <= WIDE_RADIUS
                found.append((i[near], j[near] + shift))
                held += int(near.sum())
                if held > 500_000:
                    found = [spanning(*map(np.concatenate, zip(*found, strict=True)), len(both))]
                    held = len(found[0][0])
            node, root = spanning(*map(np.concatenate, zip(*found, strict=True)), len(both))
            if len(node):
                yield pa.record_batch([both[node, 0].view(np.int64), both[root, 0].view(np.int64)], schema=schema)


def wide_links(classes: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """Links (u, v) whose components hold all pairs of sets that may have the similarity `least`.

    classes: set_id, size, bits. Similar sets have similar sizes, so a tile meets tiles of its own and the next band of sizes only."""
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1 / least)) + 1e-9).cast("int")
    keyed = classes.select("set_id", "bits", band.alias("band"))
    # as many bands as the logarithm of the longest text, whatever the input
    parts = keyed.groupBy("band").agg(F.ceil(F.count("*") / tile).cast("long").alias("parts"))
    keyed = keyed.join(F.broadcast(parts), "band").select("set_id", "bits", "band", F.expr("cast(pmod(xxhash64(set_id, 7), parts) as int)").alias("sub"))

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        x = np.empty((t.num_rows, 1 + WIDE), np.uint64)
        x[:, 0] = t.column("set_id").to_numpy().view(np.uint64)
        x[:, 1:] = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(-1, WIDE)
        return pa.table({"band": pa.array([key[0].as_py()], pa.int32()), "sub": pa.array([key[1].as_py()], pa.int32()), "sets": pa.array([x.tobytes()], pa.binary())})

    tiles = staged(keyed.groupBy("band", "sub").applyInArrow(pack, "band int, sub int, sets binary"), "tiles")
    left = tiles.select(F.col("sub").alias("sub_a"), F.col("sets").alias("a"), F.explode(F.array(F.struct(F.lit(0).alias("step"), F.col("band").alias("band")), F.struct(F.lit(1).alias("step"), (F.col("band") + 1).alias("band")))).alias("to"))
    left = left.select("sub_a", "a", "to.step", "to.band").join(F.broadcast(parts), "band")
    # a tile goes to each tile that it meets, so pairs are dealt out by tiles, not by bands
    left = left.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))).where("step = 1 or sub_a <= sub")
    pairs = left.join(tiles.select("band", "sub", F.col("sets").alias("b")).hint("merge"), ["band", "sub"])
    pairs = pairs.select("a", F.expr("CASE WHEN step = 1 OR sub_a < sub THEN b END AS b"))
    return pairs.mapInArrow(released(_compare_wide), "u long, v long")


#: Shingles of the texts that one task compares exactly, about: 8 bytes each, and some copies of that.
TOGETHER = 500_000


def _linked(own: np.ndarray, first: np.ndarray, size: np.ndarray, at: int, others: np.ndarray, least: float) -> np.ndarray:
    """Of the sets `others`, those whose similarity to the set `at` is `least` or more."""
    mine = own[first[at] : first[at + 1]]
    rest = np.repeat(others, size[others])
    place = np.repeat(first[others] - (np.cumsum(size[others]) - size[others]), size[others]) + np.arange(len(rest))
    seen = own[place]
    hit = np.minimum(np.searchsorted(mine, seen), len(mine) - 1)
    common = np.bincount(rest[mine[hit] == seen], minlength=len(size))[others]
    return others[common >= least * (size[others] + size[at] - common) - 1e-9]


def _confirm(least: float, shingle: int):
    """Within a group of candidates, stars of the pairs whose similarity is `least` or more, exactly: each set is compared
    with those that no star holds yet."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ids, at = np.unique(t.column("set_id").to_numpy(), return_index=True)
        own, first = shingle_sets(t.column("text").combine_chunks().take(pa.array(at)), shingle)
        size = np.diff(first)
        root = np.full(len(ids), -1)
        for start in range(len(ids)):
            if root[start] >= 0:
                continue
            root[start] = start
            reached = [start]
            while reached:
                left = np.flatnonzero(root < 0)
                if not len(left):
                    break
                new = _linked(own, first, size, reached.pop(), left, least)
                root[new] = start
                reached += new.tolist()
        return pa.table({"set_id": pa.array(ids, pa.int64()), "root": pa.array(ids[root], pa.int64())})

    return run


def _cross(least: float, shingle: int):
    """Links between the sets of two sides of a group."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        side, block = t.column("outside").to_numpy(zero_copy_only=False), t.column("block").to_numpy()
        ids = t.column("set_id").to_numpy()
        own, first = shingle_sets(t.column("text").combine_chunks(), shingle)
        size = np.diff(first)
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.flatnonzero(side):
            new = _linked(own, first, size, k, np.flatnonzero(~side & (block != block[k])), least)
            u.append(np.full(len(new), ids[k]))
            v.append(ids[new])
        return pa.table({"set_id": pa.array(np.concatenate(u), pa.int64()), "root": pa.array(np.concatenate(v), pa.int64())})

    return run


def _chunked(members: DataFrame, together: int) -> DataFrame:
    """members (loose, set_id, size) with the number of chunks of their group and their own chunk."""
    sizes = staged(members.groupBy("loose").agg(F.ceil(F.sum("size") / together).cast("int").alias("chunks")), "chunks")
    return members.join(sizes, "loose").withColumn("chunk", F.pmod(F.xxhash64("set_id", F.lit(3)), F.col("chunks")).cast("int"))


def exact_groups(members: DataFrame, texts: DataFrame, least: float, shingle: int, together: int = TOGETHER) -> DataFrame:
    """Rows (set_id, root): components of the pairs of one group whose similarity is `least` or more.

    members: loose, set_id, size; texts: set_id, text. A group that fits in a task is compared there. A larger one is dealt
    to chunks; a star's centre stands for its chunk in further rounds, until one chunk holds all centres or they
    don't get fewer. Then centres of one group that still aren't linked are blocks, and every text outside of the largest
    block is compared with all texts of other blocks, chunk by chunk. So no pair is lost, and no task takes a whole group."""
    schema = "set_id long, root long"
    dealt = staged(_chunked(members, together), "dealt")
    links = [staged(texts.join(dealt, "set_id").groupBy("loose", "chunk").applyInArrow(_confirm(least, shingle), schema), "stars")]
    big = dealt.where("chunks > 1").select("loose", "set_id", "size")
    now, n = big, big.count()
    while n:
        # centres, some of which are of groups of one chunk: these are left out by the join
        centres = staged(_chunked(now.join(links[-1].where("set_id = root").select("set_id"), "set_id"), together), "centres")
        left, chunks = centres.agg(F.count("*"), F.max("chunks")).first()
        links.append(staged(texts.join(centres, "set_id").groupBy("loose", "chunk").applyInArrow(_confirm(least, shingle), schema), "stars"))
        if left >= n or chunks <= 1:
            break
        now, n = centres.select("loose", "set_id", "size"), left
    stars = links[0]
    for further in links[1:]:
        stars = stars.unionByName(further)
    edges = stars.where("set_id != root").select(F.col("set_id").alias("u"), F.col("root").alias("v"))
    roots = representatives(edges)
    if n or len(links) > 1:
        blocks = big.join(roots, F.col("set_id") == F.col("u"), "left").select("loose", "set_id", "size", F.coalesce("root", "set_id").alias("block"))
        counts = staged(blocks.groupBy("loose", "block").agg(F.sum("size").alias("words")), "blocks")
        main = staged(counts.groupBy("loose").agg(F.max(F.struct("words", "block")).alias("main"), F.count("*").alias("blocks")).where("blocks > 1").select("loose", "main.block"), "main")
        split = blocks.join(main.withColumnRenamed("block", "main"), "loose")
        outside = split.withColumn("outside", F.col("block") != F.col("main")).select("loose", "set_id", "size", "block", "outside")
        inner = _chunked(outside.drop("block", "outside"), together).join(outside.select("set_id", "block", "outside"), "set_id")
        each = inner.where("outside").select("set_id", "loose", "block", F.lit(True).alias("outside"), F.col("chunk").alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        held = inner.select("set_id", "loose", "block", F.lit(False).alias("outside"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("own"), "chunk")
        # only chunks that have texts outside of the main block
        held = held.join(each.select("loose", "own").distinct(), ["loose", "own"], "left_semi")
        met = texts.join(each.unionByName(held, allowMissingColumns=True), "set_id").groupBy("loose", "own", "chunk")
        crossed = staged(met.applyInArrow(_cross(least, shingle), schema), "crossed")
        roots = representatives(edges.unionByName(crossed.select(F.col("set_id").alias("u"), F.col("root").alias("v"))))
    return roots.select(F.col("u").alias("set_id"), "root")


def one_of_similar(docs: DataFrame, least: float = 0.8, shingle: int = 5, tile: int = TILE, together: int = TOGETHER) -> DataFrame:
    """docs without near copies: of each component of texts whose sets of word shingles have the Jaccard similarity
    `least` or more, the row with the smallest doc_id stays. Texts without words are copies of each other.

    Wide fingerprints propose groups, by the tiled comparison; sets of shingles confirm each pair."""
    row = free("_row", docs)
    keyed = with_row_id(docs, row)
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("set_id", pa.int64()), ("size", pa.int64()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                sets, size, bits = wide_fingerprints(b.column("text"), shingle)
                yield pa.record_batch([*(b.column(c) for c in ("doc_id", "row")), sets, size, pa.array([x.tobytes() for x in bits], pa.binary())], schema=schema)

    src = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"), "text")
    own = src.mapInArrow(released(run), "doc_id long, row long, set_id long, size long, bits binary")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    classes = staged(own.groupBy("set_id", "size", "bits").agg(first), "sets")
    loose = representatives(wide_links(classes.where("size > 0"), least, tile))
    members = staged(classes.join(loose, classes.set_id == loose.u).select("set_id", "size", F.col("root").alias("loose"), "first.row"), "loose")
    texts = staged(src.select("row", "text").join(members.select("row", "set_id"), "row").select("set_id", "text"), "texts")
    exact = exact_groups(members.select("loose", "set_id", "size"), texts, least, shingle, together)
    member = classes.select("set_id", "first").join(exact, "set_id", "left").select(F.coalesce("root", "set_id").alias("root"), "first")
    chosen = member.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return keyed.join(chosen, row, "left_semi").select(*docs.columns)
