"""Maximum inner product search with score-aware anisotropic quantisation.

A vector is cut into pairs of components, and each pair is told by one of 16 centres: four bits. Codes are chosen
to keep the score, not the vector: the residual's part that is parallel to the vector counts `eta` times as much
as the rest, since only that part moves large inner products. The centres are fitted to this loss on a bounded
sample. Every vector is coded, and its distance from its code's centres kept. Queries come in blocks against blocks of codes;
each pair of blocks is scanned with tables of a query's products with the centres (two codes to a byte, so one look-up adds
two of them). The best codes of a block are scored exactly, on the original vectors, which tells what score the block's
nearest reach at least. By the inequality of Cauchy and Schwarz a code errs by no more than its distance times the query's
length: every vector that may still reach that score is scored exactly, too, so that none of the nearest is missed, whatever
the vectors are like. Vectors that codes tell badly cost time (at worst all pairs are scored), not results.

Equal vectors tie, so of each distinct vector only the rows with the smallest ids are scanned, one more than
are asked for; no other row of it can be among the nearest.

Edge cases: null or zero vectors, vectors with null or non-finite components and rows with a null id take no part; rows
that share an id are rows of their own, and so are equal rows: each of them may ask and may be found, and only the row
that asks is not its own neighbour; a vector meets vectors of its own length only; ties go to the smaller id; an empty
table gives an empty one; input columns of other names are left out, and none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.llm.common import released, smallest_hashes, staged

CENTRES = 16
#: Vectors that the centres are fitted on, at most.
SAMPLE = 20_000
#: Weight of the parallel residual over the rest.
ETA = 4.0
#: Best codes of each query that are scored first, as many of them in a block as are likely to lie in it.
RERANK = 400
#: Rows of a block of codes; queries that have their tables at once, and how many times as many may be in a block of queries;
#: pairs of blocks that keep the tasks busy.
BLOCK = 1 << 14
QUERY_BLOCK = 512
ABREAST = 16
PAIRS = 64
#: Vectors that are coded at once: some 20 MB of differences from all centres.
STEP = 2_048


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows (row, vec_id, v): a number for each row, and its vector as it is."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


class Codec:
    """Centres and codes of an even number of components; odd ones get a zero at the end."""

    def __init__(self, centres: np.ndarray, eta: float):
        self.centres, self.eta = centres, eta

    @property
    def scale(self) -> float:
        return float(np.abs(self.centres).max()) or 1.0

    def decoded(self, code: np.ndarray) -> np.ndarray:
        """The centres that the codes name: row, part, 2."""
        return self.centres[np.arange(code.shape[1]), code]

    @staticmethod
    def parts(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        if x.shape[1] % 4:
            x = np.pad(x, ((0, 0), (0, -x.shape[1] % 4)))
        return x.reshape(len(x), -1, 2)

    def code(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on |r|^2 + (eta - 1) (r.u)^2, u the vector's direction; STEP vectors at a time."""
        steps = [self._code(x[k : k + STEP], sweeps) for k in range(0, len(x), STEP)]
        return np.concatenate(steps) if steps else self._code(x, sweeps)

    def _code(self, x: np.ndarray, sweeps: int) -> np.ndarray:
        p = self.parts(x)
        u = p / np.linalg.norm(p.reshape(len(p), -1), axis=1)[:, None, None]
        m = p.shape[1]
        diff = p[:, :, None, :] - self.centres[None]  # row, part, centre, 2
        square = (diff**2).sum(-1)
        along = (diff * u[:, :, None, :]).sum(-1)
        code = square.argmin(-1)
        take = lambda a: np.take_along_axis(a, code[:, :, None], 2)[:, :, 0]
        total = take(along).sum(1)
        for _ in range(sweeps):
            for k in range(m):
                rest = total - np.take_along_axis(along[:, k], code[:, k, None], 1)[:, 0]
                cost = square[:, k] + (self.eta - 1) * (along[:, k] + rest[:, None]) ** 2
                code[:, k] = cost.argmin(1)
                total = rest + np.take_along_axis(along[:, k], code[:, k, None], 1)[:, 0]
        return code.astype(np.uint8)

    @classmethod
    def fit(cls, x: np.ndarray, eta: float, rounds: int = 6) -> Codec:
        p = cls.parts(x)
        n, m, _ = p.shape
        rng = np.random.default_rng(7)
        centres = np.stack([p[rng.choice(n, CENTRES, replace=n < CENTRES), k] for k in range(m)])
        out = cls(centres, 1.0)
        u = p / np.linalg.norm(p.reshape(n, -1), axis=1)[:, None, None]
        for r in range(rounds):
            out.eta = 1.0 if r < rounds // 2 else eta
            code = out.code(x, sweeps=1 if out.eta > 1 else 0)
            for k in range(m):
                rest = ((p - centres[np.arange(m), code]) * u).sum((1, 2)) - ((p[:, k] - centres[k, code[:, k]]) * u[:, k]).sum(1)
                for c in range(CENTRES):
                    own = code[:, k] == c
                    if not own.any():
                        centres[k, c] = p[rng.integers(n), k]
                        continue
                    uk, pk = u[own, k], p[own, k]
                    # least squares: sum of (I + (eta-1) uu') z = sum of (I + (eta-1) uu') p + (eta-1) rest u
                    w = out.eta - 1
                    a = own.sum() * np.eye(2) + w * uk.T @ uk
                    b = pk.sum(0) + w * (uk * ((pk * uk).sum(1) + rest[own])[:, None]).sum(0)
                    centres[k, c] = np.linalg.solve(a, b)
        out.eta = eta
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and byte of code, the sums of the two centres' products, divided by the scale: query, byte, 256."""
        t = np.einsum("qmd,mcd->qmc", self.parts(q), self.centres / self.scale).astype(np.float32)
        return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, CENTRES * CENTRES)


def _pack(code: np.ndarray) -> np.ndarray:
    return (code[:, 0::2] << 4 | code[:, 1::2]).astype(np.uint8)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _coder(codec: Codec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                b = whole.slice(at, STEP)
                x = _matrix(b.column("v"))
                code = codec.code(x)
                with np.errstate(all="ignore"):
                    gap = np.linalg.norm((codec.parts(x) - codec.decoded(code)).reshape(len(x), -1), axis=1)
                yield pa.record_batch([*(b.column(c) for c in ("row", "vec_id", "v")), pa.array([c.tobytes() for c in _pack(code)], pa.binary()), gap], names=["row", "vec_id", "v", "code", "gap"])

    return run


def _products(columns: np.ndarray, pick: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up in the components' order, as SQL would."""
    return np.add.accumulate(columns[:, pick] * q[:, None], axis=0)[-1] + 0.0


def _scan(codec: Codec, best: int, nearest: int, step: int):
    """The `nearest` vectors of a block to each query. What the best codes score exactly is a limit that a vector has to reach,
    and no vector scores more than its code by over its distance from the code's centres times the query's length."""
    schema = pa.schema([("query", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def top(score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> np.ndarray:
        if len(score) > nearest:
            fine = np.flatnonzero(~(score < -np.partition(-score, nearest - 1)[nearest - 1]))
        else:
            fine = np.arange(len(score))
        return fine[np.lexsort((row[fine], vec_id[fine], -score[fine]))[:nearest]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for r in range(whole.num_rows):
                b = whole.slice(r, 1)
                asked = b.column("queries").flatten()
                query, vectors = asked.field("row").to_numpy(), _matrix(asked.field("v")).astype(np.float64)
                d = b.column("codes").flatten()
                rows = d.field("row").to_numpy()
                order = np.argsort(rows)
                rows, vec_id, gap = rows[order], d.field("vec_id").to_numpy()[order], d.field("gap").to_numpy()[order]
                code = np.frombuffer(b"".join(d.field("code").to_pylist()), np.uint8).reshape(len(rows), -1)[order].T.copy()
                columns = _matrix(d.field("v"))[order].T.astype(np.float64, order="C")
                with np.errstate(all="ignore"):
                    # tables in single precision: their rounding comes on top
                    margin = gap * (1 + 1e-9) + (len(code) + 4) * 1.2e-7 * (np.linalg.norm(columns, axis=0) + gap) + 1e-37 * codec.scale
                    for at in range(0, len(query), step):
                        size = np.linalg.norm(vectors[at : at + step], axis=1)
                        tables = codec.tables(vectors[at : at + step] / size[:, None])
                        for k, q in enumerate(vectors[at : at + step]):
                            near = np.zeros(len(rows), np.float32)
                            for table, column in zip(tables[k], code, strict=True):
                                near += table[column]
                            others = rows != query[at + k]
                            near[~others] = -np.inf
                            pick = np.argpartition(-near, best - 1)[:best] if len(rows) > best else np.arange(len(rows))
                            pick = pick[others[pick]]
                            score = _products(columns, pick, q)
                            limit = -np.partition(-score, nearest - 1)[nearest - 1] if len(score) >= nearest else -np.inf
                            # a bound that is no number rules nothing out
                            left = np.flatnonzero(~((near * codec.scale + margin) * size[k] < limit - abs(limit) * 1e-12) & others)
                            score = _products(columns, left, q)
                            best_of = top(score, vec_id[left], rows[left])
                            found = left[best_of]
                            yield pa.record_batch([np.full(len(found), query[at + k]), rows[found], vec_id[found], score[best_of]], schema=schema)

    return run


def _search(base: DataFrame, asked: DataFrame, n: int, n_asked: int, nearest: int, rerank: int, sample: int, eta: float, block: int, query_block: int) -> DataFrame:
    """The search among vectors of one length. base, asked: row, vec_id, v."""
    drawn = smallest_hashes(base.select("row", "v"), F.xxhash64("row"), sample).select("v").toArrow().column("v").combine_chunks()
    codec = Codec.fit(_matrix(drawn), eta)
    twins = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id", "row")
    scanned = base.withColumn("twin", F.row_number().over(twins)).where(F.col("twin") <= nearest + 1).select("row", "vec_id", "v")
    parts = n // block + 1
    # a block of codes goes to each block of queries, which are as few as keep the tasks busy and bounded in size
    groups = max(-(-n_asked // (ABREAST * query_block)), min(-(-n_asked // query_block), -(-PAIRS // parts)))
    kind = base.schema["v"].dataType.simpleString()
    coded = scanned.mapInArrow(released(_coder(codec)), f"row long, vec_id long, v {kind}, code binary, gap double")
    packed = lambda df, key, rows, out: df.groupBy(F.pmod(F.xxhash64("row", F.lit(3)), F.lit(rows)).cast("int").alias(key)).agg(F.collect_list(F.struct(*df.columns)).alias(out))
    codes = staged(packed(coded, "part", parts, "codes"), "codes")
    queries = staged(packed(asked.select("row", "v"), "group", groups, "queries"), "queries")
    span = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    # the pairs of blocks are dealt out by both, so none is crowded
    pairs = queries.withColumn("part", span(parts)).join(codes.withColumn("group", span(groups)).hint("merge"), ["part", "group"]).select("queries", "codes")
    share = rerank / parts
    best = max(nearest, min(rerank, int(share + 6 * share**0.5 + 8))) + 1
    found = pairs.mapInArrow(released(_scan(codec, best, nearest, query_block)), "query long, row long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= nearest)
    named = asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return ranked.join(named, "query").select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, asks: Column | DataFrame, nearest: int = 20, rerank: int = RERANK, sample: int = SAMPLE, eta: float = ETA, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query, the `nearest` vectors by inner product, its own row left out.

    vectors: vec_id and embedding. asks: which rows of them are queries, or other rows (vec_id, embedding) that are."""
    rerank = max(rerank, nearest)
    numbered = lambda df: staged(_usable(df).withColumn("row", F.monotonically_increasing_id()), "vectors")
    base = numbered(vectors)
    # queries from elsewhere are no rows of the table, so their numbers are below all of these
    asked = base.where(asks) if isinstance(asks, Column) else numbered(asks).withColumn("row", -1 - F.col("row"))
    count = lambda df: {r[0]: r[1] for r in df.groupBy(F.size("v")).agg(F.count("*")).collect()}
    lengths, wanted = count(base), count(asked)  # as many rows as there are lengths
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d in sorted(lengths.keys() & wanted.keys()):
        of = lambda df, d=d: df.where(F.size("v") == d)
        out = out.unionByName(_search(of(base), of(asked), lengths[d], wanted[d], nearest, rerank, sample, eta, block, query_block))
    return out
