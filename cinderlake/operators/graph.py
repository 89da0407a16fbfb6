"""Connected components of an edge table, by contraction.

Every partition first replaces its edges by spanning stars, which join the same nodes with fewer edges than nodes.
While there are more than STEP edges, each node goes, round by round, into the one of its neighbours and itself that has
the smallest hash of that round, and edges are told between what nodes went into; edges within one node vanish. A round
leaves a fraction of the nodes, whatever the graph's shape. What nodes went into is one table a round, and its joins
have one row per node on one side and plain rows on the other, so a hub's edges can be split among tasks. The last
edges, STEP at most, are one partition, whose stars are the components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cinderlake.operators.joins import overlapping
from cinderlake.staging import discard, staged

#: Edges that a partition replaces at once: some 100 MB of a worker.
STEP = 1_000_000


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the edges a-b over n nodes: nodes and their roots, by hooking and jumping."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    rows = 0

    def contracted() -> np.ndarray:
        nodes, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        node, root = spanning(*ends.reshape(2, -1), len(nodes))
        return np.stack([nodes[node], nodes[root]])

    for b in batches:
        held.append(np.stack([b.column("u").to_numpy(), b.column("v").to_numpy()]))
        rows += b.num_rows
        if rows >= STEP:
            # the stars stay for the next step, unless they are too many themselves
            held = [contracted()]
            rows = held[0].shape[1]
            if rows >= STEP // 2:
                yield pa.record_batch(list(held[0]), names=["u", "v"])
                held, rows = [], 0
    if rows:
        yield pa.record_batch(list(contracted()), names=["u", "v"])


def _labelled(edges: DataFrame, most_rounds: int) -> tuple[DataFrame, bool]:
    """Rows (u, root), and whether the root is the component's smallest node."""
    long = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u != v")

    def contracted(links: DataFrame) -> tuple[DataFrame, int]:
        told = Observation()
        out = staged(links.mapInArrow(_stars, "u long, v long"), "links", told, F.count(F.lit(1)).alias("n"))
        return out, told.get["n"]

    now, n = contracted(long)
    rounds: list[DataFrame] = []
    while n > STEP:
        if len(rounds) == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        rank = F.xxhash64("v", F.lit(len(rounds)))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        into = both.groupBy("u").agg(F.min(F.struct(rank.alias("h"), "v")).alias("best"))
        own = F.struct(F.xxhash64("u", F.lit(len(rounds))).alias("h"), F.col("u").alias("v"))
        at = staged(into.select("u", F.least("best", own)["v"].alias("root")), "into")
        rounds.append(at)
        ends = now.join(at.select("u", F.col("root").alias("a")).hint("merge"), "u").join(at.select(F.col("u").alias("v"), F.col("root").alias("b")).hint("merge"), "v")
        last = now
        now, n = contracted(ends.where("a != b").select(F.col("a").alias("u"), F.col("b").alias("v")))
        discard(last)
    # STEP edges at most, so one task holds them
    stars = now.coalesce(1).mapInArrow(_stars, "u long, v long")
    rounds.append(staged(stars.unionByName(stars.select(F.col("v").alias("u"), "v").distinct()).select("u", F.col("v").alias("root")), "into"))
    discard(now)
    out = rounds[0]
    for further in rounds[1:]:
        step = further.select(F.col("u").alias("root"), F.col("root").alias("to")).hint("merge")
        joined = staged(out.join(step, "root", "left").select("u", F.coalesce("to", "root").alias("root")), "roots")
        discard(further)
        discard(out)
        out = joined
    # a star's root is its smallest node
    return out, len(rounds) == 1


def representatives(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Rows (u, root): for each node that has an edge to another, a node of its component, the same for all of it.

    edges: columns u, v (longs). Null ends and loops tell nothing."""
    return _labelled(edges, most_rounds)[0]


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Rows (u, root): the smallest node reachable from each node that has an edge to another, that node itself included.

    edges: columns u, v (longs)."""
    found, smallest = _labelled(edges, most_rounds)
    if smallest:
        return found
    least = staged(found.groupBy("root").agg(F.min("u").alias("least")), "least")
    return found.join(least.hint("merge"), "root").select("u", F.col("least").alias("root"))


def chained(items: DataFrame, x: Column, y: Column, within: float, near: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """items (id and others) with root: the smallest id of the chain of items that are within a distance of each other.

    x, y: a point of the item, null if it is near nothing. near: pairs (a_root, b_root) of items of two tables that are within
    the distance, those of one root left out. Pairs aren't listed: items whose points lie in one block are near each other,
    so a block is one node, and of the blocks around it one point each is compared, as many as the area has blocks, however
    many items there are. This joins dense places; then the items outside of the largest chain meet those of other chains."""
    # a block's diagonal is half the distance
    size = within / 2**1.5 * (1 - 1e-9)
    place = lambda c: F.floor(c / size) if size > 0 else c
    point = items.withColumns({"_x": x.cast("double"), "_y": y.cast("double")})
    point = point.withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in ("_x", "_y")}).withColumns({"_bx": place(F.col("_x")), "_by": place(F.col("_y"))})
    nodes = point.where("_bx is not null and _by is not null").groupBy("_bx", "_by").agg(F.min("id").alias("_node"))
    keyed = staged(point.join(nodes, ["_bx", "_by"], "left").withColumn("_node", F.coalesce("_node", "id")).drop("_bx", "_by"), "blocks")
    chosen = keyed.where("_node = id and _x is not null and _y is not null").groupBy("id").agg(F.min(F.struct("_x", "_y")).alias("p")).select("id", "p._x", "p._y")
    half = within / 2 + 1e-6
    around = chosen.select("id", "_x", "_y", (F.col("_x") - half).alias("w"), (F.col("_y") - half).alias("s"), (F.col("_x") + half).alias("e"), (F.col("_y") + half).alias("n"))
    met = overlapping(around, around, max(within, 1e-3), ("_x", "_y")).where("a_id < b_id")
    surely = F.hypot(F.col("a__x") - F.col("b__x"), F.col("a__y") - F.col("b__y")) <= within * (1 - 1e-12)
    first = components(met.where(surely).select(F.col("a_id").alias("u"), F.col("b_id").alias("v")))
    rooted = staged(keyed.join(first, keyed["_node"] == first["u"], "left").withColumn("root", F.coalesce("root", "_node")).select(*items.columns, "root"), "rooted")
    discard(keyed)
    largest = rooted.groupBy("root").count().orderBy(F.desc("count"), "root").limit(1).collect()  # one row
    rest = rooted.where(F.col("root") != largest[0].root) if largest else rooted
    links = near(rest, rooted).select(F.least("a_root", "b_root").alias("u"), F.greatest("a_root", "b_root").alias("v")).distinct()
    return rooted.join(components(links).withColumnRenamed("root", "_least"), F.col("root") == F.col("u"), "left").withColumn("root", F.coalesce("_least", "root")).select(*items.columns, "root")
