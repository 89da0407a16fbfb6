"""Gradient-boosted trees over histograms, trained over the whole feature table without collecting rows.

Features are binned once: numbers at quantiles of all rows, categories by their own codes, missing values apart. Binned rows
lie in blocks, one row of a table with the block's bins as bytes. For each level of a tree, one pass adds up the gradients
and curvatures of the loss by node, feature and bin; the task that has a node's sums of a feature finds its best split by
prefix sums, so that a few numbers for each node and feature reach the driver. Gradients are whole numbers of 2**-30, so
sums don't depend on their order and reruns give the same trees.

Trees grow leaf by leaf, the best gain first, up to a number of leaves. A pass looks ahead: all leaves that may still be
split get the splits of their children, and the choice is then made among what is known, so that a tree takes about as many
passes as it is deep. Categories are put in order of their gradients; missing values go to the better side. One tree for
each round tells two classes apart, one for each class and round tells more. Every few rounds the rows' sums of trees are
written with the blocks, and the table before is deleted.

Edge cases: rows without a label are left out; null and NaN are missing; a category that wasn't seen counts as missing; a
feature with one value never splits; labels of one class give a model without trees, and an empty table is an error.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.staging import discard, staged

#: Bins of a feature; the last one holds missing values.
BINS, MISSING = 256, 255
#: One of the whole numbers that gradients are told in.
UNIT = float(1 << 30)
#: Rounds after which sums of trees are written with the rows.
REFRESH = 10


@dataclass(frozen=True)
class Rules:
    rounds: int = 300
    rate: float = 0.1
    leaves: int = 31
    l2: float = 1.0
    least_rows: int = 20
    least_curvature: float = 1e-3
    #: Rows that a category needs for a place in the order, and what its curvature is smoothed by.
    category_rows: int = 10


@dataclass
class Binning:
    """names; edges of each number's bins (a value up to edge k is in bin k or below); codes of each category."""

    names: list[str]
    edges: dict[str, list[float]]
    codes: dict[str, list[float]]

    @classmethod
    def of(cls, rows: DataFrame, names: Sequence[str], categorical: Sequence[str] = (), accuracy: int = 10_000) -> Binning:
        numbers = [n for n in names if n not in categorical]
        shares = [k / (BINS - 1) for k in range(1, BINS - 1)]
        known = lambda n: F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double"))
        found = rows.agg(*[F.percentile_approx(known(n), shares, accuracy).alias(n) for n in numbers]).first() if numbers else {}
        edges = {n: sorted(set(found[n] or [])) for n in numbers}
        codes = {}
        for n in categorical:
            # a category for each bin at most, the most frequent ones
            top = rows.select(known(n).alias("v")).where("v is not null").groupBy("v").count().orderBy(F.desc("count"), "v").limit(BINS - 1).collect()
            codes[n] = sorted(r.v for r in top)
        return cls(list(names), edges, codes)

    def bins(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """Bins of the features, one row for each feature."""
        out = np.full((len(self.names), len(columns[0]) if columns else 0), MISSING, np.uint8)
        for k, (name, x) in enumerate(zip(self.names, columns, strict=True)):
            there = ~np.isnan(x)
            if name in self.codes:
                codes = np.array(self.codes[name])
                at = np.minimum(np.searchsorted(codes, x[there]), max(len(codes) - 1, 0))
                out[k, there] = np.where(codes[at] == x[there], at, MISSING) if len(codes) else MISSING
            else:
                out[k, there] = np.searchsorted(np.array(self.edges[name]), x[there], side="left")
        return out


@dataclass
class Tree:
    """Nodes in order, each after its parent: feature (-1: a leaf), the bins that go left, children, value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    left_bins: list[list[int] | None] = field(default_factory=lambda: [None])
    children: list[tuple[int, int] | None] = field(default_factory=lambda: [None])
    value: list[float] = field(default_factory=lambda: [0.0])

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Each node's feature, and the next node for each bin; leaves lead to themselves."""
        nxt = np.repeat(np.arange(len(self.feature))[:, None], BINS, 1)
        for k, ends in enumerate(self.children):
            if ends is not None:
                nxt[k] = ends[1]
                nxt[k, self.left_bins[k]] = ends[0]
        return np.maximum(np.array(self.feature), 0), nxt

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf that each row ends in."""
        feature, nxt = self.tables()
        node, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        while True:
            to = nxt[node, bins[feature[node], rows]]
            if (to == node).all():
                return node
            node = to

    def split(self, node: int, feature: int, left_bins: list[int]) -> tuple[int, int]:
        ends = (len(self.feature), len(self.feature) + 1)
        self.feature[node], self.left_bins[node], self.children[node] = feature, left_bins, ends
        for _ in ends:
            self.feature.append(-1)
            self.left_bins.append(None)
            self.children.append(None)
            self.value.append(0.0)
        return ends

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


@dataclass
class Model:
    binning: Binning
    classes: list[int]
    start: list[float]
    trees: list[list[Tree]]

    def to_json(self) -> str:
        return json.dumps({"binning": asdict(self.binning), "classes": self.classes, "start": self.start, "trees": [[asdict(t) for t in r] for r in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> Model:
        d = json.loads(text)
        tree = lambda t: Tree(t["feature"], t["left_bins"], [None if c is None else tuple(c) for c in t["children"]], t["value"])
        return cls(Binning(**d["binning"]), d["classes"], d["start"], [[tree(t) for t in r] for r in d["trees"]])

    def probabilities(self, bins: np.ndarray) -> np.ndarray:
        """Rows by class."""
        s = np.array(self.start)[:, None] + sum((np.stack([t.scores(bins) for t in r]) for r in self.trees), np.zeros((len(self.start), bins.shape[1])))
        return _shares(s, len(self.classes)).T


def _shares(scores: np.ndarray, classes: int) -> np.ndarray:
    """Probabilities of the classes from their scores; of two classes only the second has one."""
    if classes == 1:
        return np.ones((1, scores.shape[1]))
    if classes == 2:
        p = 1 / (1 + np.exp(-np.clip(scores[0], -500, 500)))
        return np.stack([1 - p, p])
    e = np.exp(scores - scores.max(0))
    return e / e.sum(0)


def gradients(scores: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss, in whole UNITs; a row for each tree of a round."""
    p = _shares(scores, classes)
    own = p[1:] if classes == 2 else p
    hit = (y == 1)[None] if classes == 2 else y[None] == np.arange(classes)[:, None]
    return np.rint((own - hit) * UNIT).astype(np.int64), np.rint(own * (1 - own) * UNIT).astype(np.int64)


def best_split(sums: np.ndarray, categorical: bool, rules: Rules) -> tuple[float, list[int], tuple[int, int, int]] | None:
    """Gain, bins that go left and the left side's sums, of a node's sums by bin: rows of gradient, curvature, number.

    Of equal gains the first counts: missing values to the right before to the left, and lower bins before higher ones."""
    whole = sums.sum(1)
    found = None
    if categorical:
        many = np.flatnonzero(sums[2, :MISSING] >= rules.category_rows)
        order = many[np.argsort(sums[0, many] / (sums[1, many] + rules.category_rows * UNIT), kind="stable")]
        runs = [(order, np.zeros(3, np.int64)), (order[::-1], np.zeros(3, np.int64))]
    else:
        order = np.arange(MISSING)
        runs = [(order, np.zeros(3, np.int64)), (order, sums[:, MISSING])]
    score = lambda g, h: g.astype(np.float64) ** 2 / (h + rules.l2 * UNIT)
    for k, (order, ahead) in enumerate(runs):
        if not len(order) or k and not categorical and not ahead[2]:
            continue
        left = np.cumsum(sums[:, order], axis=1) + ahead[:, None]
        right = whole[:, None] - left
        ok = (left[2] >= rules.least_rows) & (right[2] >= rules.least_rows) & (np.minimum(left[1], right[1]) >= rules.least_curvature * UNIT)
        gain = np.where(ok, (score(left[0], left[1]) + score(right[0], right[1]) - score(whole[:1], whole[1:2])) / UNIT, -np.inf)
        at = int(gain.argmax())
        if gain[at] > 0 and (found is None or gain[at] > found[0]):
            side = sorted(order[: at + 1].tolist()) + ([MISSING] if k and not categorical else [])
            found = float(gain[at]), side, tuple(int(v) for v in left[:, at])
    return found


class Node:
    """What is known of a node of a growing tree; path tells its place, for ties."""

    def __init__(self, path: str, at: int):
        self.path, self.at = path, at
        self.sums: tuple[int, int, int] | None = None
        self.split: tuple[float, int, list[int]] | None = None
        self.ends: list[Node] | None = None

    def __lt__(self, other: Node) -> bool:
        return (-self.split[0], self.path) < (-other.split[0], other.path)


def _chosen(root: Node, leaves: int) -> tuple[list[Node], list[Node]]:
    """The nodes that best-first growth splits, as far as is known, and those it can't go on without (none: it is done)."""
    heap, done = [root] if root.split else [], []
    while heap and len(done) < leaves - 1:
        node = heapq.heappop(heap)
        if node.ends is None:
            return done, sorted([node, *heap])
        done.append(node)
        for end in node.ends:
            if end.split:
                heapq.heappush(heap, end)
    return done, []


def grown(look: Callable[[list[Tree], list[list[int]]], list[dict[int, tuple]]], trees: int, rules: Rules) -> list[Tree]:
    """One round's trees, grown side by side.

    look: from the trees so far and the nodes asked for, each node's sums and best split (gain, feature, bins) or None."""
    seen, roots, asked = [Tree() for _ in range(trees)], [Node("", 0) for _ in range(trees)], [[0]] * trees
    nodes = [{0: r} for r in roots]
    while any(asked):
        for k, told in enumerate(look(seen, asked)):
            for at, (sums, split) in told.items():
                nodes[k][at].sums, nodes[k][at].split = sums, split
        asked = []
        for k, root in enumerate(roots):
            done, open_ = _chosen(root, rules.leaves)
            new = []
            # as many leaves as may still be split, those first that growth waits for; the others look ahead
            ahead = sorted(n for n in nodes[k].values() if n.split and n.ends is None and n not in open_) if open_ else []
            for node in (open_ + ahead)[: rules.leaves - 1 - len(done)]:
                gain, feature, left = node.split
                ends = seen[k].split(node.at, feature, left)
                node.ends = [Node(node.path + side, at) for side, at in zip("01", ends, strict=True)]
                nodes[k] |= {n.at: n for n in node.ends}
                new += ends
            asked.append(new)
    return [_pruned(root, {id(n) for n in _chosen(root, rules.leaves)[0]}, rules) for root in roots]


def _pruned(root: Node, split: set[int], rules: Rules) -> Tree:
    tree, todo = Tree(), [(root, 0)]
    while todo:
        node, at = todo.pop(0)
        g, h, _ = node.sums
        if id(node) in split:
            todo += list(zip(node.ends, tree.split(at, node.split[1], node.split[2]), strict=True))
        else:
            tree.value[at] = -rules.rate * g / (h + rules.l2 * UNIT) if h or rules.l2 else 0.0
    return tree


_BLOCK = "bins binary, y binary, scores binary"


def _columns(b: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    return [b.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in names]


def _blocks(rows: DataFrame, label: str, binning: Binning, classes: list[int], start: list[float]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(binning)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = np.searchsorted(classes, b.column(label).to_numpy()).astype(np.uint8)
                scores = np.repeat(np.array(start)[:, None], b.num_rows, 1)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (shared.value.bins(_columns(b, binning.names)), y, scores)], names=["bins", "y", "scores"])

    src = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("long").alias(label), *[F.col(n).cast("double").alias(n) for n in binning.names])
    return src.mapInArrow(run, _BLOCK)


def _open(b: pa.RecordBatch, features: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for bins, y, scores in zip(*[b.column(c) for c in ("bins", "y", "scores")], strict=True):
        n = len(y.as_buffer())
        yield np.frombuffer(bins.as_buffer(), np.uint8).reshape(features, n), np.frombuffer(y.as_buffer(), np.uint8), np.frombuffer(scores.as_buffer(), np.float64).reshape(-1, n)


def _summed(scores: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    for r in rounds:
        scores = scores + np.stack([t.scores(bins) for t in r])
    return scores


def _refreshed(blocks: DataFrame, features: int, rounds: list[list[Tree]]) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [_summed(scores, bins, shared.value).tobytes() for bins, _, scores in _open(b, features)]
            yield pa.RecordBatch.from_arrays([b.column("bins"), b.column("y"), pa.array(new, pa.binary())], names=["bins", "y", "scores"])

    return blocks.mapInArrow(run, _BLOCK)


def _histograms(shared, features: int, classes: int):
    """Sums by tree, node and feature: gradients, curvatures and numbers of each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, growing, asked = shared.value
        total = [np.zeros((len(a), features, 3, BINS), np.int64) for a in asked]
        for b in batches:
            for bins, y, scores in _open(b, features):
                g, h = gradients(_summed(scores, bins, rounds), y, classes)
                for k, tree in enumerate(growing):
                    if not asked[k]:
                        continue
                    place = np.full(len(tree.feature), -1)
                    place[asked[k]] = np.arange(len(asked[k]))
                    at = place[tree.leaves(bins)]
                    own = np.flatnonzero(at >= 0)
                    many = len(asked[k]) * BINS
                    for f in range(features):
                        key = at[own] * BINS + bins[f, own]
                        # whole numbers, exact in a double: a block has few rows
                        for j, w in enumerate((g[k, own], h[k, own], None)):
                            total[k][:, f, j] += np.bincount(key, w, many).astype(np.int64).reshape(-1, BINS)
        keys = [(k, n, f, total[k][i, f].tobytes()) for k, a in enumerate(asked) for i, n in enumerate(a) for f in range(features) if total[k][i, f, 2].any()]
        cols = list(zip(*keys, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in cols[:3]], pa.array(cols[3], pa.binary())], names=["tree", "node", "feature", "sums"])

    return run


def _splits(categorical: set[int], rules: Rules):
    """Adds up the sums of each tree, node and feature as they come, and finds the best split of each."""
    schema = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("g", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("gain", pa.float64()), ("left", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], np.ndarray] = {}
        for b in batches:
            for *key, s in zip(*[b.column(c).to_pylist() for c in ("tree", "node", "feature", "sums")], strict=True):
                total[tuple(key)] = total.get(tuple(key), 0) + np.frombuffer(s, np.int64).reshape(3, BINS)
        rows = []
        for key, sums in total.items():
            found = best_split(sums, key[2] in categorical, rules)
            rows.append({**dict(zip(("tree", "node", "feature"), key, strict=True)), **dict(zip("ghn", sums.sum(1).tolist(), strict=True)), "gain": found and found[0], "left": found and found[1]})
        yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def train(rows: DataFrame, label: str, names: Sequence[str], categorical: Sequence[str] = (), rules: Rules = Rules(), binning: Binning | None = None) -> Model:
    """A model of the label (whole numbers, few of them) by the named features."""
    spark = rows.sparkSession
    # one row for each class
    known = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("long").alias("y")).count().orderBy("y").collect()
    if not known:
        raise ValueError("no labelled row")
    classes, counts = [r.y for r in known], np.array([r["count"] for r in known], np.float64)
    binning = binning or Binning.of(rows.where(F.col(label).isNotNull()), names, categorical)
    start = [float(np.log(counts[1] / counts[0]))] if len(classes) == 2 else np.log(counts / counts.sum()).tolist()
    model = Model(binning, classes, start, [])
    if len(classes) == 1:
        return model
    features, marked = len(binning.names), {k for k, n in enumerate(binning.names) if n in binning.codes}
    blocks = staged(_blocks(rows, label, binning, classes, start), "blocks")
    waiting: list[list[Tree]] = []

    def look(growing: list[Tree], asked: list[list[int]]) -> list[dict[int, tuple]]:
        shared = spark.sparkContext.broadcast((waiting, growing, asked))
        parts = blocks.mapInArrow(_histograms(shared, features, len(classes)), "tree int, node int, feature int, sums binary")
        best = parts.repartition("tree", "node", "feature").mapInArrow(_splits(marked, rules), "tree int, node int, feature int, g long, h long, n long, gain double, left array<int>")
        told: list[dict[int, tuple]] = [{} for _ in growing]
        # a row for each node and feature; of equal gains the first feature counts
        for r in sorted(best.collect(), key=lambda r: r.feature):
            sums, split = told[r.tree].get(r.node, ((r.g, r.h, r.n), None))
            if r.gain is not None and (split is None or r.gain > split[0]):
                split = (r.gain, r.feature, list(r.left))
            told[r.tree][r.node] = (sums, split)
        shared.destroy()
        return told

    for _ in range(rules.rounds):
        found = grown(look, len(start), rules)
        model.trees.append(found)
        waiting.append(found)
        if len(waiting) == REFRESH:
            old, blocks = blocks, staged(_refreshed(blocks, features, waiting), "blocks")
            discard(old)
            waiting = []
    discard(blocks)
    return model


def predict(rows: DataFrame, model: Model, out: str = "probability") -> DataFrame:
    """rows with the classes' probabilities in order, and `<out>_class`, the likeliest one (of equal ones the first)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    src = rows.drop(out, f"{out}_class")
    given = src.columns
    names = model.binning.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for b in batches:
            p = m.probabilities(m.binning.bins(_columns(b, [f"_{k}" for k in range(len(names))])))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
            best = np.array(m.classes)[p.argmax(1)] if len(p) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(len(given))], lists, pa.array(best, pa.int64())], names=[*given, out, f"{out}_class"])

    ready = src.select(*[F.col(f"`{c}`") for c in given], *[F.col(f"`{n}`").cast("double").alias(f"_{k}") for k, n in enumerate(names)])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema)
    return ready.mapInArrow(run, f"{fields}, `{out}` array<double>, `{out}_class` long")


def share(model: Model, class_: int, out: str = "probability") -> Column:
    """The probability of one class, from predicted rows; a class that wasn't seen has none."""
    return F.get(out, F.lit(model.classes.index(class_))) if class_ in model.classes else F.lit(0.0)
