"""Boosted trees against a plain version that grows leaf by leaf over all rows."""

import numpy as np
import pytest

from cinderlake.operators import boosting
from cinderlake.operators.boosting import BINS, MISSING, UNIT, Binning, Model, Rules

NAMES = ["a", "b", "c", "kind"]


def table(n=900, classes=2, seed=4):
    rng = np.random.default_rng(seed)
    a, b, c, kind = rng.normal(size=n), rng.integers(0, 40, n).astype(float), rng.uniform(size=n), rng.integers(0, 7, n).astype(float)
    signal = a + 0.05 * b * (kind % 2) + np.where(kind == 3, 1.5, 0) + rng.normal(size=n) * 0.4
    y = np.digitize(signal, np.quantile(signal, np.arange(1, classes) / classes))
    a[::11], b[::13], kind[::17] = np.nan, np.nan, np.nan
    a[signal > np.quantile(signal, 0.95)] = np.nan
    return np.stack([a, b, c, kind]), y.astype(int)


def plain_binning(x):
    edges = {}
    for k, name in enumerate(NAMES[:3]):
        v = np.sort(x[k][~np.isnan(x[k])])
        edges[name] = sorted({float(v[int(np.ceil(j / (BINS - 1) * len(v))) - 1]) for j in range(1, BINS - 1)})
    return Binning(NAMES, edges, {"kind": sorted(set(x[3][~np.isnan(x[3])].tolist()))})


def plain_rounds(x, y, classes, binning, rules):
    """Scores of all rows after each round, from trees that split one leaf after another over lists of rows."""
    bins = np.full(x.shape, MISSING)
    for k, name in enumerate(NAMES):
        for i, v in enumerate(x[k]):
            if not np.isnan(v):
                bins[k, i] = binning.codes[name].index(v) if name in binning.codes else sum(e < v for e in binning.edges[name])
    n = len(y)
    scores = np.tile(np.log((y == 1).sum() / (y == 0).sum()), (1, n)) if classes == 2 else np.log([[(y == k).mean()] * n for k in range(classes)])
    for _ in range(rules.rounds):
        if classes == 2:
            p = 1 / (1 + np.exp(-scores))
            hit = (y == 1)[None]
        else:
            e = np.exp(scores - scores.max(0))
            p, hit = e / e.sum(0), np.array([y == k for k in range(classes)])
        g, h = np.rint((p - hit) * UNIT).astype(int), np.rint(p * (1 - p) * UNIT).astype(int)
        step = np.zeros_like(scores)
        for k in range(len(scores)):
            worth = lambda rows: float(g[k, rows].sum()) ** 2 / (h[k, rows].sum() + rules.l2 * UNIT)  # noqa: B023, E731

            def best(rows):
                found = (0.0, None)
                for f in range(len(NAMES)):
                    own = bins[f, rows]
                    sides = []
                    if NAMES[f] in binning.codes:
                        many = [v for v in sorted(set(own.tolist()) - {MISSING}) if (own == v).sum() >= rules.category_rows]
                        many.sort(key=lambda v: g[k, rows[own == v]].sum() / (h[k, rows[own == v]].sum() + rules.category_rows * UNIT))  # noqa: B023
                        for order in (many, many[::-1]):
                            sides += [set(order[: j + 1]) for j in range(len(order))]
                    else:
                        sides += [set(range(j + 1)) for j in range(MISSING)]
                        if (own == MISSING).any():
                            sides += [{*range(j + 1), MISSING} for j in range(MISSING)]
                    for side in sides:
                        go = np.isin(own, list(side))
                        left, right = rows[go], rows[~go]
                        if min(len(left), len(right)) < rules.least_rows or min(h[k, left].sum(), h[k, right].sum()) < rules.least_curvature * UNIT:
                            continue
                        gain = (worth(left) + worth(right) - worth(rows)) / UNIT
                        if gain > found[0]:
                            found = (gain, (left, right))
                return found

            leaves = [("", np.arange(n), best(np.arange(n)))]
            while len(leaves) < rules.leaves:
                open_ = [x for x in leaves if x[2][1] is not None]
                if not open_:
                    break
                node = min(open_, key=lambda x: (-x[2][0], x[0]))
                leaves.remove(node)
                leaves += [(node[0] + s, rows, best(rows)) for s, rows in zip("01", node[2][1], strict=True)]
            for _, rows, _ in leaves:
                step[k, rows] = -rules.rate * g[k, rows].sum() / (h[k, rows].sum() + rules.l2 * UNIT)
        scores = scores + step
        yield scores


@pytest.mark.parametrize("classes", [2, 3])
def test_trees_are_the_plain_ones(spark, monkeypatch, classes):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    x, y = table(400, classes)
    rules = Rules(rounds=3, leaves=6, least_rows=15)
    binning = plain_binning(x)
    rows = spark.createDataFrame([(i, int(y[i]), *[None if np.isnan(v) and i % 2 else float(v) for v in x[:, i]]) for i in range(len(y))] + [(9999, None, 1.0, 1.0, 1.0, 1.0)], "id long, y int, a double, b double, c double, kind double")
    model = boosting.train(rows.repartition(5), "y", NAMES, ["kind"], rules, binning)
    bins = binning.bins(list(x))
    scores = np.array(model.start)[:, None]
    for want, found in zip(plain_rounds(x, y, classes, binning, rules), model.trees, strict=True):
        scores = scores + np.stack([t.scores(bins) for t in found])
        assert np.allclose(scores, want, atol=1e-12)
        assert all(sum(c is None for c in t.children) <= rules.leaves for t in found)
    again = Model.from_json(model.to_json())
    got = {r.id: r for r in boosting.predict(rows, again).collect()}
    p = model.probabilities(bins)
    assert all(np.allclose(got[i].probability, p[i], atol=1e-12) and got[i].probability_class == p[i].argmax() for i in range(len(y)))
    assert got[9999].y is None and abs(sum(got[9999].probability) - 1) < 1e-12
    assert (p.argmax(1) == y).mean() > (0.7 if classes == 2 else 0.5)


def test_bins_of_all_rows_and_small_tables(spark):
    x, y = table(900)
    rows = spark.createDataFrame([(int(y[i]), *[float(v) for v in x[:, i]]) for i in range(len(y))], "y int, a double, b double, c double, kind double")
    binning = Binning.of(rows, NAMES, ["kind"])
    assert binning.codes["kind"] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    assert binning.edges["b"] == [float(k) for k in range(40)] and len(binning.edges["a"]) == BINS - 2
    assert boosting.train(rows.where("y = 1"), "y", NAMES, rules=Rules(rounds=2)).trees == []
    assert boosting.predict(rows.where("y = 1").limit(1), boosting.train(rows.where("y = 1"), "y", NAMES)).first().probability == [1.0]
    with pytest.raises(ValueError):
        boosting.train(rows.where("y > 5"), "y", NAMES)
    constant = boosting.train(rows.selectExpr("y", "1.0 as a"), "y", ["a"], rules=Rules(rounds=1))
    assert constant.trees[0][0].feature == [-1]
