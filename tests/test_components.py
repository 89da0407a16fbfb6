"""The grid of thresholds and the objects' rings against plain versions over whole grids."""

import numpy as np
import pytest

from cinderlake.operators import morphology


def plain_labels(mask):
    out, n = np.zeros(mask.shape, int), 0
    for i, j in zip(*np.nonzero(mask), strict=True):
        if not out[i, j]:
            n += 1
            todo = [(i, j)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                    out[a, b] = n
                    todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    return out


def table(seed=6, chips=3, h=24, w=19):
    rng = np.random.default_rng(seed)
    cls = np.where(rng.uniform(size=(chips, h, w)) < 0.25, rng.integers(1, 4, (chips, h, w)), 0)
    cls[0, 3:9, 2:9] = 2
    cls[2] = 0
    truth = np.where(rng.uniform(size=cls.shape) < 0.7, cls, rng.integers(0, 4, cls.shape))
    return cls, truth, rng.uniform(size=cls.shape), rng.uniform(size=cls.shape) > 0.1


def frame(spark, cls, truth, p, ok):
    rows = [(c, i, j, int(cls[c, i, j]), int(truth[c, i, j]), float(p[c, i, j]), bool(ok[c, i, j])) for c, i, j in np.ndindex(*cls.shape)]
    return spark.createDataFrame(rows, "chip_id long, row int, col int, cls int, true_cls int, p double, valid boolean")


def plain_score(truth, pred):
    burn = ((truth > 0) & (pred > 0)).sum() / ((truth > 0) | (pred > 0)).sum()
    ious = [((truth == k) & (pred == k)).sum() / ((truth == k) | (pred == k)).sum() for k in (1, 2, 3) if ((truth == k) | (pred == k)).any()]
    return burn, np.mean(ious), (0.35 * burn + 0.30 * np.mean(ious)) / 0.65


def test_far_grid_is_the_sweep(spark):
    cls, truth, p, ok = table()
    hard, soft, least = [4.0, 7.0, 1e9], [1.5, 4.0], [0.4, 0.55]
    got = {(r.hard, r.soft, r.tau): (r.burn_iou, r.severity_miou, r.weighted) for r in morphology.far_grid(frame(spark, cls, truth, p, ok), "cls", "true_cls", "p", hard, soft, least).collect()}
    seen = set()
    for h in hard:
        for s in soft:
            for t in least:
                pred = cls.copy()
                for c in range(len(cls)):
                    marks = plain_labels(cls[c] > 0)
                    if not marks.max():
                        continue
                    size = np.bincount(marks.ravel())
                    size[0] = 0
                    at = np.argwhere(marks == size.argmax())
                    for k in range(1, marks.max() + 1):
                        own = np.argwhere(marks == k)
                        far = np.sqrt(((own[:, None] - at) ** 2).sum(2)).min()
                        if k != size.argmax() and (far > h or far > s and p[c][marks == k].mean() < t):
                            pred[c][marks == k] = 0
                want = plain_score(truth[ok], pred[ok])
                assert got[h, s, t] == pytest.approx(want)
                seen.add(want)
    assert len(got) == 12 and len(seen) > 6


def test_rings_belong_to_one_object(spark):
    cls, _, p, ok = table(9)
    got = {(r.chip_id, r.component): r for r in morphology.object_rings(frame(spark, cls, cls, p, ok).withColumnRenamed("p", "b").selectExpr("*", "cls > 0 AS m"), "m", ["b"], 2.0).collect()}
    want = {}
    for c in range(len(cls)):
        marks = plain_labels(cls[c] > 0)
        at = np.argwhere(marks > 0)
        ring = np.zeros_like(marks)
        for i, j in np.argwhere(marks == 0) if len(at) else []:
            d = ((at - (i, j)) ** 2).sum(1)
            if d.min() <= 4:
                ring[i, j] = marks[tuple(at[d.argmin()])]
        for k in range(1, marks.max() + 1):
            inside, around = p[c][marks == k], p[c][ring == k]
            want[c, k] = (len(inside), len(around), inside.mean() - around.mean() if len(around) else None, inside.std())
    assert set(got) == set(want) and len(want) > 20
    for key, (px, ring_px, contrast, texture) in want.items():
        r = got[key]
        assert (r.px, r.ring_px) == (px, ring_px) and r.b_texture == pytest.approx(texture, abs=1e-9)
        assert r.b_contrast is None if contrast is None else r.b_contrast == pytest.approx(contrast, abs=1e-9)
