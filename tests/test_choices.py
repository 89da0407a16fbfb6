"""Choices that depend on order, and boxes of any size, against plain versions."""

import random

import pytest

from cinderlake.operators import joins, selection

BOX = "w double, s double, e double, n double"


def meets(a, b):
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def plain_isolate(rows, prior, used, most):
    chosen, events, out = [], set(), {}
    for ordinal, event, *box in sorted(rows):
        if event is not None and event in used:
            out[ordinal] = "used_event"
        elif any(meets(box, p) for p in prior):
            out[ordinal] = "prior_overlap"
        elif event is not None and event in events:
            out[ordinal] = "event_taken"
        elif any(meets(box, c) for c in chosen):
            out[ordinal] = "chosen_overlap"
        elif len(chosen) >= most:
            out[ordinal] = "enough"
        else:
            out[ordinal] = "chosen"
            chosen.append(box)
            events.add(event)
    return out


@pytest.mark.parametrize("most, hot", [(1000, False), (12, False), (1000, True)])
def test_isolated_frames(spark, most, hot):
    rng = random.Random(11)
    rows = []
    for k in range(500):
        # hot: a third of all rows in one place, another third under one event; chains of frames that overlap the next
        x, y = (5.0 + k % 7 * 0.01, 5.0) if hot and k % 3 == 0 else (0.6 * k % 40, 30.0) if k % 3 == 1 else (rng.uniform(0, 20), rng.uniform(0, 20))
        event = None if k % 17 == 0 else 7 if hot and k % 3 == 2 else rng.randrange(150)
        rows.append((k * 3, event, x, y, x + rng.uniform(0.2, 1.5), y + rng.uniform(0.2, 1.5)))
    rng.shuffle(rows)
    prior = [(1.0, 1.0, 3.0, 2.0), (18.0, 18.0, 50.0, 50.0)]
    got = selection.isolate(spark.createDataFrame(rows, f"ordinal long, event long, {BOX}"), spark.createDataFrame(prior, BOX), spark.createDataFrame([(3,), (4,), (None,)], "event long"), most, 2.0, ahead=3)
    assert {r.ordinal: r.reason for r in got.collect()} == plain_isolate(rows, prior, {3, 4}, most)


def test_isolated_frames_of_nothing(spark):
    none = spark.createDataFrame([], f"ordinal long, event long, {BOX}")
    assert selection.isolate(none, spark.createDataFrame([], BOX), spark.createDataFrame([], "event long"), 5, 1.0).count() == 0


def test_boxes_of_all_sizes_overlap(spark):
    rng = random.Random(5)

    def some(n, shift):
        found = [(shift + k, x := rng.uniform(-50, 50), y := rng.uniform(-50, 50), x + 2 ** rng.uniform(-6, 7), y + 2 ** rng.uniform(-6, 7)) for k in range(n)]
        return found + [(shift + n, -180.0, -90.0, 180.0, 90.0), (shift + n + 1, 4.0, 4.0, 8.0, 8.0), (shift + n + 2, 8.0, 4.0, 12.0, 8.0), (shift + n + 3, None, 0.0, 1.0, 1.0), (shift + n + 4, 1.0, 1.0, 1.0, 1.0)]

    a, b = some(150, 0), some(120, 1000)
    frame = lambda rows: spark.createDataFrame(rows, f"id long, {BOX}")
    want = sorted((p[0], q[0]) for p in a for q in b if None not in p and None not in q and meets(p[1:], q[1:]))
    for cell in (0.5, 4.0, 1000.0):
        assert sorted(map(tuple, joins.overlapping(frame(a), frame(b), cell).collect())) == want
    assert joins.overlapping(frame(a).where("id < 0"), frame(b), 1.0).count() == joins.overlapping(frame(a), frame(b).where("id < 0"), 1.0).count() == 0
    # a continental box is a few rows in the plan's join, not one for each small cell
    one = frame(a).where("id = 150")
    assert joins.overlapping(one, one, 0.001).count() == 1
