"""Rules that raise or name what is wrong, and the nearest pixel in two passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlake.operators import evaluation, joins, morphology, raster


def test_nearest_of_is_the_first_of_the_nearest():
    rng = np.random.default_rng(2)
    for h, w, share in ((1, 1, 1.0), (7, 9, 0.2), (12, 5, 0.05), (16, 16, 0.6), (3, 40, 0.03), (40, 3, 0.03), (20, 20, 0.01)):
        mask = rng.uniform(size=(h, w)) < share
        mask[rng.integers(h), rng.integers(w)] = True
        at = np.argwhere(mask)
        d = (np.arange(h)[:, None, None] - at[:, 0]) ** 2 + (np.arange(w)[None, :, None] - at[:, 1]) ** 2
        want = at[d.argmin(2)]
        assert (morphology.nearest_of(mask) == want[..., 0] * w + want[..., 1]).all()
        assert np.allclose(raster.distance_to(mask), np.sqrt(d.min(2)))
    assert np.isinf(raster.distance_to(np.zeros((3, 4), bool))).all()


GRID = "struct<crs:string,transform:array<double>,width:int,height:int>"
PAIR = f"k int, pre_at date, start_at date, post_at date, pre_available_at date, post_available_at date, tile string, pre_tile string, grid {GRID}, pre_grid {GRID}, w double, s double, e double, n double"


def test_rules_of_pairs(spark):
    good = ("EPSG:32649", [20.0, 0.0, 5e5, 0.0, -20.0, 6.8e6], 100, 100)
    dates = ["2024-01-01", "2024-02-01", "2024-03-01", "2024-01-02", "2024-03-02"]
    case = lambda k, grid=good, pre=None, dates=dates, tile="T": (k, *dates, tile, "T", grid, pre or grid, 1.0, 1.0, 2.0, 2.0)
    rows = [
        case(0), case(1, pre=(*good[:2], 100, 99)), case(2, (good[0], [1.0, 2.0, 0.0, 2.0, 4.0, 0.0], 5, 5)), case(3, (good[0], good[1][:5], 5, 5)), case(4, (None, good[1], 5, 5)),
        case(5, (good[0], [20.0, 0.0, float("nan"), 0.0, -20.0, 0.0], 5, 5)), case(6, (good[0], good[1], 0, 5)), case(7, dates=[*dates[:3], None, dates[4]]), case(8, tile=None), case(9, (good[0], None, 5, 5)),
    ]
    df = spark.createDataFrame(rows, PAIR.replace(" date", " string")).withColumns({c: F.col(c).cast("date") for c in ("pre_at", "start_at", "post_at", "pre_available_at", "post_available_at")})
    got = {r.k: r.violations for r in joins.violations(df).collect()}
    assert got[0] == [] and got[1] == ["same_grid"] and got[2] == ["affine"] and got[3] == ["grid"] and got[5] == ["grid"] and got[6] == ["grid"] and got[7] == ["available"] and got[8] == ["same_tile"]
    assert "grid" in got[4] and "same_grid" not in got[1][1:] and {"grid", "affine"} <= set(got[9])
    assert {r.k: r.violations for r in joins.violations(df, F.lit("2024-02-02").cast("date")).collect()}[0] == ["available"]


def test_undefined_scores_are_errors(spark):
    count = lambda rows: spark.createDataFrame(rows, "sample_id long, group_id long, model string, tp long, fp long, fn long")
    empty = count([(k, k, m, 0, 0, 0) for k in range(3) for m in ("a", "b")])
    with pytest.raises(Exception, match="empty union"):
        evaluation.paired_bootstrap(empty, "a", "b", draws=5).collect()
    with pytest.raises(ValueError, match="negative"):
        evaluation.paired_bootstrap(count([(k, k, m, 1, -1, 0) for k in range(3) for m in ("a", "b")]), "a", "b", draws=5)
    rows = spark.createDataFrame([(1, 0, 4, True)], "chip_id int, truth int, pred int, valid boolean")
    with pytest.raises(Exception, match="class out of range"):
        evaluation.confusion(rows, ["chip_id"], 4).collect()
    assert evaluation.confusion(rows.withColumn("valid", F.lit(False)), ["chip_id"], 4).agg(F.sum("n")).first()[0] == 0


def test_clearest_twin_of_many_scenes(spark):
    frames = spark.createDataFrame([(1, "A", 1), (2, "A", 1), (3, "B", 9)], "frame_id long, tile string, day int")
    scenes = spark.createDataFrame([(10, "A", 1, 5.0), (11, "A", 1, 2.0), (12, "A", 1, 2.0), (13, "A", 2, 0.0)], "scene_id long, tile string, day int, cloud double")
    assert sorted(map(tuple, joins.clearest_twin(frames, scenes).collect())) == [(1, 11, 2.0), (2, 11, 2.0)]
