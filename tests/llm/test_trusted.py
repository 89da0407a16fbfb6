"""All trusted documents count, whatever their ids."""

import inspect

import numpy as np

from cinderlake.llm import quality_rules


def test_every_trusted_id_is_met(spark):
    ids = [-(1 << 63), -65, -64, -1, 0, 1, 62, 63, 64, 127, 128, 1 << 40, (1 << 63) - 1]
    docs = spark.createDataFrame([(k, str(k)) for k in ids] + [(None, "none")], "doc_id long, text string")
    trusted = spark.createDataFrame([(k,) for k in ids[::2] * 2] + [(None,)], "doc_id long")
    found = quality_rules._sided(docs, quality_rules._blocks(trusted)).where("half is not null").collect()
    assert sorted(int(r.text) for r in found) == sorted(ids[::2])
    assert "most" not in inspect.signature(quality_rules.judge).parameters


def test_quantile_is_the_plain_one(spark):
    values = [float(k * 37 % 101) for k in range(101)] + [5.0] * 20
    rows = spark.createDataFrame([(v,) for v in values], "ratio double")
    for share in (0.0, 0.002, 0.33, 1.0):
        assert abs(quality_rules._quantile(rows, share) - np.quantile(values, share)) < 1e-9
    assert quality_rules._quantile(rows.limit(0), 0.5) is None
