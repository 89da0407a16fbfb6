"""Models come from all training texts."""

import numpy as np
from pyspark.sql import functions as F

from cinderlake.llm import hmm_lm
from cinderlake.llm.chain import Chain


def test_baum_welch_is_plain_rounds_over_all_texts(spark):
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 40, rng.integers(1, 200)).astype(np.int32) for _ in range(300)]
    coded = spark.createDataFrame([(k, [int(x) for x in t]) for k, t in enumerate(texts)], "rid long, symbols array<int>").repartition(5)

    class Known:
        symbol_n = np.bincount(np.concatenate(texts), minlength=40).astype(float)
        size = 40

    got = hmm_lm.baum_welch(coded, Known, states=3, rounds=3)
    want = hmm_lm.Model.first(Known.symbol_n, 3)
    for _ in range(3):
        sums = [want.expected(t, np.array([0, len(t)])) for t in texts]
        want = hmm_lm.Model.of_counts(sum(e for e, _ in sums), sum(t for _, t in sums), Known.symbol_n)
    assert np.allclose(got.emit, want.emit, rtol=1e-3) and np.allclose(got.trans, want.trans, rtol=1e-3)


def test_states_part_in_the_rounds_given(spark):
    """Texts of two kinds of words, which stay for a while: a model that tells them apart halves the choice."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(400):
        side = np.cumsum(rng.random(80) < 0.03) % 2
        rows.append((k, " ".join(f"{'ab'[s]}{w}" for s, w in zip(side, rng.integers(0, 30, 80), strict=True))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gain = hmm_lm.score(docs).where("held_out").agg(F.sum(F.col("score") - F.col("base_score")) / F.sum("n_tokens")).first()[0]
    assert gain > 0.15


def test_steps_of_blocks_lie_side_by_side():
    rng = np.random.default_rng(7)
    sizes = [64, 1, 130, 63, 128]
    first = np.concatenate([[0], np.cumsum(sizes)])
    e = rng.uniform(0.1, 1, (first[-1], 2))
    chain = Chain(e, first, np.full(2, 0.5), rng.dirichlet(np.ones(2), 2))
    assert sorted(chain.place) == list(range(first[-1])) and np.array_equal(chain.e, e[chain.place])
    for t, left in enumerate(chain.left):
        assert np.array_equal(chain.place[chain.step[t] : chain.step[t] + left], chain.at[chain.order][:left] + t)
