"""Quality rules, fill-in-middle and whitening against plain versions, with nulls, empty texts, ties and repeated rows."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cinderlake.llm import fill_in_middle, quality_rules, queries, whitening
from tests.compare import DATA

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(n=80):
    rng = random.Random(9)
    good, bad = [f"river{k}" for k in range(60)], [f"BUY{k}!!" for k in range(20)] + ["|", "$$$", "###"]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "x" * 50_000), (4, "a b c d e a b c d e"), (5, "Ünï çødé 😀 'll 12  \n\n x"), (None, "no id at all, but words enough to be judged by the rules of base"), (6, "one two three four five six " * 400)]
    for k in range(7, n):
        words = [rng.choice(good if k % 3 else bad) for _ in range(rng.randint(8, 90))]
        for j in range(9, len(words), 10):
            words[j] += "\n"
        text = " ".join(words)
        rows.append((k, text + ("\n" + " ".join(words[:12]) if k % 7 == 0 else "")))
    return rows + [rows[20], rows[20], (20, "another text of a trusted id, river1 river2 river3 river4 river5")]


def plain_base(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def xx(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed & (1 << 64) - 1)


def plain_grams(text, buckets):
    found = [xx(t.encode()) for t in re.findall(r"[^\W\d_]+|\d+|(?:_|[^\w\s])+", text)]
    pairs = [xx(h.to_bytes(8, "little"), xx(found[i - 1].to_bytes(8, "little")) if i else 42) for i, h in enumerate(found)]
    return [h % buckets for h in found + pairs]


def plain_weights(raw, target, buckets):
    n, m = sum(raw.values()), sum(target.values())
    p = [(raw[b] + 1) / (n + buckets) for b in range(buckets)]
    return [math.log((target[b] + buckets * p[b]) / (m + buckets) / p[b]) if m else 0.0 for b in range(buckets)]


def plain_verdicts(rows, trusted, buckets, stray):
    grams = [plain_grams(t or "", buckets) for _, t in rows]
    half = {i: xx(b"half", xx(int(i).to_bytes(8, "little", signed=True))) for i in trusted if i is not None}
    half = {i: (h - (1 << 64) if h >> 63 else h) % 2 for i, h in half.items()}
    raw, sides = Counter(), [Counter(), Counter()]
    for (i, _), g in zip(rows, grams, strict=True):
        raw.update(g)
        if i in half:
            sides[half[i]].update(g)
    mean = lambda g, w: sum(w[b] for b in g) / len(g) if g else 0.0
    other = [plain_weights(raw, s, buckets) for s in sides]
    own = [mean(g, other[1 - half[i]]) for (i, _), g in zip(rows, grams, strict=True) if i in half]
    threshold = min(0.0, float(np.quantile(own, stray))) if own else 0.0
    whole = plain_weights(raw, sides[0] + sides[1], buckets)
    return [mean(g, whole) for g in grams], threshold


@pytest.mark.parametrize("buckets, stray, trust", [(1 << 10, 0.05, True), (1 << 6, 0.3, True), (1 << 10, 0.05, False)])
def test_rules_are_the_plain_ones(spark, buckets, stray, trust):
    rows = texts()
    trusted = [k for k in range(7, 80) if k % 3 and k % 2] + [None, 9999] if trust else []
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"words": F.lit("x"), "kept": F.lit(9), "_w": F.lit(1), "ratio": F.lit("y")})
    got = quality_rules.judge(docs, spark.createDataFrame([(k,) for k in trusted * 2], "doc_id long"), buckets=buckets, stray=stray).collect()
    ratios, threshold = plain_verdicts(rows, trusted, buckets, stray)
    want = [(i, *plain_base(t or ""), round(q, 9), not plain_base(t or "")[-1] and q >= threshold) for (i, t), q in zip(rows, ratios, strict=True)]
    found = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, round(r.ratio, 9), r.kept) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert got[0]._w == 1 and got[0].words == "x"
    kept = {r.doc_id for r in got if r.kept}
    if trust and buckets > 100:
        # the good ones stay, but for the share that the threshold lets stray
        good = {k for k in range(7, 80) if k % 3} - {r.doc_id for r in got if r.base_failed}
        assert len(good - kept) <= 0.1 * len(good)
        assert not {k for k in range(7, 80) if k % 3 == 0} & kept


def test_rules_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert quality_rules.judge(none, none.select("doc_id")).count() == 0


FIM = [(None, "no id"), (1, None), (2, ""), (3, "\x01\x02 \x02e\x01d \x02\x02d\x01\x01"), (4, "has <S> inside"), (5, "ends like <P"), (6, "<M"), (7, "😀é𝄞\n\r  ünï" * 30), (8, "y" * 60_000)]


def plain_fim(doc_id, text, markers=("<P>", "<S>", "<M>")):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in markers) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, s, m = markers
    a, b, c = text[:low], text[low:high], text[high:]
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", low, high - low, f"{s}{c}{p}{a}{m}{b}" if spm else f"{p}{a}{s}{c}{m}{b}"


def test_texts_are_cut_and_come_back(spark):
    rng = random.Random(4)
    rows = FIM + [(100 + k, "".join(rng.choice("ab <>PSM\x01\x02éd😀\n") for _ in range(rng.randint(1, 60)))) for k in range(200)] + [FIM[3], FIM[3]]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"form": F.lit("x"), "_marked": F.lit(3), "n": F.lit(1)})
    got = fill_in_middle.transform(docs).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == sorted(((i, *plain_fim(i, t)) for i, t in rows), key=repr)
    assert all(r.back == (r.text or "") and r._marked == 3 for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(docs.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("unit, cut", [(fill_in_middle.WORDS, r"\S+\s*|\s+"), (fill_in_middle.LINES, r"[^\n]*\n|[^\n]+")])
def test_units_may_be_words_or_lines(spark, unit, cut):
    rng = random.Random(6)
    rows = [(k, "".join(rng.choice(["to be ", "x\x01y ", "\x02e\n", "or\n\n", " <"]) for _ in range(30))) for k in range(60)]
    got = fill_in_middle.transform(spark.createDataFrame(rows, SCHEMA), unit=unit, markers=("[p]", "[s]", "[m]"), rate=100, suffix_first=50)
    got = got.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"), ("[p]", "[s]", "[m]"))).collect()
    for r in got:
        units = re.findall(cut, r.text)
        assert r.n == len(units) and r.back == r.text and r.form != "plain"
        assert r.prefix_chars in {sum(map(len, units[:k])) for k in range(len(units) + 1)}
    with pytest.raises(ValueError):
        fill_in_middle.transform(spark.createDataFrame(rows, SCHEMA), markers=("ab", "ab", "ac"))


def plain_whitening(vectors, components=8):
    """Exact scatter and deviations in fractions, eigh in double precision."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    centred = [[n * r[k] - s[k] for k in range(d)] for r in x]
    scatter = [[sum(r[i] * r[j] for r in centred) for j in range(d)] for i in range(d)]
    v = np.array([[float(Fraction(scatter[i][j], n**3)) for j in range(d)] for i in range(d)])
    values, parts = np.linalg.eigh(v)
    values, parts = values[::-1][:components], parts[:, ::-1][:, :components]
    white = np.array([[float(Fraction(c, n)) for c in r] for r in centred]) @ parts / np.sqrt(values)
    return n, [sum(c * c for c in r) for r in centred], scatter, white, values / np.trace(v)


def test_whitening_is_exact(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(700, 12)) * rng.uniform(0.1, 3, 12) + rng.normal(size=12)).astype(np.float32)
    x[5] = 0.0
    rows = [(k, [float(c) for c in r], 1) for k, r in enumerate(x)] + [(3, [float(c) for c in x[3]], 1), (None, [float(c) for c in x[4]], 1)]
    used = np.concatenate([x, x[3:5]]).astype(np.float64)
    rows += [(900, None, 1), (901, [None] + [0.0] * 11, 1), (902, [float("inf")] * 12, 1), (903, [float("nan")] * 12, 1), (904, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int").repartition(7)
    n, deviations, scatter, white, explained = plain_whitening(used.tolist())
    got = whitening.whiten(df).collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    order = {(k if k is not None else -1): i for i, k in enumerate([*range(700), 3, None])}
    sign = {}
    for r in got:
        i = order[r.vec_id if r.vec_id is not None else -1]
        assert r.deviation == deviations[i] == int(r.deviation_exact)
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        want = white[i, r.component - 1]
        if abs(want) > 1e-3:
            assert abs(abs(r.whitened) - abs(want)) < 1e-8
            assert sign.setdefault(r.component, np.sign(r.whitened * want)) == np.sign(r.whitened * want)
    fits = whitening.fit(df.where("vec_id < 900 or vec_id is null").select(F.col("embedding").alias("v")))
    assert set(fits) == {12}
    # many primes and few, blocks that don't fill up: the scatter is the exact one
    f = fits[12]
    residues = [np.array([[v % p for v in r] for r in scatter]) for p in f.primes]
    assert whitening.remaindered(residues, f.primes).tolist() == scatter
    assert math.prod(f.primes) > 2 * max(abs(v) for r in scatter for v in r) and all(all(p % q for q in range(2, 1100)) for p in f.primes)


def test_whitening_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(make([(1, None)])).count() == 0
    one = whitening.whiten(make([(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    # fewer vectors than dimensions: what isn't spread is null
    few = whitening.whiten(make([(k, [float(k), 2.0 * k, 5.0]) for k in range(4)])).collect()
    assert all((r.whitened is not None) == (r.component == 1) for r in few) and max(r.identity_error for r in few) < 1e-9
    # lengths apart, and entries so large that neither n x - S nor its square is a long
    huge = [(k, [1e300 if k == 1 else float(k), -3e12 * k]) for k in range(6)] + [(50 + k, [0.5 * k]) for k in range(5)]
    got = whitening.whiten(make(huge)).collect()
    small = {r.vec_id: r for r in got if r.vec_id >= 50}
    assert {r.n for r in small.values()} == {5} and [small[50 + k].deviation for k in range(5)] == [(5 * 512 * (k - 2)) ** 2 for k in range(5)]
    x = [[math.floor(max(-(2.0**53), min(2.0**53, 1024 * c))) + 100_000 for c in v] for k, v in huge if k < 50]
    s = [sum(c) for c in zip(*x)]
    want = {k: sum((6 * c - t) ** 2 for c, t in zip(r, s)) for k, r in enumerate(x)}
    assert all(int(r.deviation_exact) == want[r.vec_id] and r.deviation == (want[r.vec_id] if want[r.vec_id] < 1 << 63 else None) for r in got if r.vec_id < 50)
    assert any(v >= 1 << 63 for v in want.values())


def test_deviations_by_limbs():
    f = whitening.Fit(1, [0, 0, 0], [-(1 << 50)] * 3, [1 << 50] * 3)
    d = np.array([[1 << 50, -(1 << 50), 7], [123456789012345, -1, 0]])
    assert f.deviations(d) == [sum(int(v) ** 2 for v in r) for r in d]


def test_queries_tell_whole_tables(spark):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert queries.op11_quality_rules(spark, str(DATA)).count() == n == queries.op12_fill_in_middle(spark, str(DATA)).count()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op12_fill_in_middle(spark, str(DATA)).collect():
        want = plain_fim(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (*want[:4], hashlib.sha256(want[4].encode()).hexdigest())
        assert r.restored_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
