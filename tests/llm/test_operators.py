"""Each operator against a plain version on small tables, with nulls, empty texts, ties, repeated rows and extra columns."""

import base64
import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from cinderlake.llm import ann_search, byte_bpe, fingerprints, hmm_lm, html_extraction, language_id, quality, queries, simhash_dedup, source_mixing, substring_dedup
from cinderlake.llm.chain import Chain
from tests.compare import DATA, both

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = [(0, None, None, None, 0), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, " \t\n", "en", "b", 3), (3, "x" * 100_000, "de", "b", 100_000), (4, "Ünï çødé 😀 'll 12  \n\n x", "de", None, 9)]
    for k in range(5, n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 150)))
        if k % 4 == 0:
            text = f"{text} {passage} tail{k}"
        rows.append((k, text, "en" if k % 2 else "de", "abc"[k % 3], len(text)))
    rows += [rows[20], rows[20], (n + 1, rows[21][1] + " more", "en", "a", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_search_finds_the_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[300:340] = x[7]
    rows = [(k, [float(v) for v in r], "extra") for k, r in enumerate(x)] + [(900, None, ""), (901, [0.0] * 16, ""), (902, [float("nan")] * 16, ""), (None, [1.0] * 16, "")]
    # two rows under one id, equal rows, and vectors of another length
    more = [(3, [float(v) for v in 10 * x[0]], "again"), (40, [float(v) for v in x[40]], "twin"), (1001, [1.0, 2.0], ""), (1000, [1.0, 1.0], ""), (1002, [-1.0, -1.0], "")]
    df = spark.createDataFrame(rows + more, "vec_id long, embedding array<float>, score string")
    ids = np.array([*range(600), 3, 40])
    vectors = np.concatenate([x, [10 * x[0], x[40]]]).astype(np.float32).astype(np.float64)
    got = {}
    for r in ann_search.search(df, F.col("vec_id") % 20 == 0, nearest=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got.pop(1000)) == [(1, 1001, 3.0), (2, 1002, -2.0)]
    assert set(got) == set(range(0, 600, 20)) and len(got[40]) == 10
    hits = 0
    for k in np.flatnonzero(ids % 20 == 0):
        score = vectors @ vectors[k]
        want = [j for j in np.lexsort((ids, -np.round(score, 9))) if j != k][:5]
        found = got[ids[k]]
        hits += len({ids[j] for j in want} & {v for _, v, _ in found})
        assert [r for r, _, _ in sorted(found)][:5] in ([1, 2, 3, 4, 5], [1, 1, 2, 2, 3])
        assert all(any(abs(s - score[j]) < 1e-9 for j in np.flatnonzero(ids == v)) for _, v, s in found)
    assert hits >= 0.95 * 5 * (len(got) + 1)
    # the scaled copy of a vector under another id is a row of its own, and so is the twin of a row that asks
    assert 3 in {v for _, v, _ in got[0]}
    assert {r.vec_id for r in ann_search.search(df, F.col("vec_id") == 40, nearest=650).collect()} >= {40, 3, 41}
    assert ann_search.search(df.where("vec_id < 0"), df).count() == 0
    # queries from elsewhere have no row of their own
    assert [r.vec_id for r in ann_search.search(df, df.where("vec_id = 1000"), nearest=2).orderBy("rank").collect()] == [1001, 1000]


def test_search_where_the_tables_choose(spark):
    """Many blocks, and far fewer reranked than there are vectors."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(6000, 32)) * rng.uniform(0.5, 1.5, (6000, 1))).astype(np.float32)
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann_search.search(df, F.col("vec_id") % 20 == 0, nearest=10, rerank=120, sample=1000, block=700, query_block=50).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 20):
        score = x.astype(np.float64) @ x[q].astype(np.float64)
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:10]) & got[q])
    assert hits >= 0.9 * 10 * 300, hits / 3000


def test_search_misses_none_where_codes_say_little(spark):
    """A crowd around one direction, which codes can't tell apart, few large components, and scores that tie."""
    rng = np.random.default_rng(4)
    crowd = 5 + rng.normal(size=(2500, 16)) * 0.01
    spiked = rng.normal(size=(1500, 16)) * np.array([100.0] + [0.1] * 15)
    ties = rng.integers(-1, 2, (2000, 16))
    x = np.concatenate([crowd, spiked, ties + 0.0]).astype(np.float32)
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann_search.search(df, F.col("vec_id") % 20 == 0, nearest=10, rerank=40, sample=500, block=900, query_block=40).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = x.astype(np.float64)
    asked = [q for q in range(0, 6000, 20) if x[q].any()]
    assert set(got) == set(asked)
    for q in asked:
        score = np.add.accumulate(x * x[q], axis=1)[:, -1]
        want = [j for j in np.lexsort((np.arange(6000), -score)) if j != q and x[j].any()][:10]
        assert sorted(got[q]) == [(k, j, score[j]) for k, j in enumerate(want, 1)], q


def plain_repeats(rows, window=35):
    texts = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    for r, w in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        yield r[0], len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


@pytest.mark.parametrize("limit", [50_000, 2])
def test_repeated_windows_go(docs, empty, limit):
    got = substring_dedup.remove_repeats(docs.select("doc_id", "text"), keep_text=False, group_limit=limit).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(plain_repeats(corpus()))
    assert substring_dedup.remove_repeats(empty).count() == 0


def plain_paragraphs(text):
    word, gap, most = r"[^\x20\x09-\x0D]++", r"[\x20\x09]++", fingerprints.MOST
    found = []
    for line in re.split(r"[\n\x0B\f\r]", text):
        words = [(m.group(), m.end()) for m in re.finditer(word, line)]
        starts = [m.start() for m in re.finditer(word, line)]
        at = 0
        while at < len(words):
            ends = [k for k in range(at + fingerprints.LEAST - 1, min(at + most, len(words))) if words[k][0][-1] in ".!?。"]
            to = ends[0] if ends else min(at + most, len(words)) - 1
            found.append(line[starts[at] : words[to][1]])
            at = to + 1
    return set(found)


def test_fingerprints(spark, docs, empty):
    rng = random.Random(13)
    say = lambda n: " ".join(rng.choice(["alpha", "beta.", "gamma", "delta", "eps!", "zeta"]) + str(rng.randrange(50)) * (rng.random() < 0.5) for _ in range(n))
    rows = corpus() + [(500 + k, "\n".join(say(rng.randint(1, 300)) for _ in range(rng.randint(1, 40))), "en", "a", 0) for k in range(40)]
    long = say(4000)
    rows += [(700, long, "en", "a", 0), (701, long.replace(" ", " new ", 1), "en", "a", 0), (None, "no id", None, None, 0), (None, "no id", None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"k1": F.lit(1), "rows": F.lit("x"), "fingerprint": F.lit("y"), "at": F.lit(2)})
    got = fingerprints.edited_fingerprints(df).collect()
    assert len(got) == len(rows)
    # by descending id, then by the text's hash; only ids with one text have a place that is known here
    text_of = {}
    for r in rows:
        text_of.setdefault(r[0], set()).add(r[1] or "")
    ids = sorted((k for k in text_of if k is not None), reverse=True) + [None]
    prints, likes = {}, lambda a, b: 1.0 if not a | b else 1 - len(a ^ b) / (len(a) + len(b))
    checked = 0
    for r in got:
        if len(text_of[r.doc_id]) > 1:
            continue
        (text,), after = text_of[r.doc_id], text_of[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint and r.n_chars == len(text)
        k = len(text) // 3
        cases = {text} if sum(x[0] == r.doc_id for x in rows) > 1 else set()
        ok = False
        for other in cases | after:
            edited = text[: len(text) - k] + other[:k]
            own = plain_paragraphs(text)
            ok |= r.edited_sha256 == sha(edited) and abs(r.near_edited - likes(own, plain_paragraphs(edited))) < 1e-12 and abs(r.near_next - likes(own, plain_paragraphs(other))) < 1e-12
            if edited == text:
                assert r.near_edited == 1.0 and r.fingerprint == r.edited_fingerprint
        assert ok, r.doc_id
        checked += 1
    assert checked > 90
    # one more word changes few paragraphs
    assert next(r.near_next for r in got if r.doc_id == 701) > 0.9
    assert fingerprints.edited_fingerprints(empty).count() == 0


def test_sketches_tell_by_themselves(spark):
    """Likeness comes out of the cells: with other cells beside the same digests it fails or changes."""
    rows = [("a b c d e f g h\n" * 3 + "one two\nthree", "a b c d e f g h\nfour")]
    df = spark.createDataFrame(rows, "x string, y string").select(fingerprints.digests(F.col("x")).alias("x"), fingerprints.digests(F.col("y")).alias("y"))
    cells = fingerprints.with_cells(df, xc="x", yc="y")
    a, b = fingerprints.Fingerprint("x", "xc"), fingerprints.Fingerprint("y", "yc")
    r = cells.select(fingerprints.difference(a, b).alias("d"), fingerprints.difference(a, fingerprints.Fingerprint("y", "xc")).alias("same")).first()
    assert (r.d, r.same) == (3, 0)


def test_mixing_meets_targets(docs, empty):
    rows = source_mixing.mix(docs).collect()
    assert len(rows) == len(corpus())
    by = {}
    for r in rows:
        assert r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), []).append(r)
    for (size, target), own in by.items():
        assert target <= 2 * size + 1e-9 and size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 2 * max(r.size for r in own) + 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, source_mixing.mix(docs).collect()))
    assert sum(r.copies for r in rows) == source_mixing.mixed(docs).count()
    assert source_mixing.mix(empty).count() == 0


@pytest.mark.parametrize("book", [0, 20])
def test_encoding_agrees_with_the_library(docs, book):
    enc = encoding()
    got = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, size=max(book, 1), digests=True).collect()
    want = sorted((r[0], len(ids := enc.encode_ordinary(r[1] or "")), sha(" ".join(map(str, ids))), sha(r[1] or "")) for r in corpus())
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_decoding_gives_the_text(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, size=50)
    assert all(r.decoded == (r.text or "") for r in byte_bpe.decode(coded, path).collect())
    assert byte_bpe.encode(empty, path, public_tokenizers.PATTERN).count() == 0


def plain_simhash(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs, empty):
    rows = corpus()
    fp = [plain_simhash(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for k, r in enumerate(rows):
        least[find(k)] = min(least.get(find(k), r[0]), r[0])
    want = sorted((r[0], f"{fp[k]:016x}", least[find(k)]) for k, r in enumerate(rows))
    got = simhash_dedup.near_duplicates(docs, tile=8)
    got = got.select("doc_id", simhash_dedup.as_hex(got.fp).alias("f"), "component_id").collect()
    assert sorted(map(tuple, got)) == want
    assert simhash_dedup.one_of_each(docs).count() == len(least)
    assert simhash_dedup.near_duplicates(empty).count() == 0


def test_large_groups_are_dealt_to_chunks(spark):
    """Groups that no chunk holds: copies of one text, a chain of texts, and two blocks that one late text joins."""
    rng = random.Random(14)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for k in range(60):
        w = list(base)
        w[rng.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(w)))
    chain = [f"c{k}" for k in range(400)]
    rows += [(100 + k, " ".join(chain[6 * k : 6 * k + 120])) for k in range(40)]
    sets = [plain_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    df = spark.createDataFrame(rows, "set_id long, text string")
    members = df.select(F.lit(1).cast("long").alias("loose"), "set_id", F.lit(116).cast("long").alias("size"))
    for together in (10**6, 1000, 300):
        got = {r.set_id: r.root for r in simhash_dedup.exact_groups(members, df, 0.8, 5, together).collect()}
        blocks = {}
        for k, (i, _) in enumerate(rows):
            blocks.setdefault(find(k), set()).add(got.get(i, i))
        assert all(len(b) == 1 for b in blocks.values()) and len(set.union(*blocks.values())) == len(blocks)


def plain_shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("tile", [8, 4096])
def test_near_copies_of_the_pipeline(spark, empty, tile):
    import corpus_pipeline

    rng = random.Random(6)
    rows = corpus()
    for k in range(60):
        w = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([8, 9, 69, 120, 246]))]
        rows.append((1000 + 10 * k, " ".join(w), "en", "a", 1))
        for c in range(1, 5):
            # edits that leave similarities on both sides of 0.8
            e = list(w)
            for i in rng.sample(range(len(w)), max(1, len(w) * c // 75)):
                e[i] = f"new{rng.randrange(10**6)}"
            rows.append((1000 + 10 * k + c, " ".join(e if len(w) > 9 else w[: len(w) - c]), "en", "a", 1))
    sets = [plain_shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    narrow = 0
    for i in range(len(rows)):
        for j in range(i):
            both, any_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if not any_ or both >= 0.8 * any_:
                root[find(i)] = find(j)
                narrow += bool(any_) and both < 0.85 * any_
    assert narrow > 20
    want = {}
    for k, r in enumerate(rows):
        want[find(k)] = min(want.get(find(k), r[0]), r[0])
    docs = spark.createDataFrame(rows, SCHEMA)
    got = simhash_dedup.one_of_similar(docs, tile=tile).collect() if tile < 4096 else corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == sorted(want.values())
    assert simhash_dedup.one_of_similar(empty).count() == 0


def test_language_model(docs, empty):
    got = {r.doc_id: r for r in hmm_lm.score(docs, frequent=100).collect()}
    rows = corpus()
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows}
    tokens = {r[0]: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(r[1] or "")] + [None] for r in rows}
    c = Counter(t for r in rows if not held[r[0]] for t in tokens[r[0]])
    total, distinct = sum(c.values()), len(c)
    for k, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(tokens[k]), sum(c[t] > 0 for t in tokens[k]), total)
        assert abs(r.base_score - sum(np.log10((c[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens[k])) < 1e-6
        assert np.isfinite(r.score) and r.score < 0
    assert hmm_lm.score(empty).count() == 0


def test_chain_is_the_recursion():
    rng = np.random.default_rng(0)
    sizes = [1, 3, 64, 65, 400]
    first = np.concatenate([[0], np.cumsum(sizes)])
    e, a, s = rng.uniform(1e-6, 1e-2, (first[-1], 3)), rng.dirichlet(np.ones(3), 3), np.full(3, 1 / 3)
    chain = Chain(e, first, s, a)
    for k in range(len(sizes)):
        v, z = s, 0.0
        for t in range(first[k], first[k + 1]):
            v = (v @ a) * e[t]
            z, v = z + np.log(v.sum()), v / v.sum()
        assert abs(chain.log_z[k] - z) < 1e-9 * max(1, abs(z))
    gamma, pairs = chain.posteriors(pairs=True)
    assert np.allclose(gamma.sum(1), 1) and abs(pairs.sum() - first[-1]) < 1e-6


def test_quality_separates(spark, empty):
    rng = random.Random(3)
    rows, labels = [(900, None), (901, "")], []
    for k in range(400):
        good = k % 2
        rows.append((k, " ".join(rng.choice("the river runs past quiet fields and old stone houses".split() if good else "$$$ BUY!!! click >>> 0000 win### x1x".split()) for _ in range(40))))
        labels.append((k, good, 0))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, marks).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [k for k in range(400) if got[k].held_out]
    assert held == [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum((got[k].score >= 0.5) == k % 2 for k in held) >= 0.95 * len(held)
    assert {r.score for r in quality.classify(docs, marks.where("doc_id < 0")).collect()} == {0.5}


def test_languages(spark, empty):
    rng = random.Random(4)
    words = {"en": "the and of house river with that they".split(), "de": "und das nicht haus fluss mit dass sie".split()}
    rows = [(k, " ".join(rng.choice(words["en" if k % 2 else "de"]) for _ in range(rng.randint(3, 30))), "en" if k % 2 else "de") for k in range(200)]
    rows += [(900, None, "en"), (901, "123 !!", "de"), (902, "", None)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {got[k].lang_pred for k in (900, 901, 902)} == {"und"}
    held = [k for k in range(200) if got[k].held_out]
    assert sum(got[k].lang_pred == ("en" if k % 2 else "de") for k in held) >= 0.95 * len(held)
    assert {r.lang_pred for r in language_id.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def test_copies_do_not_fill_the_language_sample(spark, monkeypatch):
    """The sample is the same distinct rows, however often each occurs."""
    seen = []
    monkeypatch.setattr(language_id.Field, "fit", classmethod(lambda cls, texts, labels: seen.append(list(zip(texts, labels, strict=True)))))
    rows = [(f"text {k} of its language", "en" if k % 2 else "de") for k in range(30)]
    for many in (rows, rows * 40, rows + rows[:1] * 3000, rows * 2 + rows[1:2] * 3000):
        language_id.train(spark.createDataFrame(many, "text string, lang string"), sample=12)
    assert len(set(seen[0])) == 12 and all(x == seen[0] for x in seen)


def test_text_without_spaces_is_read_to_its_end():
    rng = random.Random(5)
    words = {"en": "the and of house river with that they".split(), "de": "und das nicht haus fluss mit dass sie".split()}
    say = lambda lang, n, gap="": gap.join(rng.choice(words[lang]) for _ in range(n))
    langs = ["en", "de"] * 60
    field = language_id.Field.fit([say(x, rng.randint(3, 40), rng.choice(["", " "])) for x in langs], langs)
    texts = [say("en", 30) + say("de", 400), say("de", 30) + say("en", 400), say("en", 400) + " und das nicht", say("de", 400) + " the and of"]
    got = field.shares(language_id._runs(pa.array(texts))) if hasattr(language_id, "_runs") else field.shares(language_id.Words(pa.array(texts)))
    assert [field.langs[k] for k in got.argmax(1)] == ["de", "en", "en", "de"]


def test_extraction(spark):
    body = "<p>First &amp; long paragraph of the article, with several words.</p><p>Second  one\n here with <b>bold</b> text.</p>"
    page = f"<html><head><title>t</title></head><body><nav><a>Home</a></nav><div class='post-12'>{body}</div><div id='comments'>bad</div><script>x</script><footer>foot</footer></body></html>"
    rows = [(k, f"http://h{k % 2}.org/{k}", page) for k in range(6)] + [(7, None, None), (8, "x", ""), (9, "http://h0.org/z", "<p>only <b>this")]
    got = {r.page_id: r for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = html.unescape("First &amp; long paragraph of the article, with several words. Second one here with bold text.")
    assert all(got[k].text == want and got[k].n_chars == len(want) for k in range(6))
    assert got[7].text == got[8].text == "" and got[9].text == "only this"


def test_extraction_of_many_layouts(spark):
    """A host of many layouts, common ones and one of a single page: each page's text is that of its own container."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(200)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, want = [], {}
    layouts = ["alpha", "beta"] * 40 + [f"lay{'abcdefghij'[k]}" for k in range(10)] * 3 + ["lonely"]
    for k, name in enumerate(layouts):
        text = say(80)
        rows.append((k, f"http://many.org/{k}", f"<html><body><div class='wrap{name}'><div class='top{name}'>{say(6)}</div><div class='content{name}'><p>{text}</p></div></div></body></html>"))
        want[k] = text
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_deep_pages():
    for depth in (450, 20_000):
        deep = "<div>" * depth
        page = f"<html><body>{deep}<script>if (a < b) x('</div><p>bad</p>')</script><nav>menu</nav><div>inner</div> still{'</div>' * depth}<nav>no</nav></body></html>"
        assert html_extraction.main_text(page) == "inner still"
    # end tags without a start close nothing
    assert html_extraction.main_text("<html><body><div class='top'>x</section></p> last</div></body></html>") == "x last"


def test_what_is_left_out():
    text = "The whole article is here, and it is long enough to be one."
    keep = lambda inner: html_extraction.main_text(f"<html><body>{inner}</body></html>")
    for name in ("content-with-sidebar", "post-notice-board", "share-price", "entry-header", "postContent"):
        assert keep(f"<div class='{name}'><p>{text}</p></div><nav>menu</nav>") == text, name
    assert keep(f"<form><div class='page'><p>{text}</p></div></form><footer>foot</footer>") == text
    remarks = "<div class='comments'>" + "<p>I say so too, and at great length, over and over again.</p>" * 9 + "</div>"
    for extra in (remarks, remarks.replace("comments", "comment-list"), remarks.replace("comments", "article-comments"), "<div id='cookie-banner'>We use them</div>", "<aside>aside</aside>", "<div class='site-footer'>f</div>", "<div role='navigation'>n</div>", "<div hidden>h</div>", "<span class='ad'>buy</span>", "<template>t</template>"):
        assert keep(f"<article><p>{text}</p></article>{extra}") == text, extra
        assert keep(f"<div class='story'><p>{text} {text}</p>{extra}</div>") == f"{text} {text}", extra
    assert keep("<p>foo<img src='x'>bar <picture><source></picture>baz<x-tag>q</x-tag> &lt;&eacute;&#33;</p><p>next<br>line</p>") == "foobar bazq <é! next line"
    assert keep("<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>") == "one two a b"
    assert html_extraction.main_text(None) == html_extraction.main_text("") == html_extraction.main_text("<>") .strip("<>") == ""


def test_a_host_tells_what_repeats(spark):
    """A box without a telling name that is the same on all pages goes; one that differs stays, and so do copies of one page."""
    rng = random.Random(15)
    say = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    rows, want = [], {}
    for k in range(12):
        text, own = say(80), say(9)
        want[k] = f"{text} {own}"
        rows.append((k, f"http://one.org/{k}", f"<html><body><div class='main'><p>{text}</p><div class='boxed'>All rights belong to their owners and so on.</div><div class='extra'>{own}</div></div></body></html>", 1))
    same = f"<html><body><div class='main'><p>{say(80)}</p><div class='boxed'>{say(8)}</div></div></body></html>"
    rows += [(100 + k, f"http://two.org/{k}", same, 1) for k in range(10)] + [(100, "http://two.org/0", same, 1), (None, None, same, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path int")
    got = html_extraction.extract(pages).collect()
    assert {r.page_id: r.text for r in got if r.page_id is not None and r.page_id < 100} == want
    texts = [r.text for r in got if r.page_id is None or r.page_id >= 100]
    assert len(texts) == 12 and len(set(texts)) == 1 and len(texts[0].split()) == 88
    assert html_extraction.extract(pages.where("page_id < 0")).count() == 0


def test_likelihood_and_marginals_by_enumeration():
    """The chain's sums over all paths, and a model's probabilities over all sequences of a length."""
    from itertools import product

    rng = np.random.default_rng(16)
    k, n, m = 3, 5, 4
    model = hmm_lm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(m), k).T)
    whole = 0.0
    for x in product(range(m), repeat=n):
        p = 0.0
        for path in product(range(k), repeat=n + 1):
            q = model.start[path[0]]
            for t in range(n):
                q *= model.trans[path[t], path[t + 1]] * model.emit[x[t], path[t + 1]]
            p += q
        got = float(np.exp(model.chain(np.array(x), np.array([0, n])).log_z[0]))
        assert abs(got - p) < 1e-12
        whole += got
        if sum(x) > 3:
            break
    total = sum(np.exp(model.chain(np.array(list(x)), np.array([0, 3])).log_z[0]) for x in product(range(m), repeat=3))
    assert abs(total - 1) < 1e-9
    e, a, s = rng.uniform(0.1, 1, (4, k)), rng.uniform(0.1, 1, (k, k)), np.full(k, 1 / k)
    gamma, _ = Chain(e, np.array([0, 4]), s, a).posteriors()
    want = np.zeros((4, k))
    for path in product(range(k), repeat=5):
        q = s[path[0]] * np.prod([a[path[t], path[t + 1]] * e[t, path[t + 1]] for t in range(4)])
        for t in range(4):
            want[t, path[t + 1]] += q
    assert np.allclose(gamma, want / want.sum(1, keepdims=True))


def test_network_is_two_layers():
    rng = np.random.default_rng(17)
    x = rng.normal(size=(200, 9))
    net = quality.Network(x, (x[:, 0] > 0).astype(float), epochs=5)
    got = net(x)
    for row, p in zip(x, got, strict=True):
        z = np.clip((row - net.mean) / net.spread, -8, 8)
        hidden = [np.tanh(sum(z[i] * net.p[0][i, j] for i in range(9)) + net.p[1][j]) for j in range(len(net.p[1]))]
        logit = sum(h * w for h, w in zip(hidden, net.p[2], strict=True)) + net.p[3][0]
        assert abs(p - 1 / (1 + np.exp(-logit / net.temperature))) < 1e-9


def test_shapes_run_to_the_end():
    w = quality.Words(pa.array(["a1a1a1a1a1a1a1a1X a1a1a1a1a1a1a1a1- a1a1a1a1a1a1a1a1X"]))
    shapes = quality.tokens(w)[1]
    assert shapes[0] == shapes[2] != shapes[1]


CLASHES = ("k1", "k2", "hits", "places", "rare", "coded", "_row", "_copies", "rank", "row", "h", "n", "held_out", "score", "fp", "root", "ids", "kept", "size", "label")


def test_clashing_columns_and_empty_tables(spark, docs, empty):
    """Extra columns named like columns of the work or of the result change nothing; empty tables give empty ones."""
    few = docs.where("doc_id between 5 and 25")
    extra = few.withColumns({c: F.lit(c) for c in CLASHES})
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    labels = spark.createDataFrame([(k, k % 2, "x") for k in range(5, 26)], "doc_id long, quality int, text string")
    runs = {
        "op2": lambda d: substring_dedup.remove_repeats(d).select("doc_id", "n_words", "n_removed", "kept"),
        "op3": fingerprints.edited_fingerprints,
        "op4": source_mixing.mix,
        "op4 rows": lambda d: source_mixing.mixed(d).select("doc_id", "text", "source"),
        "op5": lambda d: byte_bpe.encode(d, path, public_tokenizers.PATTERN, size=20).select("doc_id", "ids"),
        "op6": lambda d: simhash_dedup.near_duplicates(d).select("doc_id", "fp", "component_id"),
        "op6 rows": lambda d: simhash_dedup.one_of_each(d).select("doc_id", "text"),
        "near copies": lambda d: simhash_dedup.one_of_similar(d).select("doc_id", "text"),
        "op7": hmm_lm.score,
        "op8": lambda d: quality.classify(d, labels).select("doc_id", "held_out", F.round("score", 9)),
        "op9": language_id.identify,
    }
    for name, run in runs.items():
        plain = [(v if not isinstance(v, float) else round(v, 9)) for r in sorted(map(tuple, run(few).collect())) for v in r]
        other = [(v if not isinstance(v, float) else round(v, 9)) for r in sorted(map(tuple, run(extra).collect())) for v in r]
        assert plain == other and plain, name
        assert run(empty).count() == 0, name
    # columns that aren't the result's stay as they are
    kept = source_mixing.mixed(extra)
    assert kept.columns == extra.columns and {r._row for r in kept.collect()} == {"_row"}


def test_repeated_and_long_rows_are_scored_alike(spark):
    long = "the river runs past the house " * 30_000
    rows = [(k, "the house and the river" if k % 2 else "das haus und der fluss", "en" if k % 2 else "de") for k in range(60)] + [(70, long, None), (70, long, None), (71, None, None), (71, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    for found in (language_id.identify(df), quality.classify(df, marks).select("doc_id", "held_out", "score"), hmm_lm.score(df)):
        got = found.collect()
        assert len(got) == len(rows)
        for k in (70, 71):
            assert len({tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in got if r.doc_id == k}) == 1
    assert [r.n_tokens for r in hmm_lm.score(df).where("doc_id = 70").collect()] == [6 * 30_000 + 1] * 2
    assert [r.lang_pred for r in language_id.identify(df).where("doc_id = 70").collect()] == ["en"] * 2


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    a, b, mine, theirs = both(spark, queries.queries()[name], queries.oracle_sql()[name], DATA)
    assert a == b and mine == theirs and mine


def test_pipeline_against_plain_versions(spark):
    """Every stage but the first (a trained model) is made again plainly from what the stage before it kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        kept.append((name, simhash_dedup.staged(stage(spark, kept[-1][1], str(DATA)), "test")))
    found = {name: [tuple(r) for r in df.collect()] for name, df in kept[1:]}
    scores = {r.doc_id: r.score for r in quality.classify(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    everything = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]
    assert sorted(found["quality"]) == sorted(r for r in everything if scores[r[0]] >= 0.5) and len(found["quality"]) > 100
    rows = sorted(found["quality"])
    sets = [plain_shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if not u or len(sets[i] & sets[j]) >= 0.8 * u:
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert sorted(found["near_copies"]) == [r for k, r in enumerate(rows) if find(k) == k]
    plain = {}
    for r, (_, _, gone, digest) in zip(found["near_copies"], plain_repeats(found["near_copies"]), strict=True):
        plain[r[0]] = (gone, digest)
    for r in found["repeats"]:
        gone, digest = plain[r[0]]
        before = next(x for x in found["near_copies"] if x[0] == r[0])
        assert r == before if not gone else (sha(r[1]) == digest and r[4] == len(r[1]) and r[2:4] == before[2:4])
    assert len(found["repeats"]) == len(plain) and any(g for g, _ in plain.values())
    copies = Counter(r[0] for r in found["mix"])
    assert set(found["mix"]) <= set(found["repeats"]) and max(copies.values()) <= 2
    taken = {r.doc_id: r.taken // max(r["size"], 1) for r in source_mixing.mix(kept[3][1]).collect() if r["size"]}
    assert all(copies[k] == c for k, c in taken.items())
    enc = encoding()
    want = sorted((r[0], r[2], r[3], len(ids := enc.encode_ordinary(r[1] or "")), ids) for r in found["mix"])
    assert sorted(found["encode"]) == want
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(DATA)).collect()) == want


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
