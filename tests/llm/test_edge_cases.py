"""Cases that once gave wrong results: names and attributes of pages, words that a weak hash takes for one, samples full of copies."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cinderlake.llm import common, html_extraction, language_id, quality, simhash_dedup, substring_dedup
from cinderlake.llm.common import Words, gram_hashes
from tests.llm.test_operators import plain_repeats

PAGE = "page_id long, url string, html string"


def article(k, open_tag="<article>", close="</article>", rest=""):
    rng = random.Random(k)
    say = lambda n: " ".join(rng.choice(["ember", "slope", "river", "ridge", "cedar", "smoke", "field"]) + str(rng.randrange(900)) for _ in range(n))
    parts = [say(40) for _ in range(4)]
    body = "".join(f"<p>{p}</p>" for p in parts)
    menu = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul></nav>"
    return f"<html><body>{menu}{open_tag}{body}{close}{rest}<footer>All rights</footer></body></html>", " ".join(parts)


OPEN = [
    ("<article data-title='The hidden city'>", "</article>"), ("<article data-hidden='false'>", "</article>"), ("<article data-kind-id='comments'>", "</article>"),
    ("<div data-role='navigation' data-class='ad' data-style='display:none'>", "</div>"), ("<div title=\"class='comments'\">", "</div>"), ("<div class='post sponsored'>", "</div>"),
    ("<div class='promo'>", "</div>"), ("<div class='article-comments'>", "</div>"), ("<section id='consent-form'>", "</section>"), ("<div class='respond'>", "</div>"),
    ("<div class='subscribe'><div class='ads'>", "</div></div>"), ("<div class=story id=main-ad>", "</div>"), ("<div class='post' class='ads'>", "</div>"),
]


@pytest.mark.parametrize("case", range(len(OPEN)))
def test_names_and_values_never_empty_a_page(spark, case):
    pages = [article(k, *OPEN[case]) for k in range(8)]
    rows = [(k, f"https://h{case}.example/{k}", p) for k, (p, _) in enumerate(pages)] + [(100, None, pages[0][0])]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {**{k: text for k, (_, text) in enumerate(pages)}, 100: pages[0][1]}


def test_remarks_and_adverts_still_go(spark):
    say = lambda k, n: " ".join(f"reply{k}x{j}" for j in range(n))
    pages = []
    for k in range(8):
        remarks = "".join(f"<div class='comment'><p>{say(k * 100 + j, 30)}</p></div>" for j in range(12 if k % 2 else 3))
        rest = f"<div class='ad-box'>Buy now {k}</div><section class='comments'>{remarks}</section><p title='hidden gems' data-id='ads'>Last words {k}</p>"
        page, text = article(k, "<div class='story'>", "</div>", "")
        page = page.replace("</div>", f"{rest}</div>", 1)
        pages.append((page, f"{text} Last words {k}"))
    rows = [(k, "https://r.example/x", p) for k, (p, _) in enumerate(pages)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {k: text for k, (_, text) in enumerate(pages)}
    assert html_extraction.main_text(pages[1][0]) == pages[1][1]


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [1024, 4096, 65536])
def test_words_of_one_form_stay_apart(spark, size):
    one, two = thue_morse(size)
    h = Words(pa.array([one, two])).hashes()
    assert h[0] != h[1]
    rows = [(k, " ".join(w if j == 17 else f"w{j}" for j in range(35))) for k, w in enumerate((one, two))] + [(2, " ".join(f"v{j}" for j in range(40)))] * 2
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(plain_repeats(rows))
    sets, first = simhash_dedup.shingle_sets(pa.array([one, two]), 5)
    assert len(set(sets.tolist())) == 2 and first.tolist() == [0, 1, 2]
    # sequences of words of that form as well
    seq = np.array([[11, 12][c == "b"] for c in one], np.uint64), np.array([[11, 12][c == "b"] for c in two], np.uint64)
    whole = [gram_hashes(common.mixed(s), np.array([0]), np.array([size]))[0] for s in seq]
    assert whole[0] != whole[1]


def test_range_hashes_are_the_polynomial(monkeypatch):
    rng = np.random.default_rng(1)
    plain = lambda v, s, e: sum(int(x) * pow(common._BASE, k, common.PRIME) for k, x in enumerate(v[s:e])) % common.PRIME
    start = rng.integers(0, 250, 60)
    end = start + rng.integers(0, 250, 60)
    for values, longest in ((rng.integers(0, 1 << 64, 500, dtype=np.uint64), 1 << 22), (rng.integers(0, 1000, 500, dtype=np.uint64), 1 << 22), (rng.integers(0, 1000, 500, dtype=np.uint64), 10)):
        monkeypatch.setattr(common, "SMALL_RANGE", longest)
        assert [int(x) for x in common._ranges(values, start, end)] == [plain(values, s, e) for s, e in zip(start, end, strict=True)]
    assert len(common._ranges(np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))) == 0


def labelled(n=60):
    rng = random.Random(7)
    rows, labels = [], []
    for k in range(n):
        good = k % 2
        words = ["calm", "valley", "north", "stone"] if good else ["BUY!!", "$$$", "click|", "###"]
        rows.append((k, " ".join(rng.choice(words) for _ in range(rng.randint(20, 60)))))
        labels.append((k, good))
    return rows, labels


def test_copies_of_a_label_change_no_score(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = spark.createDataFrame(labels, "doc_id long, quality int")
    many = few.union(few.where("doc_id = 2").crossJoin(spark.range(60_000)).select("doc_id", "quality"))
    score = lambda la: sorted((r.doc_id, r.score) for r in quality.classify(docs, la, sample=200).collect())
    plain = score(few)
    assert score(many) == plain
    assert all((s > 0.5) == bool(k % 2) for k, s in plain)


def test_rows_of_one_id_are_bounded_and_one_class_does(spark):
    rows, labels = labelled()
    same = spark.createDataFrame(rows + [(3, f"calm valley {k}") for k in range(500)], "doc_id long, text string")
    few = spark.createDataFrame(labels, "doc_id long, quality int")
    found = quality.classify(same, few, sample=50).collect()
    assert len(found) == 560 and all(0 <= r.score <= 1 for r in found)
    good = quality.classify(same, few.where("quality = 1"), sample=50).collect()
    assert len(good) == 560 and min(r.score for r in good) > 0.5
    # labels of two texts, and of one: nothing is left for the temperature, which stays near 1
    for n in (1, 2):
        assert len(quality.classify(same, few.limit(n)).collect()) == 560


def test_long_texts_are_learned_from(spark):
    rng = random.Random(3)
    words = {"aa": ["ka", "mo", "tiri", "palo"], "bb": ["strung", "welch", "drift", "knorp"]}
    rows = [(k, (text := " ".join(rng.choice(words["aa" if k % 2 else "bb"]) for _ in range(6000))), "aa" if k % 2 else "bb") for k in range(40)]
    assert min(len(t) for _, t, _ in rows) > language_id.RUN
    got = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {k: lang for k, _, lang in rows}
