"""Splitting by the re module and the order of the codebook."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
import regex

from cinderlake.llm import byte_bpe


@pytest.mark.parametrize("pattern", [public_tokenizers.PATTERN, r" ?\p{L}+|[^\s\p{N}]|\S"])
def test_texts_are_split_as_by_the_regex_library(pattern):
    assert byte_bpe.narrow_pattern(pattern) is not None
    find, plain = byte_bpe.finder(pattern), regex.compile(pattern).findall
    rng = random.Random(5)
    parts = [*map(chr, range(256)), *[" "] * 40, *["  ", "\n", "'s", "'ll", "a", "1", "é"] * 8]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 50))) for _ in range(4000)]
    texts += [a + c + b for c in map(chr, range(256)) for a in ("", " ", "a") for b in ("", " ", "1")]
    # with characters from 256 on, whose classes the spelled-out ones lack
    texts += [t + rng.choice("ā ٣“漢\U0001d49ć") + t for t in texts[:1000]]
    assert all(find(t) == plain(t) for t in texts)


@pytest.mark.parametrize("pattern", [r"\w+", r"(?i:'s)|\s", r"(?i)'s|\s", r"[\S]+", r"\p{Lu}+", r".", r"[a-z]+", r"a{2}", r"(?P<a>b)"])
def test_other_patterns_stay_with_the_regex_library(pattern):
    assert byte_bpe.narrow_pattern(pattern) is None


def test_frequent_words_lead_the_codebook(spark):
    words = [f"w{chr(97 + k)}" for k in range(20)]
    docs = spark.createDataFrame([(w,) for k, w in enumerate(words) for _ in range(k + 1)], "text string").repartition(4)
    ranks = byte_bpe.RankMap(spark, byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    book, ids = byte_bpe.codebook(byte_bpe.frequent_words(docs, public_tokenizers.PATTERN), ranks)
    assert pa.ipc.open_stream(book).read_all().column("x").to_pylist() == words[::-1]
    pieces = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert [b"".join(pieces[k] for k in x).decode() for x in pa.ipc.open_stream(ids).read_all().column("x").to_pylist()] == words[::-1]
