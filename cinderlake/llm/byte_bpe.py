"""Byte-level BPE encoding and decoding.

Texts are split by the tokenizer's pattern. Words are counted over all texts, and Spark higher-order functions
encode each distinct word: the word's bytes become an array of pieces, and a fold merges the leftmost pair of lowest
rank until none is left. The ranks are a literal of the running plan: an array of small maps, indexed by the pair, so that a
lookup costs the same for any vocabulary. The most frequent words, `codebook` at most, are encoded once and sent to all tasks
with their ids, a table of bounded size; the others are as rare as the text is long, and are folded where they stand, by
the same functions, as joining them back would move texts between machines. Decoding concatenates the ids' byte pieces.

A fold is quadratic in what it merges, so a long word is folded in windows. A window's pieces count up to a place some
bytes before its end, where the next window starts. Pieces are the fold of the whole word exactly if each pair of
neighbours folds to itself (a property of ranked merges), so the pair at each seam is folded too: if it changes, the
piece before the seam is taken back and its bytes go into the next window. Should that not come to an end, the word is
folded whole. Time is in proportion to the word's length.

Edge cases: null text is the empty text; repeated rows are encoded each; special tokens are ordinary text; very long texts
and words are encoded whole; an empty table gives an empty one; an input column named like a result column is replaced,
others stay as they are whatever their names. Words are counted with the Java runtime's Unicode tables and
encoded with those of the `regex` library; where these differ, only the codebook's choice of words does. Texts of characters
below 256 are split by the `re` module, which is faster there, with the `regex` library's classes spelled out.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.llm.common import free, give_back, most_frequent, released, slices, small_batches, staged

#: Words whose encoding is broadcast: 40 MB at most, as longer words than LONGEST bytes are left out.
CODEBOOK = 1 << 19
LONGEST = 48
#: Tokens that one vectorised step takes.
STEP = 250_000
#: Bytes of text that one look-up takes.
SLICE = 1 << 20

#: Longer words, in bytes, are folded in windows, whose last MARGIN bytes may still change.
WINDOW = 384
MARGIN = 128

_BUCKETS = 1 << 14
#: A packed piece: 20 bits of rank, 23 of place and 20 of id.
_RANK_AT, _PLACE_AT = 43, 20
_NONE = (1 << 20) - 1
_ID = (1 << _PLACE_AT) - 1
_PLACE = (1 << _RANK_AT) - (1 << _PLACE_AT)
_SPACE = r"\x09-\x0D\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def read_ranks(path: str) -> list[bytes]:
    """The byte pieces of a rank file, by id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    out = [b""] * (max(ranks.values()) + 1)
    for piece, k in ranks.items():
        out[k] = piece
    return out


def java_pattern(pattern: str) -> str:
    r"""The pattern with \s and \S as Unicode white space, which Java takes as ASCII only."""
    return pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")


def narrow_pattern(pattern: str) -> str | None:
    r"""The pattern for the re module, the same on texts of characters below 256; none if it holds more than literals, groups
    and the classes \p{L}, \p{N}, \s and, outside of brackets, \S."""
    latin = "".join(map(chr, range(256)))
    members = {c: "".join(f"\\x{ord(x):02x}" for x in regex.findall(c, latin)) for c in (r"\p{L}", r"\p{N}", r"\s")}
    known = r"\\p\{[LN]\}|\\s"
    if not re.fullmatch(rf"(?:\[\^?(?:{known}|[A-Za-z0-9 '])+\]|{known}|\\S|\((?:\?[:=!]|(?!\?))|[)|?+*]|[A-Za-z0-9 '])*", pattern):
        return None

    def spelled(m: re.Match) -> str:
        inner = re.sub(known, lambda c: members[c.group()], m.group())
        if m.group() == r"\S":
            return f"[^{members[r'\s']}]"
        return inner if m.group()[0] == "[" else f"[{inner}]"

    return re.sub(rf"\[[^\]]*\]|{known}|\\S", spelled, pattern)


def finder(pattern: str) -> Callable[[str], list[str]]:
    """What lists a text's words."""
    wide, spelled = regex.compile(pattern).findall, narrow_pattern(pattern)
    if spelled is None:
        return wide
    narrow = re.compile(spelled).findall

    def find(text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return wide(text)
        return narrow(text)

    return find


def split_words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


class RankMap:
    """The merge ranks as a literal for Spark expressions: the value of a scalar subquery over a table of one row, so that a task
    gets it as a constant and the texts of plans, which the driver keeps, don't spell it out."""

    def __init__(self, spark: SparkSession, pieces: list[bytes]):
        rank = {p: k for k, p in enumerate(pieces)}
        # three or so pairs a bucket: the literal is an object per bucket in every plan and task that encodes
        # the buckets as text from the start: as many small dicts would weigh tens of MB
        buckets = [""] * _BUCKETS
        for piece, k in rank.items():
            for cut in range(1, len(piece)):
                a, b = rank.get(piece[:cut]), rank.get(piece[cut:])
                if a is not None and b is not None:
                    at = (a * 40503 + b) & (_BUCKETS - 1)
                    buckets[at] += f',"{a << 32 | b}":{k}'
        text = ",".join(["{" + x[1:] + "}" for x in buckets])
        first = json.dumps([rank[bytes([k])] for k in range(256)])
        table = spark.createDataFrame([(f"[{text}]", first)], "merges string, first string")
        merges = F.from_json("merges", "array<map<string,int>>").cast("array<map<bigint,int>>")
        self._table = staged(table.select(merges.alias("merges"), F.from_json("first", "array<bigint>").alias("first")), "ranks")
        # a margin and the window before it hold two pieces at least
        self._margin = MARGIN
        self._window = max(WINDOW, self._margin + 2 * max(map(len, pieces)) + 1)

    def encode(self, df: DataFrame, words: str, out: str) -> DataFrame:
        """df with the ids of each word of an array, in its place: a fold over the word's bytes.

        The state is an array of longs, one per piece: the rank of the merge with the next piece, the place of the
        piece's first byte and its id. So the least element is the leftmost pair of lowest rank. Both tables are
        bound once, so that a task gets one copy of them."""
        m, b = free("merges", df), free("first", df)
        # columns that are used once, which Spark puts where they are used
        bound = df.withColumns({m: self._table.select("merges").scalar(), b: self._table.select("first").scalar()})
        ids = _let(F.col(m), lambda merges: _let(F.col(b), lambda first: F.transform(F.col(words), lambda w: _word(w, merges, first, self._window, self._margin))))
        return bound.select(*[ids.alias(out) if c == words else F.col(f"`{c}`") for c in df.columns])


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ids(pieces: Column) -> Column:
    return F.transform(pieces, lambda e: e.bitwiseAND(_ID).cast("int"))


def _word(word: Column, merges: Column, first: Column, window: int, margin: int) -> Column:
    raw = F.encode(word, "UTF-8")
    whole = _ids(_fold(raw, merges, first))
    return F.when(F.octet_length(word) <= window, whole).otherwise(_let(_long(raw, merges, first, window, margin), lambda ids: F.when(F.size(ids) == 0, whole).otherwise(ids)))


def _long(raw: Column, merges: Column, first: Column, window: int, margin: int) -> Column:
    """The ids of a long word, from windows with folded seams; none if the windows didn't reach the end.

    The state is the number of bytes done and an array of each window's pieces, packed as length and id."""
    n = F.octet_length(raw)
    place = lambda e: F.shiftright(e.bitwiseAND(_PLACE), _PLACE_AT).cast("int")
    length = lambda e: F.shiftright(e, _PLACE_AT).cast("int")

    def step(state: Column, _: Column) -> Column:
        at, parts = state["at"], state["parts"]

        def added(pieces: Column) -> Column:
            last = n - at <= window
            # pieces that end before the margin
            count = F.when(last, F.size(pieces)).otherwise(F.size(F.filter(pieces, lambda e: place(e) <= window - margin)) - 1)
            end = F.when(last, n - at).otherwise(place(F.get(pieces, count)))
            after = lambda i: F.when(i + 1 == count, end).otherwise(place(F.get(pieces, i + 1)))
            kept = F.transform(F.slice(pieces, F.lit(1), count), lambda e, i: F.shiftleft((after(i) - place(e)).cast("long"), _PLACE_AT) + e.bitwiseAND(_ID))
            return _let(kept, lambda own: seam(own, end))

        def seam(own: Column, end: Column) -> Column:
            joined = F.struct((at + end).alias("at"), F.concat(parts, F.array(own)).alias("parts"))

            def checked(before: Column) -> Column:
                x, y = F.element_at(before, -1), F.get(own, F.lit(0))
                pair = _ids(_fold(F.substring(raw, at - length(x) + 1, length(x) + length(y)), merges, first))
                fine = pair == F.array(x.bitwiseAND(_ID).cast("int"), y.bitwiseAND(_ID).cast("int"))
                shorter = F.slice(before, F.lit(1), F.size(before) - 1)
                rest = F.slice(parts, F.lit(1), F.size(parts) - 1)
                back = F.when(F.size(before) == 1, rest).otherwise(F.concat(rest, F.array(shorter)))
                return F.when(fine, joined).otherwise(F.struct((at - length(x)).alias("at"), back.alias("parts")))

            return F.when(F.size(parts) == 0, joined).otherwise(_let(F.element_at(parts, -1), checked))

        return F.when(at >= n, state).otherwise(_let(_fold(F.substring(raw, at + 1, F.lit(window)), merges, first), added))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<bigint>>").alias("parts"))
    steps = F.sequence(F.lit(1), F.ceil(n / (window - 2 * margin)).cast("int") * 2 + 16)
    end = F.aggregate(steps, start, step)
    return _let(end, lambda s: F.when(s["at"] >= n, _ids(F.flatten(s["parts"]))).otherwise(F.array().cast("array<int>")))


def _fold(raw: Column, merges: Column, first: Column) -> Column:
    """The pieces of some bytes, packed."""

    def rank(a: Column, b: Column) -> Column:
        """The id of a pair's merge, which is its rank too, in the place of a packed piece's rank."""
        small = F.get(merges, (a * 40503 + b).bitwiseAND(_BUCKETS - 1).cast("int"))
        return F.shiftleft(F.coalesce(F.element_at(small, F.shiftleft(a, 32) + b), F.lit(_NONE)).cast("long"), _RANK_AT)

    def start(chars: Column) -> Column:
        ids = F.transform(F.sequence(F.lit(1), F.length(chars)), lambda i: F.get(first, F.ascii(F.substr(chars, i, F.lit(1)))))
        return _let(ids, lambda x: F.transform(x, lambda a, i: rank(a, F.get(x, i + 1)) + F.shiftleft(i.cast("long"), _PLACE_AT) + a))

    def merge(state: Column, _: Column) -> Column:
        def done(least: Column, p: Column) -> Column:
            made, before = F.shiftright(least, _RANK_AT), F.get(state, p - 2)
            rest = rank(made, F.get(state, p + 1).bitwiseAND(_ID)) + least.bitwiseAND(_PLACE) + made
            last = rank(before.bitwiseAND(_ID), made) + before.bitwiseAND(_PLACE + _ID)
            return F.when(p == 1, F.concat(F.array(rest), F.slice(state, 3, F.size(state)))).otherwise(F.concat(F.slice(state, F.lit(1), p - 2), F.array(last, rest), F.slice(state, p + 2, F.size(state))))

        one = lambda least: F.when(least >= _NONE << _RANK_AT, state).otherwise(_let(F.array_position(state, least).cast("int"), lambda p: done(least, p)))
        return _let(F.array_min(state), one)

    chars = F.decode(raw, "ISO-8859-1")
    return _let(chars, lambda c: F.when(F.length(c) == 0, F.array().cast("array<bigint>")).otherwise(F.aggregate(F.slice(F.sequence(F.lit(1), F.length(c)), F.lit(2), F.length(c)), start(c), merge)))


def word_counts(docs: DataFrame, pattern: str) -> DataFrame:
    """Rows (word, n) over all texts."""
    return docs.select(F.explode(split_words(F.col("text"), pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def frequent_words(docs: DataFrame, pattern: str, size: int = CODEBOOK) -> DataFrame:
    """The most frequent words of LONGEST bytes at most and their counts, as a table: so plans with the rank map stay of one stage."""
    counts = staged(word_counts(docs, pattern).where(F.octet_length("word") <= LONGEST), "counts")
    top = most_frequent(counts, size)
    return staged(top.repartition(docs.sparkSession.sparkContext.defaultParallelism * 4), "words")


def _stream(column: pa.ChunkedArray) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({"x": column.combine_chunks()})
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def codebook(words: DataFrame, ranks: RankMap) -> tuple[bytes, bytes]:
    """Words and their ids as Arrow streams; bounded by the number of words and by LONGEST bytes of each.

    The most frequent words come first, so that what most look-ups touch lies close together in memory."""
    book = ranks.encode(words.select("word", "n", F.array("word").alias("alone")), "alone", "ids").select("word", "n", F.get("ids", F.lit(0)).alias("ids")).toArrow()
    book = book.take(np.argsort(-book.column("n").to_numpy(), kind="stable"))
    return _stream(book.column("word")), _stream(book.column("ids"))


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of start[k] .. start[k] + size[k] for all k, one after another."""
    size = size.astype(np.int32)
    first = np.cumsum(size, dtype=np.int32) - size
    return np.repeat(start.astype(np.int32) - first, size) + np.arange(int(size.sum()), dtype=np.int32)


def _steps(lists: pa.Array) -> Iterator[tuple[int, int]]:
    total = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    at, n = 0, len(lists)
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + STEP, side="right")) - 1)
        yield at, to - at
        at = to


def _look_up(shared, others: list[str], pattern: str, made: list[str]):
    """Each word's place in the codebook; other words get -1 and are listed."""
    state: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not state:
                words = pa.ipc.open_stream(shared.value[0]).read_all().column("x").to_pylist()
                state["place"] = dict(zip(words, range(len(words)), strict=True)).get
                state["find"] = finder(pattern)
            place, find = state["place"], state["find"]
            for b in slices(whole, "text", SLICE):
                flat, size, rare, n_rare = [], [0], [], [0]
                for text in b.column("text").to_pylist():
                    words = find(text or "")
                    own = np.fromiter(map(place, words, repeat(-1)), np.int32, len(words))
                    far = np.flatnonzero(own < 0)
                    rare += [words[k] for k in far]
                    flat.append(own)
                    size.append(len(own))
                    n_rare.append(len(far))
                edges = lambda x: pa.array(np.cumsum(x).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in others], pa.ListArray.from_arrays(edges(size), pa.array(np.concatenate(flat))), pa.ListArray.from_arrays(edges(n_rare), pa.array(rare, pa.string()))],
                    names=[*others, *made],
                )
        state.clear()  # before the worker, which waits for further tasks, gives memory back

    return run


def _assemble(shared, others: list[str], pieces: list[bytes], digests: bool, places: str, coded: str):
    state: dict = {}

    def set_up() -> None:
        t = pa.ipc.open_stream(shared.value[0]).read_all().column("x").combine_chunks()
        state["ids"], state["size"] = t.flatten().to_numpy(), t.value_lengths().to_numpy().astype(np.int64)
        digits = [f"{k} ".encode() for k in range(len(pieces))]
        for name, table in (("text", digits), ("piece", pieces)):
            state[name] = np.frombuffer(b"".join(table), np.uint8)
            state[f"{name}_size"] = np.array([len(x) for x in table], np.int64)
            state[f"{name}_start"] = np.cumsum(state[f"{name}_size"]) - state[f"{name}_size"]

    def spelled(name: str, ids: np.ndarray, first: np.ndarray) -> tuple[memoryview, np.ndarray]:
        size = state[f"{name}_size"][ids]
        out = state[name][_ragged(state[f"{name}_start"][ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[first]
        return memoryview(out.tobytes()), ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not state:
                set_up()
            for at, n in _steps(whole.column(places)):
                b = whole.slice(at, n)
                lists, rare = b.column(places), b.column(coded).flatten()
                place = lists.flatten().to_numpy().astype(np.int64)
                known = len(state["size"])
                place = np.where(place < 0, known - 1 + np.cumsum(place < 0), place)
                size = np.concatenate([state["size"], rare.value_lengths().to_numpy()])
                ids = np.concatenate([state["ids"], rare.flatten().to_numpy()])
                start = np.cumsum(size) - size
                flat = ids[_ragged(start[place], size[place])]
                per_word = np.concatenate([[0], np.cumsum(size[place])])
                first = per_word[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])]
                out = [b.column(c) for c in others]
                if digests:
                    written, we = spelled("text", flat, first)
                    decoded, de = spelled("piece", flat, first)
                    a = [hashlib.sha256(written[we[k] : max(we[k], we[k + 1] - 1)]).hexdigest() for k in range(n)]
                    d = [hashlib.sha256(decoded[de[k] : de[k + 1]]).hexdigest() for k in range(n)]
                    out += [np.diff(first), pa.array(a), pa.array(d)]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    out += [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat.astype(np.int32)))]
                    names = ["ids"]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names=[*others, *names])
        state.clear()

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, size: int = CODEBOOK, digests: bool = False) -> DataFrame:
    """docs with `ids`, the token ids of its text.

    With digests=True the text and ids give way to n_tokens, ids_sha256 (of the decimal ids, joined by one space)
    and decoded_sha256 (of the bytes that the ids decode to)."""
    spark = docs.sparkSession
    small_batches(spark)
    made = {"ids"} | ({"n_tokens", "ids_sha256", "decoded_sha256"} if digests else set())
    src = docs.select(*[c for c in docs.columns if c not in made])
    words = frequent_words(src.select("text"), pattern, size)
    pieces = read_ranks(ranks_path)
    ranks = RankMap(spark, pieces)
    book, ids = (spark.sparkContext.broadcast([x]) for x in codebook(words, ranks))
    give_back()
    kept = [f for f in src.schema if not (digests and f.name == "text")]
    others = [f.name for f in kept]
    places, rare, coded = free("places", src), free("rare", src), free("coded", src)
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    found = src.mapInArrow(released(_look_up(book, others, pattern, [places, rare])), f"{ddl}`{places}` array<int>, `{rare}` array<string>")
    folded = ranks.encode(found, rare, coded)
    result = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return folded.mapInArrow(released(_assemble(ids, others, pieces, digests, places, coded)), ddl + result)


def decode(coded: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """coded with the bytes of its ids, as a string: the ids' pieces, concatenated."""
    pieces = F.from_json(F.lit(json.dumps([p.hex() for p in read_ranks(ranks_path)])), "array<string>")
    return coded.withColumn(out, F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")), "UTF-8"))
