"""Document fingerprints as invertible Bloom lookup sketches, with DataFrame functions only.

A text is cut into paragraphs by its content: lines, and within long lines runs of LEAST words or more up to the end of a
sentence (MOST words at most), so that an inserted word changes the paragraph it is in and few after it. The
distinct paragraphs' digests are thrown into cells that keep a count and the exclusive-or of the digests; a digest holds
its own check in its last bits. The fingerprint is a sketch with a power of two of cells in each third, one third
cell or more per paragraph, and tells of every cell that isn't empty.

Two fingerprints are compared by subtracting them cell by cell, the larger folded to the smaller's size (the sum of
the cells that share the lower bits of their place); what both have cancels. The rest is peeled: a cell with one digest
gives it away, it is taken out of its other cells, and so on. Where peeling gets stuck, both sketches are made again
larger, from the larger text's size on and then four times that and more (RETRIES), with other places. Likeness is one
less the digests that peeling gave over the digests of both texts (1 for two texts without any).

Edge cases: null text is the empty text, whose fingerprint has no cells; a text without line or sentence ends is cut every
MOST words, a text of one word of any length is one paragraph; documents with equal ids are ordered by their text's
hash; of equal rows all but one are followed by themselves; null ids come last; the only document's next one is
itself; an empty table gives an empty one; input columns of other names are left out, and none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import row_keys
from cinderlake.operators.numbering import numbered

#: Words of a paragraph within a line: at least, up to the end of a sentence, and at most.
LEAST, MOST = 24, 96
#: How much larger the sketches of each retry are than the larger text's own.
RETRIES = (1, 4, 16, 64)
#: Rounds of peeling, each of which takes all digests that are alone in a cell; some more than the logarithm of any sketch.
ROUNDS = 60
#: Bits of a digest that check the others.
CHECK = (1 << 20) - 1

_CELL = "array<struct<cell:bigint,cnt:int,key:bigint>>"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digests(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """Distinct digests of a text's paragraphs."""
    word, gap = r"[^\x20\x09-\x0D]++", r"[\x20\x09]++"
    sentence = rf"{word}(?:{gap}{word}){{{least - 1},{most - 1}}}?(?<=[.!?。])(?![^\x20\x09-\x0D])"
    found = F.regexp_extract_all(text, F.lit(rf"{sentence}|{word}(?:{gap}{word}){{0,{most - 1}}}+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: _let(F.xxhash64(p).bitwiseAND(~CHECK), lambda h: h.bitwiseOR(_check(h)))))


def _check(high: Column) -> Column:
    return F.xxhash64(high, F.lit(99)).bitwiseAND(CHECK)


def _thrown(key: Column, cnt: Column, third: Column, seed: int) -> Column:
    """A digest's three cells, one in each third of the sketch; a third's size is a power of two."""
    return F.array(*[F.struct((F.xxhash64(key, F.lit(seed * 3 + j)).bitwiseAND(third - 1) + third * j).alias("cell"), cnt.alias("cnt"), key.alias("key")) for j in range(3)])


def _summed(entries: Column) -> Column:
    """Entries to cells; empty cells vanish."""

    def cells(e: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i == 0) | (F.get(e, i)["cell"] != F.get(e, i - 1)["cell"]))

        def plus(a: Column, x: Column) -> Column:
            return F.struct(a["cell"].alias("cell"), (a["cnt"] + x["cnt"]).alias("cnt"), a["key"].bitwiseXOR(x["key"]).alias("key"))

        def cell(bounds: Column, b: Column, j: Column) -> Column:
            last = F.coalesce(F.get(bounds, j + 1), F.size(e)) - 1
            few = F.when(last == b, F.get(e, b)).when(last == b + 1, plus(F.get(e, b), F.get(e, last)))
            return few.otherwise(F.aggregate(F.slice(e, b + 2, last - b), F.get(e, b), plus))

        whole = _let(first, lambda bounds: F.transform(bounds, lambda b, j: cell(bounds, b, j)))
        return F.filter(whole, lambda c: (c["cnt"] != 0) | (c["key"] != 0))

    return _let(F.sort_array(entries), lambda e: F.when(F.size(e) == 0, e).otherwise(cells(e)))


def third_of(n: Column) -> Column:
    """Cells in a third of the fingerprint of so many digests: the next power of two, four at least."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(4)).cast("double")) - 1e-12)).cast("long")


def sketch(found: Column, third: Column, seed: int = 0) -> Column:
    return _summed(F.flatten(F.transform(found, lambda d: _thrown(d, F.lit(1), third, seed))).cast(_CELL))


def folded(cells: Column, third: Column, small: Column) -> Column:
    """Entries of a smaller sketch: places within a third lose their upper bits; to be summed."""
    place = lambda c: F.floor(c["cell"] / third) * small + c["cell"].bitwiseAND(small - 1)
    return F.when(third == small, cells).otherwise(F.transform(cells, lambda c: F.struct(place(c).alias("cell"), c["cnt"].alias("cnt"), c["key"].alias("key"))))


def subtracted(a: Column, b: Column) -> Column:
    """The difference of two sketches of one size, given as cells or entries."""
    return _summed(F.concat(a, F.transform(b, lambda c: F.struct(c["cell"].alias("cell"), (-c["cnt"]).alias("cnt"), c["key"].alias("key")))))


def peeled(difference: Column, third: Column, seed: int) -> Column:
    """How many digests a difference of sketches holds; null if peeling gets stuck."""

    def step(state: Column, _: Column) -> Column:
        left = state["cells"]
        pure = F.filter(left, lambda c: (F.abs(c["cnt"]) == 1) & (c["key"].bitwiseAND(CHECK) == _check(c["key"].bitwiseAND(~CHECK))))

        def side(cells: Column, n: int) -> Column:
            keys = F.array_distinct(F.transform(F.filter(cells, lambda c: c["cnt"] == n), lambda c: c["key"]))
            return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(n).alias("cnt")))

        lone = _let(pure, lambda cells: F.concat(side(cells, 1), side(cells, -1)))

        def without(p: Column) -> Column:
            rest = _summed(F.concat(left, F.flatten(F.transform(p, lambda x: _thrown(x["key"], -x["cnt"], third, seed)))))
            return F.struct(rest.alias("cells"), (state["got"] + F.size(p)).alias("got"), (F.size(p) == 0).alias("stuck"))

        return F.when(state["stuck"] | (F.size(left) == 0), state).otherwise(_let(lone, without))

    start = F.struct(difference.alias("cells"), F.lit(0).alias("got"), F.lit(False).alias("stuck"))
    return _let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step), lambda end: F.when(F.size(end["cells"]) == 0, end["got"]))


class Fingerprint:
    """Columns of a fingerprint: distinct digests, and the cells of their sketch. The cells are a column of their own in the
    table, as Spark would otherwise make them anew wherever they are used."""

    def __init__(self, found: str, cells: str):
        self.found, self.cells = F.col(found), F.col(cells)
        self.n = F.size(self.found)
        self.third = third_of(self.n)

    def told(self) -> Column:
        """As a string: the number of digests, the cells in a third, and each cell with its count and digests."""
        cells = F.transform(self.cells, lambda c: F.concat(F.hex(c["cell"]), F.lit("."), c["cnt"].cast("string"), F.lit("."), F.hex(c["key"])))
        return F.lower(F.concat_ws("-", self.n.cast("string"), self.third.cast("string"), F.array_join(cells, "-")))


def with_cells(df: DataFrame, **found: str) -> DataFrame:
    """df with the cells of each column of digests, under the given names."""
    return df.withColumns({out: sketch(F.col(c), third_of(F.size(c))) for out, c in found.items()})


def difference(a: Fingerprint, b: Fingerprint) -> Column:
    """Number of digests that only one of two fingerprints has; null if even the largest sketches can't tell."""
    small, large = F.least(a.third, b.third), F.greatest(a.third, b.third)
    own = peeled(subtracted(folded(a.cells, a.third, small), folded(b.cells, b.third, small)), small, 0)
    # what the numbers alone say is too much for the cells needn't be peeled
    tries = [F.when(F.abs(a.n - b.n) <= small * 2, own)]
    for k, r in enumerate(RETRIES):
        tries.append(peeled(subtracted(sketch(a.found, large * r, k + 1), sketch(b.found, large * r, k + 1)), large * r, k + 1))
    return F.coalesce(*tries)


def likeness(a: Fingerprint, b: Fingerprint) -> Column:
    both = a.n + b.n
    # all retries fail once in more than 10**9 pairs; such a pair has no likeness that the sketches can tell
    return F.when(both == 0, F.lit(1.0)).otherwise(1.0 - F.coalesce(difference(a, b), both) / both)


def next_links(light: DataFrame) -> DataFrame:
    """light: doc_id, k1, k2, n, rows, one row for each distinct document. Adds m1, m2: the keys of the document that
    follows by descending doc_id, the first one's after the last."""
    order = numbered(light, F.desc_nulls_last("doc_id"), F.asc("k2"), out="at")
    count = light.agg(F.count("*").alias("count"))  # one row
    after = order.join(F.broadcast(count)).withColumn("next", F.col("at") % F.col("count") + 1)
    ahead = order.select(F.col("at").alias("next"), F.col("k1").alias("m1"), F.col("k2").alias("m2"))
    return after.join(ahead, "next").select("doc_id", "k1", "k2", "n", "rows", "m1", "m2")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """For each row of docs: its fingerprint, that of its text with the last third taken from the next document,
    and the likeness of its own to that and to the next document's."""
    k1, k2 = row_keys()
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), k1.alias("k1"), k2.alias("k2"))
    # equal rows agree in their keys; they are one document until the end
    light = src.select("doc_id", "k1", "k2", F.char_length("text").alias("c")).groupBy("doc_id", "k1", "k2").agg(F.max("c").cast("long").alias("n"), F.count("*").alias("rows"))
    links = next_links(light)
    # both sides below take the same columns, so the texts are shuffled once and read twice
    texts = src.groupBy("k1", "k2").agg(F.max("text").alias("text"))
    ahead = texts.select(F.col("k1").alias("m1"), F.col("k2").alias("m2"), F.col("text").alias("next_text"))
    take = F.floor(F.col("n") / 3).cast("int")
    given = links.join(ahead, ["m1", "m2"]).select("doc_id", "k1", "k2", "rows", F.substring("next_text", F.lit(1), take).alias("head"), digests(F.col("next_text")).alias("next_digests"))
    whole = texts.join(given, ["k1", "k2"])
    n = F.char_length("text")
    kept = F.substring("text", F.lit(1), (n - F.floor(n / 3)).cast("int"))
    # of equal rows, the last is followed by the next document and the others by themselves
    last = F.struct(F.lit(1).cast("long").alias("rows"), F.concat(kept, F.col("head")).alias("edited"), F.col("next_digests").alias("next"))
    others = F.struct((F.col("rows") - 1).alias("rows"), F.concat(kept, F.substring("text", F.lit(1), F.floor(n / 3).cast("int"))).alias("edited"), F.col("own").alias("next"))
    cases = F.explode(F.when(F.col("rows") > 1, F.array(last, others)).otherwise(F.array(last))).alias("case")
    whole = whole.withColumn("own", digests(F.col("text"))).select("doc_id", n.cast("long").alias("n_chars"), "own", cases)
    whole = whole.select("doc_id", "n_chars", "case.rows", F.sha2("case.edited", 256).alias("edited_sha256"), "own", digests(F.col("case.edited")).alias("changed"), F.col("case.next").alias("next"))
    whole = with_cells(whole, own_cells="own", changed_cells="changed", next_cells="next")
    a, b, c = Fingerprint("own", "own_cells"), Fingerprint("changed", "changed_cells"), Fingerprint("next", "next_cells")
    found = whole.select(
        "doc_id", "n_chars", "edited_sha256", a.told().alias("fingerprint"), b.told().alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"), "rows",
    )
    return found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy")).drop("rows", "copy")
