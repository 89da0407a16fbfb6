"""Fill-in-middle transformation by escaped marker injection, with DataFrame functions only.

A delimiter is escaped in the text, so that it occurs nowhere. A regular expression appends it after each unit (a code
point, or whatever the unit's pattern matches from left to right), and the units are counted by counting delimiters. Two
places, drawn from the sha256 of the document's id, cut the units into prefix, middle and suffix: the parts up to a
delimiter's rank are taken by substring_index, lose their delimiters and are unescaped. The parts are put together around
the markers in one of two orders, or the text stays plain: by chance, if it is empty, or if it holds a marker.

A text is rebuilt from its output and form alone (`restored`). The markers begin with a character that they hold once,
so a part's end and a marker's beginning never make another marker.

Edge cases: null text is the empty text; a null id draws as an empty one does; repeated rows come out equal; a text
with delimiters, escapes or code points of any plane comes back as it was; texts of any length are taken whole (the work is
linear in them); an empty table gives an empty one; input columns named like a result's are replaced, others stay as they
are whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import free

#: The delimiter, and the character that escapes it and itself.
DELIMITER, ESCAPE = "\x01", "\x02"
#: Patterns of units over escaped text, in which an escape and the letter after it are one code point.
CHARACTERS = r"(?s)\x02.|[^\x02]"
WORDS = r"[^\s]+\s*|\s+"
LINES = r"[^\n]*\n|[^\n]+"
#: Markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many are cut, and of 100 of these so many begin with their suffix.
RATE, SUFFIX_FIRST = 90, 20


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}e")), F.lit(DELIMITER), F.lit(f"{ESCAPE}d"))


def unescaped(text: Column) -> Column:
    """The text of marked and escaped units."""
    bare = F.replace(text, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(f"{ESCAPE}d"), F.lit(DELIMITER)), F.lit(f"{ESCAPE}e"), F.lit(ESCAPE))


def marked(text: Column, unit: str = CHARACTERS) -> Column:
    """The escaped text with a delimiter after each unit."""
    return F.regexp_replace(escaped(text), unit, f"$0{DELIMITER}")


def _index(text: Column, delimiter: str, count: Column | int) -> Column:
    return F.call_function("substring_index", text, F.lit(delimiter), count if isinstance(count, Column) else F.lit(count))


def draws(doc_id: Column, seed: str) -> Column:
    """Four numbers below 2**32 from the sha256 of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def transform(docs: DataFrame, unit: str = CHARACTERS, markers: tuple[str, str, str] = MARKERS, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = "1") -> DataFrame:
    """docs (doc_id, text and others) with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output."""
    if any(m[:1] in m[1:] or not m for m in markers) or len({m[:1] for m in markers}) != 1 or len(set(markers)) != 3 or any(a != b and a in b for a in markers for b in markers):
        raise ValueError("markers begin with one character that they hold once, and none holds another")
    result = ["n", "form", "prefix_chars", "middle_chars", "output"]
    own = [c for c in docs.columns if c.lower() not in result]
    src = docs.select(*[F.col(f"`{c}`") for c in own])
    names = {c: free(f"_{c}", src) for c in ("text", "marked", "draws", "n", "low", "high", "form", "prefix", "middle", "suffix")}
    t, m, h, n, low, high, form, prefix, middle, suffix = (F.col(x) for x in names.values())
    put = lambda df, **columns: df.withColumns({names[k]: v for k, v in columns.items()})
    # each step is used more than once by the next, so that Spark keeps it apart and takes it once
    df = put(src, text=F.coalesce(F.col("text"), F.lit("")), draws=draws(F.col("doc_id"), seed))
    df = put(df, marked=marked(t, unit))
    # characters less those without delimiters are the delimiters
    df = put(df, n=(F.char_length(m) - F.char_length(F.replace(m, F.lit(DELIMITER), F.lit("")))).cast("long"))
    places = [h[k] % (n + 1) for k in (0, 1)]
    plain = (n == 0) | (h[2] % 100 >= rate)
    for x in markers:
        plain = plain | F.contains(t, F.lit(x))
    df = put(df, low=F.least(*places).cast("int"), high=F.greatest(*places).cast("int"), form=F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm"))
    # after the last delimiter stands an empty part
    df = put(
        df.withColumn(names["draws"], F.lit(None)),
        prefix=F.when(form != "plain", unescaped(_index(m, DELIMITER, low))),
        middle=F.when(form != "plain", unescaped(_index(_index(m, DELIMITER, high), DELIMITER, low - high))),
        suffix=F.when(form != "plain", unescaped(_index(m, DELIMITER, (high - n - 1).cast("int")))),
    )
    p, s, mid = (F.lit(x) for x in markers)
    output = F.when(form == "psm", F.concat(p, prefix, s, suffix, mid, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, mid, middle)).otherwise(t)
    lengths = [F.char_length(x).cast("long") for x in (prefix, middle)]
    return df.select(*[F.col(f"`{c}`") for c in own], n.alias("n"), form.alias("form"), lengths[0].alias("prefix_chars"), lengths[1].alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of."""
    p, s, m = markers

    def after(text: Column, marker: str) -> Column:
        # the first marker of its kind is the one that was put there, as the text holds none
        return _index(text, marker, -1)

    first = {"psm": (p, s), "spm": (s, p)}

    def rebuilt(kind: str) -> Column:
        one, two = first[kind]
        ahead, middle = _index(output, m, 1), after(output, m)
        head, tail = after(_index(ahead, two, 1), one), after(ahead, two)
        return F.concat(head, middle, tail) if kind == "psm" else F.concat(tail, middle, head)

    return F.when(form == "psm", rebuilt("psm")).when(form == "spm", rebuilt("spm")).otherwise(output)
