"""Main text of web pages by consensus of host paths.

Each page's containers are scored by the text they hold outside links; a container is told by its path, the tags
from the root down, with their classes generalised (digits and case dropped). The best containers of each page
vote for their paths; votes are averaged in Spark over the pages of a host that have the path, and each page is
extracted again below that of its own paths which has the highest average, else by its own best container. All paths
that were voted for count; pages meet them by a join of path keys, so that no host's paths are gathered in one row.

What is left out below the chosen container is put to the host's pages too. Elements of the kinds that HTML has for it
(menus, footers, forms, scripts and so on) go. For others, the words of their class and id are one sign, the share of
the page's text that the path holds on the host's pages, how much of it is links, and whether the text is the same on
different pages are the others (`dropped_paths` has the rule). Forms, headers and the like that hold most of a page's
text stay, and so do elements whose names speak of adverts while they hold most of it, or of remarks while next to nothing
would be left without them (`Page.weigh_marks`). Names never empty a page: where almost nothing is left, the page gives its own
best container by kinds of elements alone.

Character references are decoded, white space within a block becomes one space and blocks are joined by one space, in
page order; unknown elements and images don't end a block.

Edge cases: null html gives the empty text; tags left open are closed by their parents; elements may be nested to any depth,
and pages may be of any length (the work is linear in it); repeated rows are extracted each; pages without a host vote
by themselves under an empty host, and so do those with a null url; of equal votes the page's own larger share wins; an
empty table gives an empty one; extra columns are left out, and none can clash.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import released, slices, staged

#: Containers of a page that vote.
VOTES = 3

# fixed values: element kinds of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("article main section div td body html".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# fixed values: what isn't main text by its kind; the second line may hold a whole page, and stays where it does
BOILERPLATE_TAGS = frozenset("nav footer script style noscript template head title iframe button select textarea svg math menu".split())
WRAPPING_TAGS = frozenset("header aside form dialog".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# fixed values: words of class and id. A name of REMARK words, alone or beside others of these lists, tells of readers' remarks
# and adverts; one of FRAME words and NEUTRAL ones only, of a page's frame; other names with such a word are a hint only
READER_WORDS = frozenset("comment comments respond replies disqus".split())
REMARK_WORDS = READER_WORDS | frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr newsletter subscribe".split())
FRAME_WORDS = frozenset(
    "promotion banner notice popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot sidebar aside widget related recommended "
    "share sharing social subscription signup login pager pagination toolbar skip".split()
)
NEUTRAL_WORDS = frozenset("area bar block box bottom button buttons center col column container fixed form global group holder inner item items left links list main outer page panel right row section site slot sticky text thread title top unit wrap wrapper".split())
ARTICLE_WORDS = frozenset("article blog body content entry post posts story".split())
LISTS = frozenset("ul ol dl table".split())

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
# one attribute after another, so that a name is a whole name and nothing inside a value is one
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?|["'=/]""")
#: A page's text is almost gone with fewer characters than this and less than a tenth of it.
ALMOST_GONE = 200
_WORDS = re.compile(r"[A-Za-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
_SPACE = re.compile(r"\s+")

_TELLING = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style"))
#: What the names of an element say: nothing, a hint, a page's frame, readers' remarks or adverts.
NOTHING, HINT, FRAME, REMARK = range(4)
#: Kinds of elements by tag, role and style.
PLAIN, WRAPPING, BOILERPLATE, HIDDEN = range(4)


class Node:
    __slots__ = ("tag", "key", "parent", "kind", "mark", "readers", "linked", "begin", "end", "out")

    def __init__(self, tag: str, key: int, parent: Node | None, kind: int, mark: int, readers: bool, begin: int):
        self.tag, self.key, self.parent, self.kind, self.mark, self.readers, self.begin, self.end = tag, key, parent, kind, mark, readers, begin, -1
        self.linked = tag == "a" or parent is not None and parent.linked
        self.out = False


def path_key(label: str, parent: int = 0) -> int:
    """A path's 64-bit hash, from its parent's and its last label, as a signed number."""
    return int.from_bytes(xxhash.xxh3_64_digest(label.encode("utf-8", "surrogatepass"), parent & (1 << 64) - 1), "big", signed=True)


def name_mark(name: str) -> int:
    """What one name of a class or id says."""
    words = [w.lower() for w in _WORDS.findall(_HUMP.sub(" ", name))]
    known = REMARK_WORDS | FRAME_WORDS
    if known.isdisjoint(words):
        return NOTHING
    if words[-1] in REMARK_WORDS and all(w in known or w in NEUTRAL_WORDS or w in ARTICLE_WORDS for w in words):
        return REMARK
    if all(w in known or w in NEUTRAL_WORDS for w in words):
        return FRAME if REMARK_WORDS.isdisjoint(words) else REMARK
    return HINT


def _open(tag: str, attrs: str, parent: Node, begin: int) -> Node:
    kind = BOILERPLATE if tag in BOILERPLATE_TAGS else WRAPPING if tag in WRAPPING_TAGS else PLAIN
    mark, label, readers = NOTHING, tag, False
    if attrs and not attrs.isspace():
        seen = set()
        for m in _ATTR.finditer(attrs):
            name, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
            # of attributes with one name the first counts
            if name not in _TELLING or name in seen:
                continue
            seen.add(name)
            if name in ("class", "id"):
                marks = {x: name_mark(x) for x in value.split()}
                mark = max([mark, *marks.values()])
                readers = readers or any(v == REMARK and not READER_WORDS.isdisjoint(w.lower() for w in _WORDS.findall(_HUMP.sub(" ", x))) for x, v in marks.items())
                own = {w.lower() for w in _WORDS.findall(_HUMP.sub(" ", value))} if name == "class" else ()
                if own:
                    label = f"{tag}.{'-'.join(sorted(own))}"
            elif name == "role":
                kind = max(kind, WRAPPING if value.strip().lower() in BOILERPLATE_ROLES else PLAIN)
            elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
                kind = HIDDEN
            elif name == "style" and "display:none" in value.replace(" ", "").lower():
                kind = HIDDEN
        if tag in ("html", "body", "article", "main"):
            mark = NOTHING
    return Node(tag, path_key(label, parent.key), parent, kind, mark, readers, begin)


class Page:
    """A page's elements in order, each after its parent, and its texts: (element, text), or None at a block's border."""

    def __init__(self, page: str):
        self.root = Node("", 0, None, PLAIN, NOTHING, False, 0)
        self.nodes: list[Node] = [self.root]
        self.pieces: list[tuple[Node, str] | None] = []
        self._parse(page)
        for node in self.nodes:
            if node.end < 0:
                node.end = len(self.pieces)
        if any(node.mark == REMARK for node in self.nodes):
            self.weigh_marks()

    def weigh_marks(self) -> None:
        """Names of adverts are a hint only on an element with most of the page's text, as an advert doesn't hold it. Names of
        readers' remarks are one on such an element with the page's first heading, and on the largest element of the kind if
        almost nothing would be left without them all."""
        text = self.plain_text(lambda node: node.kind >= BOILERPLATE)
        size = lambda node: text[node.end] - text[node.begin]
        frame = {id(node) for node in self.nodes if node.mark == FRAME and 2 * size(node) <= text[-1]}
        text = self.plain_text(lambda node: node.kind >= BOILERPLATE or id(node) in frame)
        headed = next((node for node in self.nodes if node.tag == "h1"), None)
        for node in self.nodes:
            if node.mark == REMARK and 2 * size(node) > text[-1]:
                heads = headed is not None and node.begin <= headed.begin and headed.end <= node.end and node is not headed
                if not node.readers or heads:
                    node.mark = HINT
        while True:
            marked = [node for node in self.nodes if node.mark == REMARK]
            left = self.plain_text(lambda node: node.kind >= BOILERPLATE or id(node) in frame or node.mark == REMARK)[-1]
            if not marked or left >= min(0.1 * text[-1], ALMOST_GONE):
                return
            # the outermost of the largest; nothing else may hold the text
            max(marked, key=size).mark = HINT

    def plain_text(self, without) -> list[int]:
        """Running sums over the texts of the characters outside of links and of the elements for which `without` holds."""
        gone: set[int] = set()
        for node in self.nodes:
            if without(node) or node.parent is not None and id(node.parent) in gone:
                gone.add(id(node))
        return list(accumulate((0 if x is None or x[0].linked or id(x[0]) in gone else len(x[1].strip()) for x in self.pieces), initial=0))

    def _shut(self, now: Node, up: Node) -> Node:
        """Close all elements from `now` up to and with `up`."""
        while now is not up:
            now.end = len(self.pieces)
            now = now.parent
        up.end = len(self.pieces)
        return up.parent

    def _parse(self, page: str) -> None:
        at, now = 0, self.root
        # how many elements of each tag are open, so that end tags without a start needn't be looked for
        opened: dict[str, int] = {}
        search, pieces = _TAG.search, self.pieces

        def shut(up: Node) -> Node:
            node = now
            while node is not up.parent:
                opened[node.tag] -= 1
                node = node.parent
            return self._shut(now, up)

        while True:
            m = search(page, at)
            if m is None:
                if at < len(page):
                    pieces.append((now, page[at:]))
                return
            if m.start() > at:
                pieces.append((now, page[at : m.start()]))
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in BLOCKS:
                pieces.append(None)
            if m[1]:
                if opened.get(tag):
                    up = now
                    while up.tag != tag:
                        up = up.parent
                    now = shut(up)
                continue
            if tag in VOID:
                continue
            ends = SELF_CLOSING.get(tag) or ({"p"} if tag in CLOSES_P else None)
            if ends and any(opened.get(t) for t in ends):
                up = now
                while up is not self.root and up.tag not in ends and (up.tag not in BLOCKS or up.tag == "p"):
                    up = up.parent
                if up.tag in ends:
                    now = shut(up)
            end = _RAW_END.get(tag)
            if end is not None:
                m = end.search(page, at)
                at = m.end() if m else len(page)
                continue
            attrs = m[3] or ""
            node = _open(tag, attrs.rstrip("/"), now, len(pieces))
            self.nodes.append(node)
            if attrs.endswith("/") and tag not in BLOCKS and tag not in ("a", "b", "i", "em", "span", "strong"):
                node.end = len(pieces)
            else:
                opened[tag] = opened.get(tag, 0) + 1
                now = node

    def sizes(self, known: bool = False) -> tuple[list[int], list[int]]:
        """Running sums over the texts of the characters outside of links and in links; hidden texts have none, nor (with
        `known`) those that aren't main text for certain."""
        hidden: dict[int, bool] = {}
        for node in self.nodes:
            own = node.kind == HIDDEN or known and (node.kind == BOILERPLATE or node.mark == REMARK)
            hidden[id(node)] = own or node.parent is not None and hidden[id(node.parent)]
        n = [0 if x is None or hidden[id(x[0])] else len(x[1].strip()) for x in self.pieces]
        linked = [k if x is not None and x[0].linked else 0 for x, k in zip(self.pieces, n, strict=True)]
        return list(accumulate((a - b for a, b in zip(n, linked, strict=True)), initial=0)), list(accumulate(linked, initial=0))

    def leave_out(self, dropped, by_names: bool) -> None:
        """Mark what is left out: by kind, by the keys of paths, and (where no host is asked) by the names alone."""
        free, _ = self.sizes(known=True)
        for node in self.nodes:
            # most of a page's text outside of links
            most = 2 * (free[node.end] - free[node.begin]) > free[-1]
            kind = node.kind >= BOILERPLATE or node.kind == WRAPPING and not most
            names = by_names and (node.mark == REMARK or node.mark == FRAME and not most)
            node.out = kind or names or node.key in dropped or node.parent is not None and node.parent.out

    def scores(self) -> dict[int, float]:
        """Scores of the containers' paths: text near below them, less what is linked."""
        plain, linked = {}, {}
        for x in self.pieces:
            if x is not None and not x[0].out:
                n = len(x[1].strip())
                if n:
                    plain[id(x[0])] = plain.get(id(x[0]), 0.0) + n
        score: dict[int, float] = {}
        # children come after their parents, so that from the end on each element is complete when it is met
        for node in reversed(self.nodes):
            p, q = plain.pop(id(node), 0.0), linked.pop(id(node), 0.0)
            if not p and not q or node.parent is None:
                continue
            if node.tag == "a":
                p, q = 0.0, p + q
            if node.tag in CONTAINERS:
                score[node.key] = score.get(node.key, 0.0) + p - 0.5 * q
                # a container far above the text gains less, unless it is the article itself
                share = 0.85 * (0.5 if node.tag in ("article", "main") else 1.0)
                p, q = p * share, q * share
            up = id(node.parent)
            plain[up], linked[up] = plain.get(up, 0.0) + p, linked.get(up, 0.0) + q
        return score

    def text(self, path: int | None) -> str:
        """Text below the elements of that path (of the whole page, if None) that isn't left out."""
        inside: set[int] = set()
        for node in self.nodes:
            if path is None or node.key == path or node.parent is not None and id(node.parent) in inside:
                inside.add(id(node))
        blocks: list[str] = []
        own: list[str] = []
        for x in [*self.pieces, None]:
            if x is not None:
                if not x[0].out and id(x[0]) in inside:
                    own.append(x[1])
            elif own:
                words = _SPACE.sub(" ", entities.unescape("".join(own))).strip()
                if words:
                    blocks.append(words)
                own.clear()
        return " ".join(blocks)


def _best(score: dict[int, float], most: int = VOTES) -> list[int]:
    return [p for p, v in sorted(score.items(), key=lambda x: (-x[1], x[0]))[:most] if v > 0]


def main_text(page: str | None, path: int | None = None, dropped=frozenset()) -> str:
    """The page's text below a path, or below its own best container if it has no text there; by kinds of elements alone if
    names and paths leave almost nothing of it."""
    if not page:
        return ""
    found = Page(page)

    def own() -> str:
        best = _best(found.scores(), 1)
        return found.text(best[0] if best else None)

    text = ""
    if path is not None:
        found.leave_out(dropped, False)
        text = found.text(path)
    if not text:
        found.leave_out(dropped, True)
        text = own()
    if len(text) < ALMOST_GONE:
        found.leave_out((), False)
        whole = own()
        if 10 * len(text) < len(whole):
            return whole
    return text


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_PRIME, _BASE = (1 << 61) - 1, 911_382_323


def path_rows(page: str) -> list[tuple[int, float, float, float, float, float, int, int]]:
    """For each path of a container, a list or an element with a telling name: its key, its score as a container, its vote,
    the shares of the page's text that it holds and holds in links, its links, a hash of its text and its mark."""
    found = Page(page)
    found.leave_out((), True)
    score = found.scores()
    total = sum(v for v in score.values() if v > 0) or 1.0
    best = set(_best(score))
    free, linked = found.sizes()
    whole = max(free[-1] + linked[-1], 1)
    texts = [0 if x is None else xxhash.xxh3_64_intdigest(x[1].strip().encode("utf-8", "surrogatepass")) % _PRIME for x in found.pieces]
    rolled = list(accumulate(texts, lambda h, x: (h * _BASE + x) % _PRIME, initial=0))
    anchors = [0] * (len(texts) + 1)
    for node in found.nodes:
        anchors[node.begin] += node.tag == "a"
    anchors = list(accumulate(anchors, initial=0))
    rows: dict[int, list] = {}
    for node in found.nodes:
        if node.parent is None or not (node.tag in CONTAINERS or node.tag in LISTS or node.mark):
            continue
        a, z = node.begin, node.end
        row = rows.setdefault(node.key, [0.0, 0.0, 0, 0, 0])
        row[0] += (free[z] - free[a] + linked[z] - linked[a]) / whole
        row[1] += (linked[z] - linked[a]) / whole
        row[2] += anchors[z] - anchors[a]
        row[3] = (row[3] * _BASE + rolled[z] - rolled[a] * pow(_BASE, z - a, _PRIME)) % _PRIME
        row[4] = max(row[4], node.mark)
    return [(k, score.get(k, 0.0) / total, score[k] / total if k in best else 0.0, share, links, float(n), h, mark) for k, (share, links, n, h, mark) in rows.items()]


_ROWS = "host string, _k1 long, _k2 long, path long, score double, vote double, share double, linked double, links double, text long, mark int"


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int32()]
    for whole in batches:
        for b in slices(whole, "html"):
            place, found = [], []
            for k, page in enumerate(b.column("html").to_pylist()):
                rows = path_rows(page) if page else []
                place += [k] * len(rows)
                found += rows
            own = [b.column(c).take(pa.array(place, pa.int64())) for c in ("host", "_k1", "_k2")]
            columns = list(zip(*found, strict=True)) if found else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["host", "_k1", "_k2", "path", "score", "vote", "share", "linked", "links", "text", "mark"])


def dropped_paths():
    """Whether a host leaves a path out. Of a host's pages with the path: `share` is the mean share of their text that it holds,
    `linked` the mean share that is links, `pages` and `texts` how many different pages and texts of it there are."""
    repeated = (F.col("pages") >= 4) & (F.col("texts") * 3 <= F.col("pages"))
    menu = (F.col("linked") > 0.7 * F.col("share")) & (F.col("links") >= 3)
    # what each page makes of a name of remarks or adverts (`Page.weigh_marks`), by majority
    by_names = (F.col("remarks") * 2 >= F.col("rows")) & (F.col("mark") == REMARK) | ((F.col("mark") == FRAME) & (F.col("share") < 0.5))
    hinted = (F.col("mark") == HINT) & (F.col("share") < 0.5) & (repeated | menu)
    unnamed = (F.col("mark") == NOTHING) & (F.col("share") < 0.3) & (repeated | (menu & (F.col("pages") >= 3)))
    return by_names | hinted | unnamed


def chosen_paths(pages: DataFrame) -> DataFrame:
    """Rows (_k1, _k2, path, dropped): of the paths that a page has and its host voted for, the one with the most votes by
    page that has it, and the keys of those of its paths that the host leaves out.

    A vote is compared with the pages that could give it: a common ancestor of several layouts doesn't beat each layout's own
    container by being on every page, and a rare layout isn't lost to common ones."""
    weights = staged(pages.select("host", "_k1", "_k2", "html").mapInArrow(released(_weights), _ROWS), "paths")
    stats = weights.groupBy("host", "path").agg(
        F.round(F.sum("vote") / F.count("*"), 6).alias("mean"), *[F.round(F.avg(c), 6).alias(c) for c in ("share", "linked", "links")], F.max("mark").alias("mark"),
        F.count_distinct("_k2").alias("pages"), F.count_distinct("text").alias("texts"), F.count("*").alias("rows"), F.sum((F.col("mark") == REMARK).cast("int")).alias("remarks"),
    )
    # a table of its own, so that a path that all pages of a large host have can be split among tasks
    said = staged(stats.select("host", "path", "mean", dropped_paths().alias("drop")).where("mean > 0 or drop"), "votes")
    met = weights.select("host", "path", "_k1", "_k2", "score").join(said, ["host", "path"])
    best = F.max(F.when((F.col("mean") > 0) & (F.col("score") > 0), F.struct("mean", "score", "path")))
    return met.groupBy("_k1", "_k2").agg(best["path"].alias("path"), F.collect_set(F.when(F.col("drop"), F.col("path"))).alias("dropped"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    for whole in batches:
        for b in slices(whole, "html"):
            rows = zip(b.column("html").to_pylist(), b.column("path").to_pylist(), b.column("dropped").to_pylist(), strict=True)
            out = [main_text(page, path, frozenset(dropped or ())) for page, path, dropped in rows]
            n = np.array([len(t) for t in out], np.int64)
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), n], schema=schema)


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of pages (page_id, url, html)."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    # rows with the same keys have the same host and page, and so the same path
    src = src.withColumns({"_k1": F.coalesce(F.col("page_id"), F.lit(0)), "_k2": F.xxhash64("host", "html")})
    chosen = staged(chosen_paths(src), "chosen")
    joined = src.join(chosen, ["_k1", "_k2"], "left").select("page_id", "url", "html", "path", "dropped")
    return joined.mapInArrow(released(_extract), "page_id long, url string, text string, n_chars long")
