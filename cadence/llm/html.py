"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of block elements, where elements with the
same tags and classes on the way down are one node. Two entropies are taken over a node's pages:
of its presentations (the sequences of its child elements), and of the texts that stand in it.
A text that recurs on a share of the pages loses importance by that share's logarithm, so a
branch's importance is the part of its text that is new from page to page.

A node with few presentations is a template: its children are places that every page
fills. A place whose new text is small beside that of the largest place is removed, and so is any branch
whose text mostly recurs. In a node of many presentations (an article) children stay unless they
recur. A place is small only beside a larger one of the same page. A host with few pages borrows from the tree of
all hosts. Inside an ``article`` or ``main`` no size counts, and quotes, tables, lists of terms, figures and preformatted text stay also where they
recur. Elements that HTML defines for other things than content (``nav``, ``footer``, ``aside`` and
so on), roles and a few whole class names are of no importance, whatever their size, unless all articles of the page stand
in them; a form, or an element with such a class, that holds all that is left of a page is kept. Without them
(``names=False``) the tree decides alone. A heading is judged with what it heads.
Only what browsers don't show as text (scripts, styles, form fields) is left out while reading.

Statistics are counted in Spark by host, node and text, folded in each task before the
shuffle; branches are summed through each node's list of ancestors, at most DEPTH of them, so no task holds a host's tree. What
lies deeper counts for the node at that depth.

Defined cases: null or empty html gives an empty text; broken markup is read as
far as it goes; pages of any length and depth are read whole; a null address is a host of its own; rows that
repeat, or ids that do, give rows that repeat; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import Workspace, release

# Element names and roles of HTML, and class names in wide use.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("head script style noscript template svg math iframe object canvas audio video select option button input textarea map".split())
NO_CONTENT = frozenset("nav header footer aside form dialog menu".split())
NO_CONTENT_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NO_CONTENT_CLASS = frozenset("ad ads advert advertisement banner sidebar menu navbar breadcrumb breadcrumbs footer header comments comment-list comments-area cookie-notice cookie-banner popup modal newsletter related related-posts share social pagination".split())
ARTICLE = frozenset("article main".split())
CONTENT = frozenset("blockquote table caption thead tbody tfoot tr td th pre figure figcaption dl dt dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_P_STOP = ("table", "td", "th", "article", "section", "div", "body", "li", "blockquote")
_ROOT = 1
#: Levels of the style tree.
DEPTH = 48
_HINT, _HEADING = 1, 2


def _hash(parent: int, label: str) -> int:
    """61 bits, so that a node's marks fit beside its parent's key."""
    return xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), parent) >> 3 or 2


class Place:
    """An open element: its tag, the number of its tree node, how deep that is, and whether its text is shown."""

    __slots__ = ("tag", "node", "depth", "mute", "children")

    def __init__(self, tag: str, node: int, depth: int, mute: bool):
        self.tag, self.node, self.depth, self.mute = tag, node, depth, mute
        self.children = None if mute else xxhash.xxh64()


class PageReader(HTMLParser):
    """Blocks of a page in order as ``(node, text)``, and its tree: for each node its key, its parent's number, its marks and its tag, and whether it is inside an article or holds one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.keys, self.parents, self.marks, self.tags = [_ROOT], [-1], [0], [""]
        self.inside, self.holds, self.plain_article = [False], [False], False
        self.number = {_ROOT: 0}
        self.stack = [Place("", 0, 0, False)]
        self.open: dict[str, int] = {}
        self.text: list[str] = []
        self.blocks: list[tuple[int, str]] = []
        self.styles: set[tuple[int, int]] = set()

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text = []
            top = self.stack[-1]
            if text and not top.mute:
                self.blocks.append((top.node, text))

    def pop(self) -> None:
        self.flush()
        place = self.stack.pop()
        self.open[place.tag] -= 1
        if place.children is not None and place.depth < DEPTH:
            self.styles.add((place.node, place.children.intdigest() >> 1))

    def close_until(self, tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        if not any(self.open.get(t) for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                while len(self.stack) > k:
                    self.pop()
                return
            if self.stack[k].tag in stop:
                return

    def node_of(self, above: Place, tag: str, label: str, mark: int, article: bool) -> tuple[int, int]:
        """The tree node of a new element, and its depth."""
        if above.depth >= DEPTH:
            return above.node, above.depth
        key = _hash(self.keys[above.node], f"{label} {mark}")
        no = self.number.get(key)
        if no is None:
            no = self.number[key] = len(self.keys)
            self.keys.append(key)
            self.parents.append(above.node)
            self.marks.append(mark)
            self.tags.append(tag)
            self.inside.append(self.inside[above.node] or article)
            self.holds.append(False)
        return no, above.depth + 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag in VOID or (tag in INLINE and not attrs):
            if tag not in INLINE:
                self.flush()
            return
        named = dict(attrs)
        names = (named.get("class") or "").lower().split()
        mute = tag in NO_TEXT
        hint = (
            tag in NO_CONTENT
            or not NO_CONTENT_CLASS.isdisjoint(names)
            or (named.get("id") or "").lower() in NO_CONTENT_CLASS
            or (named.get("role") or "").lower() in NO_CONTENT_ROLE
            or "hidden" in named
            or named.get("aria-hidden") == "true"
            or "display:none" in (named.get("style") or "").replace(" ", "").lower()
        )
        if tag in INLINE:  # also with a class that would mark a block: it is part of a sentence
            return
        self.flush()
        if tag in CLOSES_P:
            self.close_until(("p",), _P_STOP)
        if tag in _SAME:
            same, stop = _SAME[tag]
            self.close_until(tuple(same.split()), stop)
        if tag == "body":
            self.close_until(("head",), ())
        top = self.stack[-1]
        label = ".".join([tag, *sorted(names)])
        if top.children is not None and not mute:
            top.children.update(label.encode("utf-8", "surrogatepass") + b" ")
        mute = mute or top.mute
        if mute:
            place = Place(tag, top.node, top.depth, True)
        else:
            above, mark = top, _HINT * (hint and tag not in ("html", "body"))
            if tag in HEADINGS:  # it heads what follows the header around it
                mark |= _HEADING
                for k in range(len(self.stack) - 1, 0, -1):
                    above = self.stack[k]
                    if above.tag != "header":
                        break
                else:
                    above = self.stack[0]
            article = tag in ARTICLE or (named.get("role") or "").lower() == "main"
            place = Place(tag, *self.node_of(above, tag, label, mark, article), False)
            if article:
                no, free = place.node, True
                while no > 0:  # at most DEPTH levels
                    self.holds[no], free = True, free and not self.marks[no] & _HINT
                    no = self.parents[no]
                self.plain_article |= free
        self.stack.append(place)
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                while len(self.stack) > k:
                    self.pop()
                return
            if tag in INLINE and self.stack[k].tag not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].mute:
            self.text.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A declaration that HTML doesn't know, up to its end, as a comment."""
        close = "]]>" if self.rawdata[i : i + 9].upper() == "<![CDATA[" else ">"
        at = self.rawdata.find(close, i + 3)
        return at + len(close) if at >= 0 else -1


def read(page: str | None) -> PageReader:
    reader = PageReader()
    if page:
        reader.feed(page)
        reader.close()
        while len(reader.stack) > 1:
            reader.pop()
        reader.flush()
    return reader


def host_key(url: str | Column = "url") -> Column:
    """A number for the address's host, without scheme, user and port."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.xxhash64(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?/*(?:[^/?#@]*@)?([^/?#:]*)", 1)))


def main_text(reader: PageReader, low: frozenset[int], small: frozenset[int] = frozenset(), names: bool = True) -> str:
    """The blocks outside of marked branches (with ``names``), of branches in ``low``, and of those in ``small`` beside a larger place; where a page has small places only, the one with most text is its largest."""
    n = len(reader.keys)
    marked = [names and bool(m & _HINT) and (reader.plain_article or not h) for m, h in zip(reader.marks, reader.holds, strict=True)]
    out = _kept(reader, low, small, marked)
    if not out and any(marked):
        soft = [m and reader.tags[no] in NO_CONTENT and reader.tags[no] != "form" for no, m in enumerate(marked)]
        out = _kept(reader, low, small, soft)
    return "\n".join(out) if n else ""


def _kept(reader: PageReader, low: frozenset[int], small: frozenset[int], marked: list[bool]) -> list[str]:
    n = len(reader.keys)
    size = [0] * n
    for node, text in reader.blocks:
        size[node] += len(text)
    for no in range(n - 1, 0, -1):  # parents come first
        if not marked[no]:
            size[reader.parents[no]] += size[no]
    stays = [reader.inside[no] and reader.tags[no] in CONTENT for no in range(n)]
    gone = [marked[no] or (reader.keys[no] in low and not stays[no]) for no in range(n)]
    large = [-1] * n  # the place that the others of a parent are small beside
    for no in range(1, n):
        if not gone[no] and size[no] and not reader.marks[no] & _HEADING:
            at = reader.parents[no]
            rank = (reader.keys[no] not in small, size[no])
            if large[at] < 0 or rank > (reader.keys[large[at]] not in small, size[large[at]]):
                large[at] = no
    kept = [True] * n
    for no in range(1, n):
        at = reader.parents[no]
        kept[no] = kept[at] and not gone[no] and (reader.keys[no] not in small or large[at] == no or reader.inside[at])
    return [text for node, text in reader.blocks if kept[node]]


#: Kinds of counted features: texts, presentations, a node's parent and marks, characters, ancestors.
_TEXT, _STYLE, _PARENT, _CHARS, _ABOVE = range(5)


def page_features(reader: PageReader) -> dict[tuple[int, int, int], int]:
    """``(node, kind, feature)`` with what a page adds: one, or its characters."""
    out: dict[tuple[int, int, int], int] = {}
    for no, text in reader.blocks:
        key = reader.keys[no]
        out[(key, _CHARS, 0)] = out.get((key, _CHARS, 0), 0) + len(text)
        out[(key, _TEXT, _hash(4, text))] = 1
    for no, style in reader.styles:
        out[(reader.keys[no], _STYLE, style)] = 1
    for no, key in enumerate(reader.keys):
        parent = reader.parents[no]
        out[(key, _PARENT, (reader.keys[parent] if parent >= 0 else 0) << 2 | reader.marks[no])] = 1
        above = no
        while above >= 0:
            out[(key, _ABOVE, reader.keys[above])] = 1
            above = reader.parents[above]
    return out


def features(pages: DataFrame) -> DataFrame:
    """``host, node, kind, feature, n``, folded in each task."""
    schema = "host long, node long, kind int, feature long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int, int, int], int] = {}

        def table() -> pa.RecordBatch:
            cols = list(zip(*counts, strict=True)) if counts else [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
            out = pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(list(counts.values()), pa.int64())], names=[f.split()[0] for f in schema.split(", ")])
            counts.clear()
            return out

        for b in batches:
            for host, page in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
                for f, n in page_features(read(page.as_py())).items():
                    counts[(host, *f)] = counts.get((host, *f), 0) + n
                if len(counts) > 200_000:
                    yield table()
        yield table()
        release()

    return pages.select(host_key().alias("host"), "html").mapInArrow(run, schema)


def _trees(rows: DataFrame, key: list[str]) -> DataFrame:
    """Per node of each tree: pages, parent, marks, new and all characters of its branch a page, and its presentations' entropy."""
    of = lambda kind: rows.where(F.col("kind") == kind)
    nodes = of(_PARENT).groupBy(*key, "node").agg(F.sum("n").alias("m"), F.max("feature").alias("up"))
    text = of(_TEXT).groupBy(*key, "node").agg(F.sum("n").alias("w0"), F.sum(F.col("n") * F.log("n")).alias("s0"))
    style = of(_STYLE).groupBy(*key, "node").agg(F.sum("n").alias("w1"), F.sum(F.col("n") * F.log("n")).alias("s1"))
    chars = of(_CHARS).groupBy(*key, "node").agg(F.sum("n").alias("chars"))
    one = nodes.join(text, [*key, "node"], "left").join(style, [*key, "node"], "left").join(chars, [*key, "node"], "left")
    new = F.when(F.col("w0").isNull(), 0.0).when(F.col("m") > 1, F.greatest(F.lit(0.0), 1 - F.col("s0") / F.col("w0") / F.log("m"))).otherwise(1.0)
    one = one.select(*key, "node", "m", "up", F.coalesce("chars", F.lit(0)).alias("own"), (F.coalesce("chars", F.lit(0)) * new).alias("own_new"), F.coalesce(F.log("w1") - F.col("s1") / F.col("w1"), F.lit(0.0)).alias("entropy"))
    above = of(_ABOVE).select(*key, "node", F.col("feature").alias("above")).distinct()
    sums = above.join(one.select(*key, "node", "own", "own_new"), [*key, "node"]).groupBy(*key, F.col("above").alias("node")).agg(F.sum("own").alias("own"), F.sum("own_new").alias("own_new"))
    m = F.col("m").cast("double")
    return one.drop("own", "own_new").join(sums, [*key, "node"]).select(*key, "node", "m", F.shiftrightunsigned("up", 2).alias("parent"), F.col("up").bitwiseAND(3).alias("marks"), "entropy", (F.col("own") / m).alias("chars"), (F.col("own_new") / m).alias("new"))


def importances(pages: DataFrame, ws: Workspace, borrow: int) -> DataFrame:
    """All hosts' trees; a host's figures mixed with those of all hosts as if it had ``borrow`` pages more."""
    found = ws.put(features(pages).groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n")), "features")
    every = _trees(found.groupBy("node", "kind", "feature").agg(F.sum("n").alias("n")), [])
    every = every.select("node", F.col("m").alias("seen"), *[F.col(c).alias(f"all_{c}") for c in ("entropy", "chars", "new")])
    own = _trees(found, ["host"]).join(every, "node")
    share = F.col("m") / (F.col("m") + F.lit(float(borrow)))
    mixed = [(share * F.col(c) + (1 - share) * F.col(f"all_{c}")).alias(c) for c in ("entropy", "chars", "new")]
    return own.select("host", "node", "parent", "marks", "seen", *mixed)


def style_trees(pages: DataFrame, *, names: bool = True, place: float = 0.15, recur: float = 0.5, presentations: float = 4.0, evidence: int = 4, borrow: int = 50) -> DataFrame:
    """``host, low, small``: for each host the nodes that open a branch of low importance, and those of them that are only small beside another place.

    Marked nodes are not listed with ``names``, since a page's own reading knows them; the lists hold nodes that ``evidence`` pages show.

    ``place`` is the least share of the largest place's new text, ``recur`` of a branch's own text that must be new,
    ``presentations`` the number (as the entropy's exponential) from which a node is no template, and ``evidence`` the least pages of any host that must
    show a node before texts and places count against it.
    """
    ws = Workspace(pages.sparkSession, "sst")
    t = ws.put(importances(pages, ws, borrow), "trees")
    ws.drop("features")
    marked, heading = F.col("marks").bitwiseAND(_HINT) > 0, F.col("marks").bitwiseAND(_HEADING) > 0
    rows = t.withColumn("value", F.col("new")).where(~marked) if names else t.withColumn("value", F.col("new"))
    best = rows.where(~heading).groupBy("host", "parent").agg(F.max("value").alias("best"))
    above = t.select("host", F.col("node").alias("parent"), F.exp("entropy").alias("styles"))
    rows = rows.join(best, ["host", "parent"]).join(above, ["host", "parent"], "left")
    known = F.col("seen") >= evidence
    slot = known & ~heading & (F.coalesce("styles", F.lit(1.0)) < presentations) & (F.col("value") < place * F.col("best"))
    again = known & (F.col("new") < recur * F.col("chars")) & (F.col("value") < F.col("best"))
    by = rows.withColumns({"_low": again, "_small": slot}).where("_low or _small")
    low = by.groupBy("host").agg(F.sort_array(F.collect_set(F.when(F.col("_low"), F.col("node")))).alias("low"), F.sort_array(F.collect_set(F.when(~F.col("_low"), F.col("node")))).alias("small"))
    return ws.put(low, "low")


def extract(pages: DataFrame, *, names: bool = True, **limits) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``; ``names`` and ``limits`` as for :func:`style_trees`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, last, gone = [], None, ()
            for page, *nodes in zip(b.column("html"), b.column("low"), b.column("small"), strict=True):
                if last != nodes:
                    last, gone = nodes, [frozenset(x.as_py() or ()) for x in nodes]
                texts.append(main_text(read(page.as_py()), *gone, names))
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
        release()

    low = style_trees(pages, names=names, **limits)
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host_key().alias("host"))
    return keyed.join(low, "host", "left").select("page_id", "url", "html", "low", "small").mapInArrow(run, "page_id long, url string, text string, n_chars long")
