"""HTML extraction by deducing each host's template from tokens that share occurrence vectors.

A page is a sequence of tokens: tags, known by their path of elements, and blocks of text, known by their path and
words. A token's occurrence vector says how often it stands on each page of its host. Vectors are never gathered:
a token's sum of hashes of (page, count) stands for its vector, and Spark adds these up with the counts in one
aggregation over (host, token). Tokens of a host with the same vector are one equivalence class. A class is valid if it
is large (two tokens or more), frequent (on half of the host's pages, of ``LEAST_PAGES`` at least) and ordered (a token
has the same neighbour wherever it stands). Tokens carry their path, so classes nest as their elements do, and
together they are the host's template.

Text tokens of the template are fixed blocks: menus, notices, adverts that repeat. The other text lies in the
template's slots, and a host's slots are judged by what they hold on all of its pages: prose, links, and what their
elements declare (an article, or else a menu, a comment, a form ...). The verdict of a host is one small row: its
fixed blocks and its main slot. Each page is then read once more, and the blocks in the main slot are its text.
A page whose host has too few pages to show a template, or that lacks the main slot, is judged as a host of its own.

The only rows shuffled are token counts; hot hosts are counted before the shuffle. A host's verdict is no longer than
twice its mean page. Verdicts are broadcast only below the size limit of ``small_side``; else pages are joined with
them, where AQE splits a hot host.

Cases: null or empty html has empty text. A page without host is judged alone. Broken markup is read as browsers do:
open paragraphs, items and cells end where the next begins, stray end tags are ignored, an unfinished tag or comment
runs to the end. Repeated rows get the same text each. The result has ``page_id url text n_chars``; other columns of
the input are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newslake.llm.common import table
from newslake.llm.url_filter import url_host
from newslake.session import materialise, small_side

LEAST_PAGES = 10
PROSE_WORDS = 8  # a block of so many words outside links is prose
ARTICLE_SHARE = 0.3  # of a host's prose that a declared slot must hold

# Elements by what they mean for the text.
BLOCKS = set(
    "address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li "
    "main menu nav noscript object ol optgroup option p pre search section select summary svg table tbody td template "
    "tfoot th thead tr ul video audio canvas math".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noembed noframes xmp".split())
HIDDEN = set(
    "head script style noscript template svg math canvas object iframe audio video nav footer aside form button "
    "select dialog menu search fieldset".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
INNER = HEADINGS | set("p li ul ol dl dt dd blockquote pre figure figcaption tr td th tbody thead tfoot table caption".split())
ENDS = {  # an opening tag ends open elements of the first set, up to one of the second
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ROLE_WORDS = set(
    "nav navbar navigation menu submenu masthead footer sidebar aside ad ads advert adverts advertisement advertising "
    "sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login search searchbar form comment comments commentlist disqus respond reply replies "
    "share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager toolbar widget "
    "widgets skip alert".split()
)
ARIA_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
SAYS_HAS = set("has with no without is show hide js layout page not".split())
CONTENT_WORDS = set("article articlebody post entry story content maincontent".split())

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?<![\w-])(hidden)(?![\w-])")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
DIGITS = re.compile(r"\d+")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def hash64(*parts: object) -> int:
    text = "\0".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return int.from_bytes(blake2b(text, digest_size=8).digest(), "little", signed=True)


def declared(name: str, attributes: dict[str, str], inside: int) -> tuple[bool, int]:
    """What an element says of itself: not part of the text, or how surely it is the article (0 to 3)."""
    hidden = name in HIDDEN or (name == "header" and inside < 2)
    level = {"article": 3, "main": 2}.get(name, 0)
    if not attributes:
        return hidden, level
    role = attributes.get("role", "").lower()
    if role in ARIA_ROLES or "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", ""):
        hidden = True
    if "articlebody" in attributes.get("itemprop", "").lower() or role == "article":
        level = 3
    elif role == "main":
        level = max(level, 2)
    if name in ("html", "body", "main"):
        return hidden, level
    for label in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in NAME_PARTS.findall(label)]
        if not words or words[0] in SAYS_HAS:
            continue
        if ROLE_WORDS.intersection(words) or (words == ["header"] and inside < 2):
            hidden = True
        elif level < 1 and CONTENT_WORDS.intersection(words):
            level = 1
    return hidden, level


@dataclass(slots=True)
class Element:
    name: str
    path: int
    hidden: bool
    level: int
    slot: int  # nearest element that may be a slot, and the one around it
    outer: int


@dataclass(slots=True)
class Block:
    token: int
    text: str
    hidden: bool
    level: int
    slot: int
    outer: int
    linked: int  # characters inside links
    slots: tuple[int, ...]

    @property
    def prose(self) -> int:
        """Characters outside links, of a block with enough words there."""
        free = len(self.text) - self.linked
        return free if free > 0 and 2 * self.linked < len(self.text) and self.text.count(" ") >= PROSE_WORDS - 1 else 0


@dataclass
class Reader:
    """Tokens and blocks of one page."""

    keep_hidden: bool = True
    tokens: list[tuple[int, Block | None]] = field(default_factory=list)
    stack: list[Element] = field(default_factory=lambda: [Element("", 0, False, 0, 0, 0)])
    open: Counter = field(default_factory=Counter)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    link: int = 0  # depth of the stack where a link began; 0: none
    known: dict = field(default_factory=dict)

    def flush(self) -> None:
        if not self.pieces:
            return
        text = " ".join("".join(self.pieces).split())
        top, linked = self.stack[-1], self.linked
        self.pieces, self.linked = [], 0
        if text and (self.keep_hidden or not top.hidden):
            around = tuple({e.slot for e in self.stack}) if not top.hidden else ()
            block = Block(hash64(top.path, text), text, top.hidden, top.level, top.slot, top.outer, min(linked, len(text)), around)
            self.tokens.append((block.token, block))

    def text(self, raw: str) -> None:
        if raw:
            raw = entities.unescape(raw) if "&" in raw else raw
            self.pieces.append(raw)
            if self.link:
                self.linked += len(raw)

    def pop(self, depth: int) -> None:
        while len(self.stack) > depth:
            gone = self.stack.pop()
            self.open[gone.name] -= 1
            self.tokens.append((~gone.path, None))
        if self.link >= len(self.stack) + 1:
            self.link = 0

    def start(self, name: str, attributes: str) -> None:
        found = ATTRIBUTE.findall(attributes) if attributes.strip(" /") else ()
        known = {}
        for key, *values, hidden in found:
            known.setdefault(key.lower() or hidden, entities.unescape("".join(values)))
        top = self.stack[-1]
        block = name in BLOCKS
        if block:
            self.flush()
            if name != "br" and top.name == "p":
                self.pop(len(self.stack) - 1)
            ends = ENDS.get(name)
            if ends and any(self.open[n] for n in ends[0]):
                for depth in range(len(self.stack) - 1, 0, -1):
                    if self.stack[depth].name in ends[0]:
                        self.pop(depth)
                        break
                    if self.stack[depth].name in ends[1]:
                        break
            top = self.stack[-1]
        if name == "a":
            self.link = len(self.stack) if "href" in known else 0
        hidden, level = declared(name, known, top.level)
        if name in VOID:
            if block and name != "br":
                self.tokens.append((hash64(top.path, name), None))
            return
        if not block and not hidden:
            return
        label = DIGITS.sub("N", f"{name}.{known.get('class', '')}#{known.get('id', '')}")
        path = self.known.get((top.path, label))
        if path is None:
            path = self.known[top.path, label] = hash64(top.path, label)
        inner = not block or name in INNER
        self.stack.append(Element(
            name, path, hidden or top.hidden, max(level, top.level),
            top.slot if inner else path, top.outer if inner else top.slot,
        ))
        self.open[name] += 1
        self.tokens.append((path, None))

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        if name == "a":
            self.link = 0
        if self.open[name] > 0 and name:
            depth = len(self.stack) - 1
            while self.stack[depth].name != name:
                depth -= 1
            self.flush()
            self.pop(depth)

    def read(self, page: str) -> list[tuple[int, Block | None]]:
        at = 0
        while at < len(page):
            tag = MARKUP.search(page, at)
            self.text(page[at:tag.start() if tag else len(page)])
            if not tag:
                break
            at = tag.end()
            name = (tag[2] or "").lower()
            if tag[1]:
                self.end(name)
            elif name:
                if name in RAW:
                    last = RAW_END[name].search(page, at)
                    at = last.start() if last else len(page)
                    self.flush()
                else:
                    self.start(name, tag[3])
        self.flush()
        self.pop(1)
        return self.tokens


def read(page: str | None, keep_hidden: bool = True) -> list[tuple[int, Block | None]]:
    return Reader(keep_hidden).read(page) if page else []


COUNTS = (
    "host string, token long, is_text boolean, n_pages long, n long, vector long, before_min int, before_max int, "
    "after_min int, after_max int, level int, slot long, outer long, prose long, chars long, linked long"
)
_CHUNK = 200_000


def _mixed(page: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of page and count, 31 bits, so that sums of four billion fit a long."""
    x = page.astype(np.uint64) + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(33)).astype(np.int64)


def _counted(rows: list[tuple]) -> pd.DataFrame:
    """Occurrences of some pages to a row for each host and token."""
    names = ["host", "page", "token", "is_text", "before", "after", "level", "slot", "outer", "prose", "chars", "linked"]
    df = pd.DataFrame(rows, columns=names)
    same = {c: (c, "first") for c in ("host", "is_text", "level", "slot", "outer", "prose", "chars", "linked")}
    ends = {f"{c}_{f}": (c, f) for c in ("before", "after") for f in ("min", "max")}
    by_page = df.groupby(["page", "token"], as_index=False).agg(n=("token", "size"), **same, **ends)
    by_page["vector"] = _mixed(by_page["page"].to_numpy(), by_page["n"].to_numpy())
    same.pop("host")
    ends = {c: (c, c.rsplit("_", 1)[1]) for c in ends}
    found = by_page.groupby(["host", "token"], as_index=False).agg(
        n_pages=("page", "size"), n=("n", "sum"), vector=("vector", "sum"), **same, **ends
    )
    return found[[part.split()[0] for part in COUNTS.split(", ")]]


def _neighbour(token: int) -> int:
    return (token & 0xFFFFFFFF) - (1 << 31)


def occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Token counts of hosts, added up before they leave the task."""
    rows: list[tuple] = []
    for batch in batches:
        for host, page, html in batch.itertuples(index=False):
            tokens = read(html)
            ids = [0, *[t for t, _ in tokens], 0]
            rows.append((host, page, 0, False, 0, 0, 0, 0, 0, 0, 0, 0))
            tags = [0, *[t for t, b in tokens if b is None], 0]
            tag_no = 0
            for i, (token, block) in enumerate(tokens):
                if block is None:
                    tag_no += 1
                    before, after = tags[tag_no - 1], tags[tag_no + 1]
                    rest = (False, _neighbour(before), _neighbour(after), 0, 0, 0, 0, 0, 0)
                else:
                    kept = (block.prose, len(block.text), block.linked) if not block.hidden else (0, 0, 0)
                    rest = (
                        True, _neighbour(ids[i]), _neighbour(ids[i + 2]), block.level, block.slot, block.outer, *kept
                    )
                rows.append((host, page, token, *rest))
            if len(rows) > _CHUNK:
                yield _counted(rows)
                rows = []
    if rows:
        yield _counted(rows)


def token_counts(pages: DataFrame, least: int = 1) -> DataFrame:
    """``pages`` has ``host page html``. One row for each host and token; token 0 stands for the page itself."""
    rows = pages.mapInPandas(occurrences, COUNTS)
    total = [F.sum(c).alias(c) for c in ("n_pages", "n", "vector")]
    least_of = [F.min(c).alias(c) for c in ("is_text", "before_min", "after_min", "level", "slot", "outer", "prose", "chars", "linked")]
    most = [F.max(c).alias(c) for c in ("before_max", "after_max")]
    return rows.groupBy("host", "token").agg(*total, *least_of, *most)


def template(counts: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``host token is_text class_size``: tokens of valid equivalence classes."""
    hosts = small_side(
        counts.where(f"token = 0 AND n_pages >= {least_pages}").select("host", F.col("n_pages").alias("pages")), "hosts"
    )
    ordered = (F.col("before_min") == F.col("before_max")) | (F.col("after_min") == F.col("after_max"))
    frequent = materialise(
        counts.where("token != 0").join(hosts, "host").where((2 * F.col("n_pages") >= F.col("pages")) & ordered)
        .select("host", "token", "is_text", "vector", "n_pages", "n"),
        "frequent",
    )
    vector = ["host", "vector", "n_pages", "n"]
    classes = frequent.groupBy(*vector).agg(F.count("*").alias("class_size")).where("class_size >= 2")
    return frequent.join(classes, vector).select("host", "token", "is_text", "class_size")


def verdicts(counts: DataFrame, tokens: DataFrame) -> DataFrame:
    """``host fixed level slot``: fixed blocks of each host with a template, and which slot is the main one.

    ``level`` is the least that a block's elements must declare; at 0 the block must lie in ``slot``.
    """
    fixed = tokens.where("is_text").select("host", "token")
    slots = tokens.where("NOT is_text").select("host", F.col("token").alias("slot"))
    hosts = tokens.select("host").distinct()
    text = counts.where("is_text AND chars > 0").join(fixed, ["host", "token"], "left_anti")
    held = (
        text.groupBy("host", "slot", "outer", "level")
        .agg(*[F.sum(F.col(c) * F.col("n")).alias(c) for c in ("prose", "chars", "linked")])
        .join(hosts, "host", "left_semi")
    )
    prose = lambda level: F.sum(F.when(F.col("level") >= level, F.col("prose") * 1000 + F.col("chars") - F.col("linked")).otherwise(0))
    levels = held.groupBy("host").agg(*[prose(i).alias(f"l{i}") for i in range(4)])
    level = F.when(F.lit(False), 0)
    for i in (3, 2, 1):
        level = level.when((F.col(f"l{i}") > 0) & (F.col(f"l{i}") >= ARTICLE_SHARE * F.col("l0")), i)
    best = (
        held.where("2 * linked < chars").join(slots, ["host", "slot"], "left_semi")
        .groupBy("host", "slot").agg(F.sum("prose").alias("prose"), F.sum("chars").alias("chars"))
        .groupBy("host").agg(F.max(F.struct("prose", "chars", "slot")).alias("best"))
    )
    fixed_lists = fixed.groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("fixed"))
    return (
        levels.select("host", level.otherwise(0).alias("level"))
        .join(best.select("host", F.col("best.slot").alias("slot")), "host", "left")
        .join(fixed_lists, "host", "left")
    )


def main_text(html: str | None, fixed: frozenset[int] = frozenset(), level: int | None = None, slot: int | None = None) -> str:
    """The blocks of a page that lie in the main slot; without a verdict, or without that slot, the page's own best."""
    blocks = [b for _, b in read(html, keep_hidden=False) if b is not None and not b.hidden and b.token not in fixed]
    inside = [b for b in blocks if _in(b, level, slot)] if level is not None else []
    if not inside:
        inside = [b for b in blocks if _in(b, *_own_verdict(blocks))]
    return " ".join(b.text for b in inside)


def _in(block: Block, level: int, slot: int | None) -> bool:
    return block.level >= level if level else slot is None or slot in block.slots


def _own_verdict(blocks: list[Block]) -> tuple[int, int | None]:
    weight = lambda b: 1000 * b.prose + len(b.text) - b.linked
    whole = sum(map(weight, blocks))
    for level in (3, 2, 1):
        held = sum(weight(b) for b in blocks if b.level >= level)
        if held and held >= ARTICLE_SHARE * whole:
            return level, None
    slots: Counter = Counter()
    for b in blocks:
        slots[b.slot] += weight(b)
    return 0, min(slots, key=lambda s: (-slots[s], s)) if slots else None


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with their host's verdict to pages with their text; the columns before ``html`` stay as they are."""
    for batch in batches:
        kept = batch.schema.names[:batch.schema.names.index("html")]
        judged = zip(*[batch.column(c).to_pylist() for c in ("html", "fixed", "level", "slot")])
        texts = [main_text(html, frozenset(fixed or ()), level, slot) for html, fixed, level, slot in judged]
        columns = [*[batch.column(c) for c in kept], pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*kept, "text"])


def extract_pages(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_pages: int = LEAST_PAGES
) -> DataFrame:
    """``page_id url text n_chars`` of every page."""
    read_pages = pages.select(F.col(page_id), F.col(url), F.col(html).alias("html"), url_host(F.col(url)).alias("host"))
    keyed = read_pages.where("host != '' AND html != ''").select("host", F.xxhash64("host", url, "html").alias("page"), "html")
    counts = materialise(token_counts(keyed), "tokens")
    found = small_side(verdicts(counts, materialise(template(counts, least_pages), "template")), "verdicts")
    judged = read_pages.join(found, "host", "left").select(page_id, url, "html", "fixed", "level", "slot")
    kinds = ", ".join(f"`{c}` {read_pages.schema[c].dataType.simpleString()}" for c in (page_id, url))
    texts = judged.mapInArrow(extracted, f"{kinds}, text string")
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def op12_page_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
