"""HTML to Markdown.

One ladder of JVM regular expressions defines the Markdown of flat markup. Small Arrow helpers see only the rows
the ladder cannot treat exactly: subtrees picked by attribute or badly nested boilerplate, nested marks, numbered
lists, preformatted text and tables with headings, and character references outside the short list.
"""

from __future__ import annotations

import html as html_lib
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from newslake.functions.markdown import where_nested
from newslake.functions.once import computed_once
from newslake.functions.text import strip

# Elements and attribute words that mark boilerplate.
BOILERPLATE_TAGS = ("nav", "header", "footer", "aside", "form", "script", "style", "noscript", "head")
BOILERPLATE_WORDS = ("cookie", "advert")

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset(
    "p div ul ol dl table h1 h2 h3 h4 h5 h6 section article main blockquote pre hr nav header footer aside form".split()
)
_IMPLIED_END = {"p": _BLOCKS, "li": frozenset(["li"])}
_LEFT_OVER = r"(?i)</?(?:" + "|".join(BOILERPLATE_TAGS) + r")[\s/>]"
_MARKED = (
    r"""(?s)<[^>]*\s(?:[cC][lL][aA][sS][sS]|[iI][dD])\s*=\s*"""
    r"""(?:"[^"]*(?:cookie|advert)|'[^']*(?:cookie|advert)|[^\s"'>]*(?:cookie|advert))"""
)
_COMMENT = r"(?s)<!--.*?-->"

# References decoded in the JVM. The ampersand comes last, so nothing decodes twice.
ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&nbsp;": " ",
    "&copy;": "©",
    "&middot;": "·",
    "&amp;": "&",
}

# Stand-ins for a heading and a line break until white space has been tidied.
_HEADING, _BREAK = "\ue000", "\ue001"

# Pattern and replacement, applied in order after boilerplate, comments and doctype are gone. Patterns do not
# open with a repeated white space class, which would be tried at every blank of the text.
SPACE_LADDER = [
    (r"[ \t\r\f]{2,}|[\t\r\f]", " "),
    (r" ?\n\s*", "\n"),
]
MARKDOWN_LADDER = [
    (r"(?i)<img(?:\s[^>]*)?>", ""),
    *SPACE_LADDER,
    (r"(?i)<h([1-6])(?:\s[^>]*)?>\s*", f"\n\n{_HEADING}$1 "),
    (r"(?i)</h[1-6]\s*>", "\n\n"),
    *[(f"{_HEADING}{n}", "#" * n) for n in range(1, 7)],
    (r"(?i)<(?:b|strong)(?:\s[^>]*)?>([^<]*)</(?:b|strong)\s*>", "**$1**"),
    (r"(?i)<(?:i|em)(?:\s[^>]*)?>([^<]*)</(?:i|em)\s*>", "*$1*"),
    (r"(?i)<code(?:\s[^>]*)?>([^<]*)</code\s*>", "`$1`"),
    (r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>\s*(.*?)\s*</a\s*>""", "[$2]($1)"),
    (r"(?i)<blockquote(?:\s[^>]*)?>\s*(?:<p(?:\s[^>]*)?>)?\s*", "\n\n> "),
    (r"(?i)<li(?:\s[^>]*)?>\s*", "\n* "),
    (r"(?i)<hr(?:\s[^>]*)?/?>", "\n\n---\n\n"),
    (r"(?i)<br(?:\s[^>]*)?/?>\s*", _BREAK),
    (
        r"(?i)</?(?:p|div|article|section|main|body|html|ul|ol|dl|table|pre|blockquote|figure)(?:\s[^>]*)?/?>",
        "\n\n",
    ),
    (r"(?i)</?tr(?:\s[^>]*)?>", "\n"),
    (r"(?i)</?t[dh](?:\s[^>]*)?>", " "),
    (r"<[^>]*>", ""),
    (r" *\n *", "\n"),
    (_BREAK, "  \n"),
]


def _pair(tag: str) -> str:
    return rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>"


class _BoilerplateSpans(HTMLParser):
    """Start and end offsets of the outermost boilerplate elements of one page."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=False)
        self.starts = [0]
        for line in page.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.size = len(page)
        self.open: list[str] = []
        self.cut_depth: int | None = None
        self.cut_from = 0
        self.spans: list[tuple[int, int]] = []
        self.feed(page)
        self.close()
        if self.cut_depth is not None:
            self.spans.append((self.cut_from, self.size))

    def _here(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    @staticmethod
    def _unwanted(tag, attrs) -> bool:
        if tag in BOILERPLATE_TAGS:
            return True
        marks = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
        return any(word in marks for word in BOILERPLATE_WORDS)

    def handle_starttag(self, tag, attrs):
        if self.open and tag in _IMPLIED_END.get(self.open[-1], ()):
            self.handle_endtag(self.open[-1], implied=True)
        unwanted = self.cut_depth is None and self._unwanted(tag, attrs)
        if tag in _VOID:
            if unwanted:
                self.spans.append((self._here(), self._here() + len(self.get_starttag_text())))
            return
        if tag == "body" and self.cut_depth is not None and self.open[self.cut_depth] == "head":
            self.spans.append((self.cut_from, self._here()))
            del self.open[self.cut_depth:]
            self.cut_depth = None
        if unwanted:
            self.cut_depth, self.cut_from = len(self.open), self._here()
        self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag, implied=False):
        if tag not in self.open:
            if self.cut_depth is None and tag in BOILERPLATE_TAGS:
                self.spans.append((self._here(), self._here() + len(tag) + 3))
            return
        depth = len(self.open) - 1 - self.open[::-1].index(tag)
        del self.open[depth:]
        if self.cut_depth is not None and depth <= self.cut_depth:
            end = self._here()
            if depth == self.cut_depth and not implied:
                end = self._end_of_tag(end)
            self.spans.append((self.cut_from, end))
            self.cut_depth = None

    def _end_of_tag(self, at: int) -> int:
        close = self.rawdata.find(">", at) if len(self.rawdata) == self.size else -1
        return close + 1 if close >= 0 else at


def cut_boilerplate(page: str | None) -> str | None:
    """The page without boilerplate elements and marked subtrees, however they nest."""
    if page is None:
        return None
    out, at = [], 0
    for start, end in _BoilerplateSpans(page).spans:
        out.append(page[at:start])
        at = max(at, end)
    out.append(page[at:])
    return "".join(out)


@F.pandas_udf(StringType())
def _cut_boilerplate(pages: pd.Series) -> pd.Series:
    return pages.map(cut_boilerplate)


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html_lib.unescape(t))


def _has_markup(page: Column) -> Column:
    return F.contains(page, F.lit("<"))


def strip_tag_pairs(page: Column) -> Column:
    """Boilerplate elements removed as open/close pairs; comments and scripts go first, they may hold markup."""
    raw = ("script", "style", "noscript")
    rest = "|".join(t for t in BOILERPLATE_TAGS if t not in raw)
    cut = F.regexp_replace(page, rf"{_COMMENT}|(?is)<({'|'.join(raw)})(?:\s[^>]*)?>.*?</\1\s*>", "")
    cut = F.regexp_replace(cut, rf"(?is)<({rest})(?:\s[^>]*)?>.*?</\1\s*>", "")
    return F.when(_has_markup(page), cut).otherwise(page)


def with_boilerplate_cut(df: DataFrame, page: str, out: str) -> DataFrame:
    """Exact boilerplate removal; only odd or attribute-marked pages reach the Arrow helper.

    Done in named steps, so that each regular expression runs once per row.
    """
    plain = F.col("_plain")
    odd = _has_markup(plain) & (plain.rlike(_LEFT_OVER) | plain.rlike(_MARKED))
    return (
        df.withColumn("_plain", computed_once(strip_tag_pairs(F.col(page))))
        .withColumn("_cut", _cut_boilerplate(F.when(odd, F.regexp_replace(page, _COMMENT, ""))))
        .withColumn(out, F.coalesce("_cut", "_plain"))
        .drop("_plain", "_cut")
    )


def _escape_marks(page: Column) -> Column:
    """Backslash before the Markdown marks of the text, not of the tags. One pass per piece between tags."""
    def escape(text: Column) -> Column:
        return F.regexp_replace(text, r"([*_])", r"\\$1")

    def after_tag(piece: Column) -> Column:
        tag = F.regexp_extract(piece, r"^[^>]*>", 0)
        return F.concat(tag, escape(F.substring(piece, F.length(tag) + 1, F.length(piece))))

    pieces = F.split(page, "<")
    escaped = F.transform(pieces, lambda piece, i: F.when(i == 0, escape(piece)).otherwise(after_tag(piece)))
    return F.when(page.rlike("[*_]"), F.array_join(escaped, "<")).otherwise(page)


def _climb(text: Column, ladder: list[tuple[str, str]]) -> Column:
    for pattern, replacement in ladder:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def markup_ladder(page: Column) -> Column:
    """The ladder alone, for markup without boilerplate; character references stay.

    Text without any tag only needs its white space tidied.
    """
    marked = _escape_marks(page)
    tagged = _climb(F.regexp_replace(marked, r"(?i)<!doctype[^>]*>", ""), MARKDOWN_LADDER)
    return F.when(_has_markup(page), tagged).otherwise(_climb(marked, SPACE_LADDER))


def _decode_short(text: Column) -> Column:
    plain = text
    for name, char in ENTITIES.items():
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), plain).otherwise(text)


def with_entities_decoded(df: DataFrame, text: str, out: str) -> DataFrame:
    """Decode character references once. Rare ones take the whole row through the helper."""
    short = "|".join(name[1:-1] for name in ENTITIES)
    rare = F.col(text).rlike(rf"&(?!(?:{short});)(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?")
    return (
        df.withColumn("_rare", _unescape(F.when(rare, F.col(text))))
        .withColumn(out, F.coalesce("_rare", _decode_short(F.col(text))))
        .drop("_rare")
    )


def with_markdown(df: DataFrame, page: str, out: str) -> DataFrame:
    """Add ``out``, the clean Markdown of the HTML page or fragment in ``page``."""
    df = with_boilerplate_cut(df, page, "_body")
    df = df.withColumn("_marked_up", computed_once(markup_ladder(F.col("_body"))))
    df = with_entities_decoded(df, "_marked_up", "_decoded")
    tidy = strip(F.regexp_replace("_decoded", r"\n{3,}", "\n\n"))
    df = df.withColumn("_nested", where_nested(F.col("_body")))
    return df.withColumn(out, computed_once(F.coalesce("_nested", tidy))).drop("_body", "_marked_up", "_decoded", "_nested")


def with_page_title(df: DataFrame, page: str, url: str, out: str) -> DataFrame:
    """Add ``out``: text of the first h1, else of the first title, else the url.

    Text runs of the element are stripped and joined without a separator.
    """
    h1 = r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1\s*>"
    title = r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>"
    shown = F.col("_shown")
    found = F.when(shown.rlike(h1), F.regexp_extract(shown, h1, 1)).when(
        shown.rlike(title), F.regexp_extract(shown, title, 1)
    )
    df = df.withColumn("_shown", computed_once(F.regexp_replace(page, rf"{_COMMENT}|{_pair('script')}", "")))
    df = df.withColumn("_runs", computed_once(F.regexp_replace(found, r"\s*<[^>]*>\s*", "")))
    df = with_entities_decoded(df, "_runs", "_text")
    return df.withColumn(out, F.coalesce(strip(F.col("_text")), url)).drop("_shown", "_runs", "_text")
