"""Scalar Column builders for article text, urls, ids and tags. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode white space as Python's str.strip() sees it; Spark's trim removes blanks only by default.
WHITE = " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))

# Fixed values of the record formats.
CARD_SNIPPET_CHARS = 280
PROMPT_CONTENT_CHARS = 600
CHAT_TITLE_CHARS = 100
CHAT_ANSWER_CHARS = 500


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def article_id(url: Column) -> Column:
    """Deterministic id of an article: the same url always upserts the same record."""
    return F.md5(url.cast("binary"))


def first_filled(*cs: Column) -> Column:
    """First value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def present_or(payload: Column, key: str, value: Column, default: Column) -> Column:
    """``default`` only if ``key`` is missing from the JSON object; an explicit null stays null."""
    present = F.coalesce(F.array_contains(F.json_object_keys(payload), key), F.lit(False))
    return F.when(present, value).otherwise(default)


def netloc(url: Column) -> Column:
    """Authority part of a url, with port and user info; empty if there is none. Never fails."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def source_host(url: Column) -> Column:
    return F.regexp_replace(netloc(url), r"^www\.", "")


def repo_name(url: Column) -> Column:
    """``owner/name`` of a releases endpoint, else the empty string."""
    parts = F.filter(F.split(url_path(url), "/"), lambda p: p != "")
    is_repo = (F.size(parts) >= 3) & (F.try_element_at(parts, F.lit(1)) == "repos")
    return F.when(
        is_repo,
        F.concat_ws("/", F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3))),
    ).otherwise(F.lit(""))


def join_tags(tags: Column) -> Column:
    return F.array_join(tags, ",")


def split_tags(csv: Column) -> Column:
    """Csv to tags: parts are stripped and empty parts dropped; null or empty gives no tags."""
    parts = F.transform(F.split(F.coalesce(csv, F.lit("")), ","), strip)
    return F.filter(parts, lambda t: t != "")


def tag_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def head(c: Column, n: int) -> Column:
    """First ``n`` code points."""
    return F.substring(c, 1, n)


def expand_query(question: Column, topics: Column) -> Column:
    """The question with its topics as a hint; topics never filter."""
    hinted = F.concat(question, F.lit(" | "), F.array_join(topics, ", "))
    return F.when(F.coalesce(F.size(topics), F.lit(0)) <= 0, question).otherwise(hinted)


def chunk_id(article: Column, index: Column) -> Column:
    return F.concat(article, F.lit("-"), index.cast("string"))


_CHUNK_ID = r"(?s)^(.*)-([0-9]+)$"


def chunk_article(chunk: Column) -> Column:
    """Article part of a chunk id, split at the last dash; null if no index follows it."""
    return F.when(chunk.rlike(_CHUNK_ID), F.regexp_extract(chunk, _CHUNK_ID, 1))


def chunk_index(chunk: Column) -> Column:
    return F.when(chunk.rlike(_CHUNK_ID), F.regexp_extract(chunk, _CHUNK_ID, 2).try_cast("int"))


def extract_answer(raw: Column) -> Column:
    """The ``answer`` of a JSON object reply, else the stripped reply itself.

    A JSON null answer counts as absent.
    """
    answer = F.try_variant_get(F.try_parse_json(raw), "$.answer", "string")
    return F.coalesce(answer, strip(raw))


def is_recent(date: Column, as_of: Column, days: int = 7) -> Column:
    """At most ``days`` whole days old at ``as_of``; a null date is never recent."""
    return F.coalesce(date > as_of - F.make_dt_interval(days=F.lit(days + 1)), F.lit(False))
