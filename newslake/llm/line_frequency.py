"""Quality rules by cross-document line frequency. DataFrame operations only.

Every line of a document is normalised (ASCII case, blanks, digits) and hashed. A line that stands in more than
``LINE_DOCS`` documents of one host, of whatever size, is frequent there. A document that passes the base rules and has
enough words besides its frequent lines stays, any other is rejected: too few words would be left of it. Frequent lines
are removed, but each stays in the first of the documents that stay, so no line of a document that stays is lost.
Copies of a text count as one document, so a page that was crawled a hundred times doesn't make its own lines
frequent.

Cases: a null text has no words and fails the base rules; so does an empty one. A null host is a host of its own.
Repeated rows get the same verdict each. Null and repeated ids are allowed. Extra columns pass through unread, also
under the names used here; those named as a result give way to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newslake.functions.once import computed_once
from newslake.llm.common import BLANKS, KEY, UPPER, blank_words, own_names, table, with_row_key, without, without_lines
from newslake.session import materialise

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words in repeated windows
WINDOW = 3
LINE_DOCS = 10  # a line in more documents of its host than this is frequent
LEFT_SHARE = 0.2  # a document with less than this share of its words in other lines is depleted
SALTS = 16


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed`` to every row."""
    t = F.coalesce(F.col(text), F.lit(""))
    worded = F.filter(F.split(t, "\n"), lambda line: without(line, BLANKS) != "")
    counted = docs.select(
        "*",
        computed_once(blank_words(t)).alias("_words"),
        computed_once(worded).alias("_lines"),
        F.char_length(without(t, BLANKS)).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(without(t, SYMBOLS))).cast("long").alias("n_symbols"),
    )
    n = F.size("_words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    counted = counted.select(
        "*",
        n.cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        computed_once(
            F.transform(starts, lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]))
        ).alias("_windows"),
    ).drop("_words", "_lines")
    return _repeated(counted).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
    )


def _repeated(df: DataFrame) -> DataFrame:
    """``n_repeat_words`` from ``_windows``: sort the windows, keep those with an equal neighbour, cover words."""
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    pairs = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.select("*", computed_once(F.when(some, F.sort_array(pairs))).alias("_sorted")).drop("_windows")
    alike = lambda x, j: F.coalesce(F.get("_sorted", j)["h"] == x["h"], F.lit(False))
    twice = F.filter("_sorted", lambda x, j: alike(x, j - 1) | alike(x, j + 1))
    df = df.select(
        "*", computed_once(F.sort_array(F.transform(twice, lambda x: x["i"]))).alias("_starts")
    ).drop("_sorted")
    new = F.transform(
        "_starts", lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", j + 1) - i, F.lit(WINDOW)))
    )
    covered = F.aggregate(new, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_starts")


def host_lines(docs: DataFrame, host: str, text: str, doc_id: str) -> DataFrame:
    """A row for each line with a word: host, position, words, hash of the line in normal form, digest of the text.

    Normal form: ASCII lower case, every digit a zero, one space between words.
    """
    digits = "123456789"
    plain = F.translate(text, UPPER + digits + "\t\x0b\f\r", UPPER.lower() + "0" * len(digits) + " " * 4)
    words = F.transform(F.split(plain, "\n"), lambda line: F.array_remove(F.split(line, " "), ""))
    lines = F.transform(
        words,
        lambda w, i: F.struct(i.alias("pos"), F.size(w).alias("n"), F.xxhash64(F.array_join(w, " ")).alias("line")),
    )
    exploded = docs.select(
        *KEY,
        F.coalesce(F.col(host), F.lit("\0")).alias("host"),
        F.col(doc_id).alias("id"),
        F.xxhash64(text).alias("digest"),
        F.inline(lines),
    )
    return exploded.where("n > 0")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def line_frequency(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    line_docs: int = LINE_DOCS,
    left_share: float = LEFT_SHARE,
) -> DataFrame:
    """``docs`` with the base counts, ``n_boilerplate_words``, ``base_failed``, ``kept`` and ``clean_text``, the text
    without the lines that were removed."""
    plain, names = own_names(docs)
    doc_id, text, host = names[doc_id], names[text], names[host]
    keyed = with_row_key(plain, doc_id, text, host)
    lines = materialise(host_lines(keyed, host, text, doc_id), "lines")
    frequent = lines.groupBy("host", "line").agg(F.count_distinct("digest").alias("n_docs")).where(F.col("n_docs") > line_docs)
    salted = frequent.select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hits = lines.withColumn("salt", F.pmod("_k1", F.lit(SALTS)).cast("int")).join(salted, ["host", "line", "salt"])
    # Repeated rows share a key and must not add up.
    hits = materialise(hits.groupBy(*KEY, "host", "line", "pos", "n", "salt").agg(F.min("id").alias("id")), "frequent")

    base = base_counts(keyed.select(*KEY, F.col(text).alias("text"))).select(*KEY, *COUNTS, "base_failed").distinct()
    words = hits.groupBy(*KEY).agg(F.sum("n").alias("_frequent"))
    left = F.col("n_words") - F.coalesce("_frequent", F.lit(0))
    judged = base.join(words, KEY, "left").withColumn(
        "kept", ~F.col("base_failed") & (left >= left_share * F.col("n_words"))
    )
    judged = materialise(judged, "judged")

    firsts = (
        hits.join(judged.where("kept").select(*KEY), KEY, "left_semi")
        .groupBy("host", "line").agg(F.min(F.struct("id", *KEY)).alias("first"))
        .select("host", "line", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    stays = (F.col("first._k1") == F.col("_k1")) & (F.col("first._k2") == F.col("_k2"))
    removed = hits.join(firsts, ["host", "line", "salt"], "left").where(~F.coalesce(stays, F.lit(False)))
    gone = removed.groupBy(*KEY).agg(F.sum("n").alias("n_boilerplate_words"), F.collect_list("pos").alias("_gone"))
    judged = judged.join(gone, KEY, "left").fillna(0, ["n_boilerplate_words"])
    whole = keyed.join(judged, KEY).select("*", computed_once(F.split(text, "\n")).alias("_split"))
    results = {
        **{c: F.col(c) for c in (*COUNTS, "n_boilerplate_words", "base_failed", "kept")},
        "clean_text": F.when(F.col("_gone").isNull(), F.col(text)).otherwise(without_lines("_split", "_gone")),
    }
    return whole.select(
        *[F.col(own).alias(c) for c, own in names.items() if c not in results],
        *[c.alias(name) for name, c in results.items()],
    )


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_frequency(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_boilerplate_words",
        "base_failed", "kept",
    )


SQL = """
WITH split_words AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(string_split(translate(coalesce(text, ''), chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda w: w <> '') AS words,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), base AS (
  SELECT doc_id, source, text, words, lines, len(words) AS n_words,
         coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(lines, lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS worded
  FROM split_words
), windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM base)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, source, md5(text) AS digest, len(ws) AS n, array_to_string(ws, ' ') AS line
  FROM (
    SELECT doc_id, source, text,
           list_filter(string_split(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789'||chr(9)||chr(11)||chr(12)||chr(13),
             'abcdefghijklmnopqrstuvwxyz000000000    '), ' '), lambda w: w <> '') AS ws
    FROM (SELECT doc_id, source, text, unnest(lines) AS l FROM base)
  ) WHERE len(ws) > 0
), frequent AS (
  SELECT source, line FROM lines GROUP BY source, line HAVING count(DISTINCT digest) > 10
), hits AS (
  SELECT doc_id, source, line, n FROM lines JOIN frequent USING (source, line)
), judged AS (
  SELECT b.*, coalesce(c.n, 0) AS n_repeat_words, (n_words < 50 OR 100 * coalesce(c.n, 0) > 50 * n_words) AS base_failed,
         n_words - coalesce((SELECT sum(n) FROM hits h WHERE h.doc_id = b.doc_id), 0) >= 0.2 * n_words AS enough
  FROM base b LEFT JOIN covered c USING (doc_id)
), firsts AS (
  SELECT source, line, min(doc_id) AS first FROM hits JOIN judged j USING (doc_id, source)
  WHERE j.enough AND NOT j.base_failed GROUP BY source, line
), gone AS (
  SELECT doc_id, sum(n) AS n FROM hits LEFT JOIN firsts USING (source, line) WHERE first IS NULL OR doc_id <> first GROUP BY doc_id
)
SELECT j.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       (len(worded) - len(list_distinct(worded)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       coalesce(g.n, 0)::BIGINT AS n_boilerplate_words, base_failed, NOT base_failed AND enough AS kept
FROM judged j LEFT JOIN gone g USING (doc_id)
"""
