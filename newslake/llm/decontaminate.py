"""Benchmark decontamination by winnowing. DataFrame operations only.

A span of ``window`` words shared by a document and an item is found through one fingerprint: the least hash of
the k-word grams in the span. Both sides keep that minimum for every window, so every shared span of at least
``window`` words has a fingerprint in common, and only runs of equal minima travel (about a quarter of the words).
The runs whose minimum occurs in the benchmark are extended: all windows of the run are compared in full with the
windows of the items. Items shorter than a window are one window of their own length; every such length gets its
own, shorter grams.

Documents stay where they are as long as the fingerprints of the benchmark, a written table of known size, are
below Spark's broadcast threshold; beyond it the runs are shuffled.

Cases: a null or empty text has no words, an item without words has no windows. Repeated rows get the same result
each. An item without id makes hits but is not listed. Ids may repeat: an id is listed if any of its texts occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newslake.functions.once import computed_once
from newslake.llm.common import KEY, lower_ascii, sha256_hex, table, under_own_names, with_row_key
from newslake.session import materialise

WINDOW = 13
SHARE = 20  # contaminated from one hit word in so many on
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def gram_words(length: int) -> int:
    """Words of a gram: about half the window, so that a window holds enough grams to choose from."""
    return (length + 1) // 2


def word_list(c: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(c, F.lit(""))), SEPARATORS), "")


def hashed_words(c: Column) -> Column:
    return F.transform(word_list(c), lambda w: F.xxhash64(w))


def _hash_at(words: str, start: Column, n: int, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.get(F.col(words), start + k) for k in range(n)])


def _starts(size: Column, n: int) -> Column:
    return F.when(size >= n, F.sequence(F.lit(0), size - n)).otherwise(F.array().cast("array<int>"))


def minima(df: DataFrame, words: str, length: int, out: str) -> DataFrame:
    """Adds the least gram hash of every window of ``length`` words, in order."""
    k = gram_words(length)
    df = df.select(
        "*",
        computed_once(
            F.transform(_starts(F.size(words), k), lambda i: _hash_at(words, i, k, length))
        ).alias("_grams"),
    )
    grams = length - k + 1
    least = F.transform(
        _starts(F.size("_grams"), grams),
        lambda i: F.least(*[F.get("_grams", i + g) for g in range(grams)]) if grams > 1 else F.get("_grams", i),
    )
    return df.select("*", computed_once(least).alias(out)).drop("_grams")


def runs(df: DataFrame, words: str, length: int) -> DataFrame:
    """A row for each run of windows with the same minimum: start, fingerprint, hashes of the words it spans."""
    df = minima(df, words, length, "_least")
    changes = F.filter(
        F.sequence(F.lit(0), F.size("_least") - 1),
        lambda i: (i == 0) | (F.get("_least", i) != F.get("_least", i - 1)),
    )
    df = df.select("*", computed_once(F.when(F.size("_least") > 0, changes)).alias("_changes"))
    described = F.transform(
        "_changes",
        lambda i, j: F.struct(
            i.alias("start"),
            F.get("_least", i).alias("fingerprint"),
            F.slice(words, i + 1, F.coalesce(F.get("_changes", j + 1), F.size("_least")) - i + length - 1).alias("span"),
        ),
    )
    return df.select(*KEY, F.inline(described))


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """A row for each window of each item: length, hashes of its words as one key, fingerprint, item."""
    words = items.select(
        F.col(item_id).cast("string").alias("item"), computed_once(hashed_words(F.col(text))).alias("words")
    ).where(F.size("words") > 0)
    return words.withColumn("length", F.least(F.size("words"), F.lit(window)))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    share: int = SHARE,
) -> DataFrame:
    """``docs`` with ``n_words n_hit n_items items_sha256 contaminated``."""
    return under_own_names(
        docs, ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        lambda plain, own: _decontaminate(plain, items, own[doc_id], own[text], item_id, item_text, window, share),
    )


def _decontaminate(
    docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, window: int, share: int
) -> DataFrame:
    keyed = with_row_key(docs, doc_id, text)
    hashed = keyed.select(*KEY, computed_once(hashed_words(F.col(text))).alias("words"))
    listed = item_windows(items, item_id, item_text, window)
    lengths = sorted(r[0] for r in listed.select("length").distinct().collect())  # at most ``window`` numbers
    if len(lengths) > 1:
        hashed = materialise(hashed, "hashed-words")  # texts are cut into words once, whatever the lengths
    hits = None
    for length in lengths:
        of = minima(listed.where(F.col("length") == length), "words", length, "least")
        of = materialise(
            of.select(
                "item",
                F.inline(F.transform(
                    "least",
                    lambda v, i: F.struct(v.alias("fingerprint"), *_window_keys(F.slice("words", i + 1, length))),
                )),
            ).distinct(),
            "item-windows",
        )
        found = runs(hashed, "words", length).join(of.select("fingerprint").distinct(), "fingerprint", "left_semi")
        spans = found.select(
            *KEY,
            F.inline(F.transform(
                F.sequence(F.lit(0), F.size("span") - length),
                lambda i: F.struct(
                    (F.col("start") + i).alias("start"), *_window_keys(F.slice("span", i + 1, length))
                ),
            )),
        )
        found = spans.join(of.select("w1", "w2", "item"), ["w1", "w2"]).select(
            *KEY, "start", F.lit(length).alias("length"), "item"
        )
        hits = found if hits is None else hits.unionByName(found)
    n_words = F.size(word_list(F.col(text))).cast("long").alias("n_words")
    if hits is None:
        return keyed.select(
            "*", n_words, F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"),
            sha256_hex(F.lit("")).alias("items_sha256"), F.lit(False).alias("contaminated"),
        ).drop(*KEY)
    per_doc = hits.groupBy(*KEY).agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.sort_array(F.collect_set("item")).alias("items"),
    )
    ends = lambda x: x["start"] + x["length"]
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], ends(x)).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), ends(x) - F.greatest(acc["end"], x["start"]))).alias("n"),
        ),
    )["n"]
    per_doc = per_doc.select(
        *KEY,
        covered.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.array_join("items", ",").alias("items"),
    )
    judged = keyed.select("*", n_words).join(per_doc, KEY, "left").fillna(0, ["n_hit", "n_items"])
    return judged.select(
        *docs.columns, "n_words", "n_hit", "n_items", sha256_hex(F.col("items")).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def _window_keys(words: Column) -> list[Column]:
    """The words of a window as 128 bits."""
    return [F.xxhash64(F.lit(1), words).alias("w1"), F.xxhash64(F.lit(2), words).alias("w2")]


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents
), item_words AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS w
  FROM (SELECT item_id, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i
        FROM (SELECT item_id, ws, least(13, len(ws)) AS m FROM item_words WHERE len(ws) > 0))
), doc_windows AS (
  SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS w
  FROM (SELECT doc_id, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i
        FROM words, (SELECT DISTINCT m FROM item_windows) WHERE len(ws) >= m)
), hits AS (
  SELECT doc_id, item_id, i, m FROM doc_windows JOIN item_windows USING (m, w)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hits))
  GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
