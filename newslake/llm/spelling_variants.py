"""Spelling variants by PartEnum: exact signatures of letter multisets.

A word's letters, numbered (the first e, the second e, ...), are a binary vector. Words that differ by one inserted,
deleted or replaced letter have vectors at a Hamming distance of one or two. The dimensions are dealt over ``PARTS``
parts; two differing dimensions touch at most two parts, so vectors that near agree on all of the other parts. Each vector has
one signature for every choice of two parts to leave out: a hash of what the others hold. Vectors that share a
signature meet in an equi-join and are verified. Anagrams have one vector, so the join is between distinct multisets,
never between all words of a group; words of one multiset are never near.

A signature with more than ``GROUP`` multisets (short vectors, or a huge vocabulary) is split by a second,
independent dealing: near vectors agree on some signature of that one too.

Multisets one or two letters apart also say which letter must go: each word leaves it out at each of its places, and
words near to each other then agree on the rest and the place. This is an equi-join too, linear in the words of both
multisets; its pairs are words at distance one exactly.

Cases: null texts have no words; a null id counts as empty text; repeated rows count as often as they stand. An empty
table gives an empty result. Words of any length are taken whole. Other columns than id and text are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newslake.functions.once import computed_once
from newslake.llm.common import lower_ascii, table
from newslake.session import materialise, small_side

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 6, 5
DELETED_EVERY = 199
RATIO = 5  # a form is so many times as frequent
PARTS, LEFT_OUT = 7, 2
GROUP = 2048


def word_counts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    deleted_every: int | None = DELETED_EVERY,
) -> DataFrame:
    """``word n`` over whole texts; one in ``deleted_every`` hashes loses a letter (none with ``None``)."""
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"),
    ).where(F.char_length("run") >= least_length)
    word = lower_ascii(F.col("run"))
    if deleted_every:
        h = F.crc32(F.concat("id", F.lit(":"), word).cast("binary"))
        at = (h % F.char_length("run")).cast("int")
        cut = F.concat(F.substring(word, F.lit(1), at), F.substr(word, at + 2))
        word = F.when(h % deleted_every == 0, cut).otherwise(word)
    words = runs.select(computed_once(word).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def letters_of(word: Column) -> Column:
    return F.array_join(F.array_sort(F.split(word, "")), "")


def dimensions(letters: str) -> Column:
    """Numbered letters of a string, sorted: one integer each, the letter above bit 20."""
    one = F.array_sort(F.array_distinct(F.split(F.col(letters), "")))
    times = lambda c: F.char_length(letters) - F.char_length(F.replace(F.col(letters), c, F.lit("")))
    return F.flatten(F.transform(
        one, lambda c: F.transform(F.sequence(F.lit(0), times(c) - 1), lambda i: F.shiftleft(F.ascii(c), 20) + i)
    ))


def signatures(vectors: DataFrame, seed: int, parts: int, *key: str) -> DataFrame:
    """``vectors`` with a row for each choice of parts left out: ``sig``."""
    def content(p: int) -> Column:
        return F.filter("dims", lambda x: F.pmod(F.xxhash64(F.lit(seed), x), F.lit(parts)) == p)

    held = [F.xxhash64(content(p)).alias(f"p{p}") for p in range(parts)]
    kept = list(combinations(range(parts), parts - LEFT_OUT))
    sig = F.array(*[F.xxhash64(F.lit(i), *key, *[F.col(f"p{p}") for p in chosen]) for i, chosen in enumerate(kept)])
    return vectors.select("*", *held).select(*[c for c in vectors.columns if c not in key], F.explode(sig).alias("sig"))


def near_multisets(words: DataFrame, parts: int = PARTS, group: int = GROUP) -> DataFrame:
    """``a b x y``: pairs of multisets that differ by letter ``x`` of a, letter ``y`` of b, or both."""
    vectors = words.select(letters_of(F.col("word")).alias("letters")).distinct()
    vectors = vectors.select("letters", computed_once(dimensions("letters")).alias("dims"))
    signed = materialise(signatures(vectors, 1, parts), "signatures")
    hot = small_side(signed.groupBy("sig").count().where(F.col("count") > group).select("sig"), "hot-signatures")
    split = signatures(signed.join(hot, "sig", "left_semi"), 2, parts, "sig")
    signed = signed.join(hot, "sig", "left_anti").select("letters", "dims", "sig").unionByName(split)
    a = signed.select("sig", F.col("letters").alias("a"), F.col("dims").alias("da"))
    b = signed.select("sig", F.col("letters").alias("b"), F.col("dims").alias("db"))
    met = a.join(b, "sig").where("a < b AND abs(size(da) - size(db)) <= 1")
    shared = F.size(F.array_intersect("da", "db"))
    near = met.where(F.size("da") + F.size("db") - 2 * shared <= 2)
    letter = lambda own, other: F.char(F.shiftright(F.get(F.array_except(own, other), F.lit(0)), 20))
    return near.select("a", "b", letter("da", "db").alias("x"), letter("db", "da").alias("y")).distinct()


def _rests(pairs: DataFrame, words: DataFrame, side: str, out: str, other: str) -> DataFrame:
    """Words of one side of each pair without its own letter, at each place where they have it."""
    of = words.select(letters_of(F.col("word")).alias(side), "word", "n")
    i = F.col("i")
    places = F.when(F.col(out).isNull(), F.array(F.lit(-1))).otherwise(
        F.filter(F.sequence(F.lit(0), F.char_length("word") - 1), lambda k: F.substr("word", k + 1, F.lit(1)) == F.col(out))
    )
    rest = F.when(i < 0, F.col("word")).otherwise(F.concat(F.substr("word", F.lit(1), i), F.substr("word", i + 2)))
    place = F.when(F.col(out).isNotNull() & F.col(other).isNotNull(), i).otherwise(-1)
    return (
        pairs.join(of, side)
        .select("pair", "word", "n", out, other, F.explode(places).alias("i"))
        .select(F.xxhash64("pair", rest, place).alias("key"), "word", "n")
    )


def near_words(words: DataFrame, parts: int = PARTS, group: int = GROUP) -> DataFrame:
    """``word n near near_n``: words at distance one, in both directions. ``words`` has ``word n``, each word once."""
    pairs = materialise(near_multisets(words, parts, group), "near-multisets")
    pairs = pairs.withColumn("pair", F.xxhash64("a", "b"))
    left = _rests(pairs, words, "a", "x", "y")
    right = _rests(pairs, words, "b", "y", "x").select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    # Keys are hashes, and a doubled letter can go at two places: exact and once.
    found = left.join(right, "key").where(F.levenshtein("word", "near", 1) == 1).drop("key").distinct()
    back = found.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.unionByName(back)


def roots(forms: DataFrame) -> DataFrame:
    """``word root``: the last form of each word that has one. Links double in length with every pass, so a chain of
    forms, each ``RATIO`` times as frequent as the one before, takes five passes at most."""
    links = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        longer = links.join(onward, "root", "left").select(
            "word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")
        )
        longer = materialise(longer, "roots")
        links = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return links


def spelling_variants(words: DataFrame, ratio: int = RATIO, parts: int = PARTS, group: int = GROUP) -> DataFrame:
    """``word form root n n_near form_n`` for a table ``word n``."""
    words = materialise(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near").alias("near")))
    near = near_words(words, parts, group).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    often = -F.col("best.minus_n") >= ratio * F.col("n")
    near = materialise(near.select(
        "word", "n_near",
        F.when(often, F.col("best.near")).alias("form"),
        F.when(often, -F.col("best.minus_n")).alias("form_n"),
    ), "near-words")
    last = roots(near.where("form IS NOT NULL"))
    return words.join(near, "word", "left").join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n",
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents")))


SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
), lowered AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM runs WHERE length(run) >= 6 GROUP BY ALL
), bytes AS (
  SELECT run, times, list_transform(range(1, len(h), 2), lambda p: ('0x' || substr(h, p, 2))::BIGINT) AS b
  FROM (SELECT run, times, hex(encode(doc_id || ':' || run)) AS h FROM lowered)
), hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS h
  FROM bytes, crc_table
), cut AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times
  FROM hashed
), words AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), rests AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM rests a JOIN rests b ON a.rest = b.rest AND a.i = b.i AND a.word != b.word
  UNION SELECT r.word, w.word, w.n FROM rests r JOIN words w ON r.rest = w.word
  UNION SELECT w.word, r.word, r.n FROM rests r JOIN words w ON r.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM near GROUP BY word
), linked AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root, form AS next FROM linked
  UNION ALL
  SELECT c.word, l.word, l.form FROM chain c JOIN linked l ON l.word = c.next
)
SELECT l.word, form, c.root, n, n_near, form_n FROM linked l JOIN chain c ON c.word = l.word AND c.next IS NULL
"""
