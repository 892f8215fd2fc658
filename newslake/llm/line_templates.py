"""Line dedup by a log-template tree of fixed depth. DataFrame operations only.

A line is parsed by its number of tokens and its leading tokens into a leaf. In a leaf, a token is constant if it stands
at its place in more than half of the distinct lines, any other is a variable field. Numbers are variable from the
start. If a leaf has as many rows as a template needs documents, and enough of its places behind the leading tokens are
constant, the constants are its template, and the lines that have all of them belong to it. One of the leading tokens
may itself be a variable field: lines without a template are entered again, in a leaf with a wildcard at each of these
places. A line that is repeated as it is, is a template of its own. A template that occurs in several documents recurs:
its lines are dropped from all documents but the first. Copies of a whole text count as one document; they are left to
document dedup.

What is constant is decided by shares of a leaf, so a template is found alike in small and in large tables.

Cases: a null text stays null. Lines of fewer tokens than the tree is deep are never dropped. A document of which
nothing is left has an empty text. Repeated rows are treated alike. Ids may be null or repeated; of equal ids the
text decides which is first. Extra columns pass through, also under the names used here; ``n_lines`` and ``n_dropped``
of the input give way to the results of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newslake.functions.once import computed_once
from newslake.llm.common import KEY, own_names, table, with_row_key, without_lines
from newslake.session import materialise, small_side

DEPTH = 3  # leading tokens of a leaf
MIN_DOCS = 3  # distinct texts
CONSTANT_SHARE = 0.6  # of the places behind the leading tokens, for a template to count
SALTS = 16
BROADCAST_BYTES = 8 << 20  # of hashes, as written
BLANK_RUN = r"[\x20\x09\x0B-\x0D]+"


def token_lines(text: Column) -> Column:
    """An array of tokens for each line; every number is written 0."""
    plain = F.regexp_replace(text, "[0-9]+", "0")
    return F.transform(F.split(plain, "\n"), lambda line: F.array_remove(F.split(line, BLANK_RUN), ""))


def lines(keyed: DataFrame, text: str, *columns: str) -> DataFrame:
    """A row for each line of at least ``DEPTH`` tokens: ``pos n plain line leaves``."""

    def described(w: Column, i: Column) -> Column:
        leading = [F.get(w, F.lit(k)) for k in range(DEPTH)]
        wild = [[F.lit("") if k == free else t for k, t in enumerate(leading)] for free in range(-1, DEPTH)]
        leaves = F.array(*[F.xxhash64(F.lit(free), F.size(w), *path) for free, path in enumerate(wild)])
        joined = F.array_join(w, " ")
        parts = [i.alias("pos"), joined.alias("plain"), F.xxhash64(joined).alias("line")]
        return F.struct(F.size(w).alias("n"), *parts, F.when(F.size(w) > DEPTH, leaves).alias("leaves"))

    shown = keyed.select(*columns, computed_once(token_lines(F.col(text))).alias("_lines"))
    return shown.select(*columns, F.inline(F.transform("_lines", described))).where(F.col("n") >= DEPTH)


def leaf_templates(placed: DataFrame, min_docs: int, constant_share: float) -> DataFrame:
    """``line template``: lines of ``line plain leaf`` that have all constants of a leaf with enough of them."""
    # A leaf with fewer rows holds no template.
    several = placed.groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf")
    several = small_side(several, "open-leaves", BROADCAST_BYTES)
    held = placed.join(several, "leaf").groupBy("leaf", "line").agg(F.first("plain").alias("plain"))
    held = materialise(held.select("leaf", "line", F.split("plain", " ").alias("tokens")), "leaf-lines")
    sizes = held.groupBy("leaf").agg(F.count("*").alias("lines"), F.first(F.size("tokens")).alias("n"))
    constants = (
        held.select("leaf", F.posexplode("tokens").alias("at", "token"))
        .groupBy("leaf", "at", F.xxhash64("token").alias("token")).count()
        .join(small_side(sizes, "leaf-sizes", BROADCAST_BYTES), "leaf")
        .where(2 * F.col("count") > F.col("lines"))
        .groupBy("leaf", "n")
        .agg(F.collect_list(F.struct("at", "token")).alias("constants"))  # one a place at most
    )
    behind = F.size(F.filter("constants", lambda c: c["at"] >= DEPTH))
    templates = constants.where(behind >= constant_share * (F.col("n") - DEPTH)).select("leaf", "constants")
    has = lambda c: F.xxhash64(F.get("tokens", c["at"])) == c["token"]
    found = held.join(templates, "leaf").where(F.forall("constants", has))
    return materialise(found.select("line", F.col("leaf").alias("template")), "leaf-templates")


def line_templates(narrow: DataFrame, min_docs: int, constant_share: float) -> DataFrame:
    """``line template`` of every line that has one."""
    long = narrow.where("leaves IS NOT NULL")
    literal = leaf_templates(
        long.select("line", "plain", F.get("leaves", F.lit(0)).alias("leaf")), min_docs, constant_share
    )
    rest = long.join(small_side(literal.select("line"), "parsed-lines", BROADCAST_BYTES), "line", "left_anti")
    wild = rest.select("line", "plain", F.explode(F.slice("leaves", 2, DEPTH)).alias("leaf"))
    repeated = narrow.groupBy("line").agg(F.count_distinct("digest").alias("docs")).where(F.col("docs") >= min_docs)
    return (
        literal.unionByName(leaf_templates(wild, min_docs, constant_share))
        .unionByName(repeated.select("line", F.col("line").alias("template")))
    )


def recurring_lines(keyed: DataFrame, doc_id: str, text: str, min_docs: int, constant_share: float) -> DataFrame:
    """``_k1 _k2 dropped``: positions of the lines to drop."""
    named = keyed.select(*KEY, F.col(doc_id).alias("id"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    narrow = materialise(lines(named, "text", *KEY, "id", "digest"), "lines")
    templates = line_templates(narrow, min_docs, constant_share)
    # A line may stand in very many documents.
    salted = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = narrow.select(*KEY, "id", "digest", "pos", "line", F.pmod("_k1", F.lit(SALTS)).cast("int").alias("salt"))
    found = materialise(found.join(salted, ["line", "salt"]).select(*KEY, "id", "digest", "pos", "template"), "templates")
    recurring = (
        found.groupBy("template")
        .agg(F.count_distinct("digest").alias("docs"), F.min(F.struct("id", *KEY)).alias("first"))
        .where(F.col("docs") >= min_docs)
    )
    later = (F.col("first._k1") != F.col("_k1")) | (F.col("first._k2") != F.col("_k2"))
    return (
        found.join(small_side(recurring, "recurring", BROADCAST_BYTES), "template").where(later)
        .groupBy(*KEY).agg(F.collect_set("pos").alias("dropped"))  # at most the lines of a document
    )


def drop_recurring_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    constant_share: float = CONSTANT_SHARE,
) -> DataFrame:
    """``docs`` with the shortened text, ``n_lines`` before and ``n_dropped``."""
    plain, names = own_names(docs)
    doc_id, text = names[doc_id], names[text]
    keyed = with_row_key(plain, doc_id, text)
    dropped = recurring_lines(keyed, doc_id, text, min_docs, constant_share)
    joined = keyed.join(dropped, KEY, "left")
    joined = joined.select("*", computed_once(F.split(text, "\n")).alias("_split"))
    shortened = without_lines("_split", "dropped")
    results = {
        "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size("_split")).cast("long"),
        "n_dropped": F.coalesce(F.size("dropped"), F.lit(0)).cast("long"),
    }
    return joined.select(
        *[
            F.when(F.col("dropped").isNull(), F.col(own)).otherwise(shortened).alias(c) if own == text else F.col(own).alias(c)
            for c, own in names.items() if c not in results
        ],
        *[c.alias(name) for name, c in results.items()],
    )


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_recurring_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


# Lines of a table of leaves with all constants of a leaf that has enough of them.
_LEAVES = """{0}_open AS (
  SELECT leaf, count(DISTINCT line) AS lines FROM {0} GROUP BY leaf HAVING count(*) >= 3
), {0}_tokens AS (
  SELECT leaf, line, n, unnest(toks) AS token, generate_subscripts(toks, 1) AS place
  FROM (SELECT DISTINCT leaf, line, n, toks FROM {0} SEMI JOIN {0}_open USING (leaf))
), {0}_constants AS (
  SELECT leaf, place, token, any_value(n) AS n FROM {0}_tokens JOIN {0}_open USING (leaf)
  GROUP BY leaf, place, token, lines HAVING 2 * count(*) > lines
), {0}_templates AS (
  SELECT leaf, count(*) AS wanted FROM {0}_constants GROUP BY leaf, n HAVING count(*) FILTER (place > 3) >= 0.6 * (n - 3)
), {1} AS (
  SELECT line, leaf AS template FROM {0}_tokens JOIN {0}_constants USING (leaf, place, token) JOIN {0}_templates USING (leaf)
  GROUP BY leaf, line, wanted HAVING count(*) = wanted
)"""
SQL = r"""
WITH lines AS (
  SELECT doc_id, digest, pos, toks, array_to_string(toks, ' ') AS line, len(toks) AS n
  FROM (
    SELECT doc_id, digest, pos, list_filter(string_split_regex(regexp_replace(l, '[0-9]+', '0', 'g'), '[\x20\x09\x0B-\x0D]+'), lambda w: w <> '') AS toks
    FROM (SELECT doc_id, md5(text) AS digest, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
  ) WHERE len(toks) >= 3
), held AS (
  SELECT line, toks, n, '0 ' || toks[1] || ' ' || toks[2] || ' ' || toks[3] || ' ' || n AS leaf FROM lines WHERE n > 3
), LEAVES(held, literal)
, wild AS (
  SELECT line, toks, n, unnest(['1 ' || toks[2] || ' ' || toks[3], '2 ' || toks[1] || ' ' || toks[3],
    '3 ' || toks[1] || ' ' || toks[2]]) || ' ' || n AS leaf
  FROM lines WHERE n > 3 AND line NOT IN (SELECT line FROM literal)
), LEAVES(wild, free)
, templates AS (
  SELECT * FROM literal UNION ALL SELECT * FROM free UNION ALL SELECT DISTINCT line, 'line ' || line FROM lines
), found AS (
  SELECT doc_id, digest, pos, template FROM lines JOIN templates USING (line)
), recurring AS (
  SELECT template, min(doc_id) AS first FROM found GROUP BY template HAVING count(DISTINCT digest) >= 3
), dropped AS (
  SELECT DISTINCT doc_id, pos FROM found JOIN recurring USING (template) WHERE doc_id <> first
), remaining AS (
  SELECT doc_id, count(*) AS n_lines, count(p.pos) AS n_dropped,
         coalesce(string_agg(CASE WHEN p.pos IS NULL THEN l END, chr(10) ORDER BY a.pos), '') AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) a
  LEFT JOIN dropped p USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
       sha256(coalesce(r.text, '')) AS text_sha256
FROM documents d LEFT JOIN remaining r USING (doc_id)
""".replace("LEAVES(held, literal)\n", _LEAVES.format("held", "literal")).replace("LEAVES(wild, free)\n", _LEAVES.format("wild", "free"))
