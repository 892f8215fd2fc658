"""URL filters as a sort-merge range join.

A rule is a host and the start of a path; it fits the host and its subdomains. Hosts are written in reverse
(``org.example``), and a url is entered once for each of its host suffixes, so that a rule's urls lie in one interval
of the order by reversed host and path. Rules and urls are sorted together; a sweep keeps the stack of the rules whose
interval is open, each nested in the one below, and a url takes the one on top. The longest of a url's rules wins.

Hosts such as ``com`` have a large share of all urls, so each host is dealt over salts, with its rules in each.
The sweep holds no more than the open rules of one host.

Cases: a null url, or one without ``://``, has an empty host and path and no rule. Of equal rules that disagree, block
wins. Rules without host are ignored. Without a rule the verdict is ``allow``. Repeated rows get the same verdict each.
Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newslake.llm.common import KEY, lower_ascii, table, under_own_names, with_row_key

SALTS = 32
DEFAULT = "allow"
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def suffixes(host: Column) -> Column:
    """The host and every part of it behind a dot, reversed: ``org``, ``org.example``, ``org.example.www``."""
    labels = F.reverse(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, 1, n), "."))


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of rules and urls in order to a row for each url with an open rule."""
    at, stack = None, []
    for batch in batches:
        found = []
        for host, salt, path, verdict, rule, k1, k2 in batch.itertuples(index=False):
            if at != (host, salt):
                at, stack = (host, salt), []
            while stack and not path.startswith(stack[-1][0]):
                stack.pop()
            if rule is not None:
                stack.append((path, rule, verdict))
            elif stack:
                found.append((k1, k2, stack[-1][1], stack[-1][2]))
        out = pd.DataFrame(found, columns=[*KEY, "rule", "verdict"])
        yield out.astype({k: "int64" for k in KEY})


def filter_urls(
    pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = DEFAULT
) -> DataFrame:
    """``pages`` with ``host path rule verdict``. ``rules`` has ``verdict host path``."""
    return under_own_names(
        pages, ["host", "path", "rule", "verdict"], lambda plain, own: _filter_urls(plain, rules, own[page_id], own[url], default)
    )


def _filter_urls(pages: DataFrame, rules: DataFrame, page_id: str, url: str, default: str) -> DataFrame:
    keyed = with_row_key(pages, page_id, url)
    host, path = url_host(F.col(url)), url_path(F.col(url))
    ruled = rules.where("host IS NOT NULL AND host != ''").select(
        reversed_host(lower_ascii(F.col("host"))).alias("rhost"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
        F.coalesce("path", F.lit("")).alias("path"),
        "verdict",
        F.concat("host", F.coalesce("path", F.lit(""))).alias("rule"),
        *[F.lit(0).cast("long").alias(k) for k in KEY],
    )
    urls = keyed.select(*KEY, path.alias("path"), F.explode(suffixes(host)).alias("rhost"))
    urls = urls.join(ruled.select("rhost").distinct(), "rhost", "left_semi").select(
        "rhost",
        F.pmod(F.col("_k1"), F.lit(SALTS)).cast("int").alias("salt"),
        "path",
        F.lit(None).cast("string").alias("verdict"),
        F.lit(None).cast("string").alias("rule"),
        *KEY,
    )
    swept = (
        ruled.unionByName(urls)
        .repartition("rhost", "salt")
        .sortWithinPartitions("rhost", "salt", "path", F.col("rule").isNull(), "verdict")
        .mapInPandas(sweep, "_k1 long, _k2 long, rule string, verdict string")
    )
    best = swept.groupBy(*KEY).agg(
        F.max(F.struct(F.char_length("rule").alias("n"), "rule", "verdict")).alias("best")
    )
    return keyed.join(best, KEY, "left").select(
        *pages.columns,
        host.alias("host"),
        path.alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, spark.createDataFrame(RULES, "verdict string, host string, path string")).drop("url")


SQL = r"""
WITH rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), urls AS (
  SELECT page_id,
    translate(CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1) ELSE '' END,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), fits AS (
  SELECT u.page_id, r.verdict, r.host || r.path AS rule,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC) AS n
  FROM urls u JOIN rules r
    ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON f.page_id = u.page_id AND f.n = 1
"""
