"""Language of web pages by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the likelihood of the page's text under a model of byte trigrams for each
language, the language that the markup declares, the suffix of the address, and a prior of the host. The text models
count all documents of known language. What a declaration or a suffix is worth, and what a host is like, is learned
from the pages' own text: sums of text posteriors by declaration, suffix, domain and host. A host's prior is
smoothed towards its domain's and that towards the whole table's; a page doesn't count towards its own host's prior.

Cases: a null or empty page has no text evidence and goes by the rest. A declaration that is no two- or three-letter
tag is none, and unlike any other evidence a missing one says nothing. A null url has an empty host. Of equal
posteriors the first language in alphabetical order wins. Without documents of known language the language is null.
Repeated rows count each and get the same answer. Extra columns pass through unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from newslake.llm.common import KEY, table, under_own_names, with_row_key
from newslake.llm.url_filter import url_host
from newslake.session import materialise

BUCKETS = 1 << 15
EVIDENCE = 60.0  # trigrams of text count as so many independent ones at most
SMOOTHING = 5.0  # pages' worth of the level above
FLUSH = 64 << 20  # bytes that a task counts before it hands on

LETTERS = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))
DROPPED = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;")
DECLARED = re.compile(
    r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?\s*([a-z]{2,3})(?![a-z])|<meta\b[^>]*content-language[^>]*content\s*=\s*["']?\s*([a-z]{2,3})(?![a-z])"""
)


def trigrams(text: bytes) -> np.ndarray:
    """Bucket of every three bytes; ASCII letters in lower case, what is no letter as a blank."""
    b = np.frombuffer(text.lower().translate(LETTERS), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    mixed = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return ((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(17)).astype(np.int64)


def page_text(html: str | None) -> bytes:
    return b" ".join(DROPPED.sub(" ", html or "").encode("utf-8", "surrogatepass").split())


def declared_language(html: str | None) -> str | None:
    found = DECLARED.search(html or "")
    return (found[1] or found[2]).lower() if found else None


def count_trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    size = 0

    def out() -> pd.DataFrame:
        at = {lang: np.flatnonzero(n) for lang, n in counts.items()}
        rows = [(lang, bucket, n) for lang, places in at.items() for bucket, n in zip(places, counts[lang][places])]
        counts.clear()
        return pd.DataFrame(rows, columns=["lang", "bucket", "n"])

    for batch in batches:
        for lang in batch["lang"].unique():
            texts = batch["text"][batch["lang"] == lang]
            joined = b"  ".join(t.encode("utf-8", "surrogatepass") for t in texts)
            n = np.bincount(trigrams(joined), minlength=BUCKETS)
            counts[lang] = counts[lang] + n if lang in counts else n
            size += len(joined)
        if size > FLUSH or len(counts) > 256:
            yield out()
            size = 0
    yield out()


def fit(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order and the log probability of every bucket in each."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text")
    )
    counted = known.mapInPandas(count_trigrams, "lang string, bucket int, n long")
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows a language
    langs = sorted(found["lang"].unique())
    n = np.full((len(langs), BUCKETS), 0.5)
    np.add.at(n, (np.searchsorted(langs, found["lang"]), found["bucket"].to_numpy(np.int64)), found["n"].to_numpy())
    return langs, np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(pages: DataFrame, logs: np.ndarray) -> DataFrame:
    """``_k1 _k2 host declared ll``: log likelihoods of at most ``EVIDENCE`` trigrams' weight."""
    n_langs = len(logs)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for html in batch["html"]:
                at = trigrams(page_text(html))
                weight = min(1.0, EVIDENCE / len(at)) if len(at) else 0.0
                ll = logs[:, at].sum(axis=1, dtype=np.float64) * weight if len(at) else np.zeros(n_langs)
                made.append(ll - ll.max())
            yield batch[[*KEY, "host"]].assign(declared=[declared_language(h) for h in batch["html"]], ll=made)

    return pages.mapInPandas(read, "_k1 long, _k2 long, host string, declared string, ll array<double>")


def language_of(
    pages: DataFrame, docs: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``pages`` with ``host declared text_lang lang confidence``."""
    return under_own_names(
        pages, ["host", "declared", "text_lang", "lang", "confidence"],
        lambda plain, own: _language_of(plain, docs, own[page_id], own[url], own[html]),
    )


def _language_of(pages: DataFrame, docs: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    langs, logs = fit(docs)
    keyed = with_row_key(pages, page_id, url, html)
    host = url_host(F.col(url))
    if not langs:
        none = [F.lit(None).cast("string").alias(c) for c in ("declared", "text_lang", "lang")]
        return pages.select("*", host.alias("host"), *none, F.lit(None).cast("double").alias("confidence"))
    read = text_evidence(keyed.select(*KEY, host.alias("host"), F.col(html).alias("html")), logs)
    q = [f"q{i}" for i in range(len(langs))]
    odds = [F.exp(F.col("ll")[i]) for i in range(len(langs))]
    labels = F.split("host", r"\.")
    read = read.select(
        "*",
        F.element_at(labels, -1).alias("suffix"),
        F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".").alias("domain"),
        *[(o / sum(odds[1:], odds[0])).alias(c) for o, c in zip(odds, q)],
    )
    read = materialise(read, "page-evidence")

    def sums(*by: str) -> DataFrame:
        return read.groupBy(*by).agg(*[F.sum(c).alias(f"{c}_{by[-1]}") for c in q])

    total = read.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in q]).first()
    share = [(total[c] + 1) / (sum(total) + len(q)) for c in q]

    def likelihood(column: str) -> DataFrame:
        """``column`` with the log probability of its value in each language."""
        seen = sums(column).where(F.col(column).isNotNull())
        values = seen.count()
        return seen.select(
            column,
            F.array(*[F.log((F.col(f"{c}_{column}") + 0.5) / (total[c] + 0.5 * (values + 1))) for c in q]).alias(f"l_{column}"),
        )

    size = lambda by: sum((F.col(f"{c}_{by}") for c in q[1:]), F.col(f"{q[0]}_{by}"))
    domains = sums("domain").select(
        "domain",
        *[((F.col(f"{c}_domain") + SMOOTHING * s) / (size("domain") + SMOOTHING)).alias(f"p_{c}") for c, s in zip(q, share)],
    )
    suffixes = likelihood("suffix").withColumnRenamed("suffix", "s_suffix")
    hosts = (
        sums("domain", "host").join(domains, "domain").drop("domain")
        .join(suffixes, F.element_at(F.split("host", r"\."), -1) == F.col("s_suffix")).drop("s_suffix")
    )
    own = lambda c: F.greatest(F.col(f"{c}_host") - F.col(c), F.lit(0.0))
    rest = sum((own(c) for c in q[1:]), own(q[0])) + SMOOTHING
    joined = read.join(hosts, "host").join(likelihood("declared"), "declared", "left")
    fused = F.array(*[
        F.col("ll")[i] + F.log((own(c) + SMOOTHING * F.col(f"p_{c}")) / rest) + F.col("l_suffix")[i]
        + F.coalesce(F.col("l_declared")[i], F.lit(0.0))
        for i, c in enumerate(q)
    ])
    names = F.array(*[F.lit(x) for x in langs])
    first = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    judged = joined.select(*KEY, "declared", "ll", fused.alias("fused")).select(
        *KEY, "declared",
        first(F.col("ll")).alias("text_lang"), first(F.col("fused")).alias("lang"),
        (1 / F.aggregate("fused", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.array_max("fused")))).alias("confidence"),
    )
    judged = judged.dropDuplicates(KEY)
    return keyed.select(*[c for c in keyed.columns], host.alias("host")).join(judged, KEY, "left").drop(*KEY)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return language_of(pages, table(spark, sf_dir, "documents")).drop("html", "url")
