"""Queries without SQL over whole tables: secrets against plain patterns, languages against what addresses say."""

from __future__ import annotations

import hashlib
import re

from newslake.llm import queries

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def test_secrets_of_the_whole_table(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest table has no secrets
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op4_secrets"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    total = 0
    for r in rows:
        spans = plain_spans(texts[r["doc_id"]] or "")
        listed = ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        assert set(filter(None, listed.split(","))) <= set(filter(None, r["spans"].split(",")))
        total += len(spans)
    assert total > 0


def test_languages_of_the_whole_table(spark, sf_dir):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.QUERIES["op5_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    said = [(re.search("://[^/]*/([a-z]{2})/", pages[r["page_id"]])[1], r["lang"]) for r in rows]
    assert sum(a == b for a, b in said) >= 0.95 * len(said)
