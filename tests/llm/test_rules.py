"""Line frequency, line templates and decontamination: corner cases and their SQL."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from newslake.llm import decontaminate, language_id, line_frequency, line_templates, near_dedup, queries, url_filter
from newslake.llm.decontaminate import decontaminate as clean

DOCS = "doc_id long, text string, source string, n_words string"  # one column clashes with an output
TABLES = "documents pages benchmark embeddings".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def bag(frame):
    columns = sorted(frame.columns)

    def shown(v):
        """A column of numbers with nulls may come as floats or as integers."""
        if v is None or v is pd.NA or v != v:
            return "∅"
        return str(int(v) if isinstance(v, float) and v.is_integer() else v)

    return columns, sorted(tuple(map(shown, row)) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got = bag(queries.QUERIES[name](spark, sf_dir).toPandas())
    assert got == bag(duck.execute(queries.ORACLES[name]).df())
    assert got[1]


def odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, None, "a"), (2, "", "a"), (None, "x y z", None), (3, long, "a"), (3, long, "a"), (4, "a b a b a b a b", "b"),
        (5, "\n\n \t\n", "b"), (None, None, None), (6, "é\u00a0ü # $ \x0b|", "b"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_base_counts_by_hand(spark):
    got = {r["doc_id"]: r for r in line_frequency.base_counts(odd_rows(spark).where("doc_id >= 4")).collect()}
    assert got[4]["n_words"] == 8 and got[4]["n_repeat_words"] == 8
    assert got[5]["n_words"] == 0 and got[5]["n_dup_lines"] == 0 and got[5]["base_failed"]
    assert (got[6]["n_words"], got[6]["word_chars"], got[6]["n_symbols"]) == (4, 6, 3)


def test_repeated_windows_by_brute_force(spark):
    import random

    random.seed(3)
    texts = [" ".join(random.choices("abc", k=random.randint(0, 40))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in line_frequency.base_counts(rows).collect()}
    for i, text in enumerate(texts):
        w = text.split()
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        assert got[i] == len({k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)})


def test_frequent_line_stays_in_first_document_only(spark):
    letters = str.maketrans("0123456789", "abcdefghij")
    own = lambda i: " ".join(f"w{i}x{k}".translate(letters) for k in range(60))
    rows = [(i, f"Shared  Line {i}\n{own(i)}", "h") for i in range(10)] + [(99, "shared line 7", "h")]
    rows += [(200 + i, own(500), "h") for i in range(15)]  # copies of one text are one document
    got = {r["doc_id"]: r for r in line_frequency.line_frequency(
        spark.createDataFrame(rows, "doc_id long, text string, source string"), line_docs=5
    ).collect()}
    assert got[0]["clean_text"].startswith("Shared") and got[0]["n_boilerplate_words"] == 0
    assert all(got[i]["n_boilerplate_words"] == 3 and got[i]["clean_text"] == own(i) for i in range(1, 10))
    assert got[99]["clean_text"] == "" and not got[99]["kept"]
    assert all(got[200 + i]["kept"] for i in range(15))


def test_odd_rows_and_empty_tables(spark):
    docs = odd_rows(spark)
    empty = docs.limit(0)
    items = spark.createDataFrame([(1, "w5 w6 w7"), (None, "w5"), (2, None), (3, "")], "item_id long, text string")
    for run in (
        line_frequency.line_frequency, line_templates.drop_recurring_lines, near_dedup.near_dedup,
        lambda d: clean(d, items), lambda d: clean(d, items.limit(0)),
    ):
        assert run(docs).count() == docs.count()
        assert run(empty).count() == 0


def test_templates_drop_variable_lines(spark):
    line = "user {} logged in from host {} at the office"
    rows = [(i, f"Own text number {i} with {chr(97 + i) * 5} inside it\n{line.format(chr(97 + i) * 4, i)}") for i in range(6)]
    got = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(
        spark.createDataFrame(rows, "doc_id long, text string"), constant_share=0.8
    ).collect()}
    assert got[0]["n_dropped"] == 0
    assert all("logged" not in got[i]["text"] for i in range(1, 6))


def dropped_lines(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["n_dropped"] for r in line_templates.drop_recurring_lines(docs).orderBy("doc_id").collect()]


@pytest.mark.parametrize("n", [150, 6000])
def test_templates_are_found_alike_in_small_and_large_tables(spark, n):
    """Two fields of 200 values behind the leading tokens."""
    name = lambda i, step: chr(97 + i * step % 200 // 26) + chr(97 + i * step % 200 % 26)
    texts = [f"the order of {name(i, 1)} was sent to {name(i, 7)} by the night train" for i in range(n)]
    assert dropped_lines(spark, texts) == [0] + [1] * (n - 1)


def test_short_lines_with_a_common_opening_survive(spark):
    assert dropped_lines(spark, ["The old man sang.", "The old man ate.", "The old man left."]) == [0, 0, 0]
    assert dropped_lines(spark, ["The old man sang.", "The old man sang.\nx", "y\nThe old man sang."]) == [0, 1, 1]


@pytest.mark.parametrize("size", [500, 5000])
def test_line_limits_are_alike_in_hosts_of_every_size(spark, size):
    own = lambda i: " ".join(f"{chr(97 + i % 26)}{i}w{k}" for k in range(60))
    digits = str.maketrans("0123456789", "zyxvutsrqp")
    rows = [(i, own(i).translate(digits) + ("\nall rights reserved" if i < 40 else ""), "h") for i in range(size)]
    got = line_frequency.line_frequency(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got.where("n_boilerplate_words > 0").count() == 39


def test_a_line_stays_in_a_document_that_stays(spark):
    """The least id is rejected, so it can't be the one that keeps the line."""
    digits = str.maketrans("0123456789", "zyxvutsrqp")
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60)).translate(digits)
    rows = [(0, "Our terms of use", "h")] + [(i, f"{own(i)}\nOur terms of use", "h") for i in range(1, 14)]
    got = {r["doc_id"]: r for r in line_frequency.line_frequency(
        spark.createDataFrame(rows, "doc_id long, text string, source string")
    ).collect()}
    assert not got[0]["kept"] and got[0]["clean_text"] == ""
    assert [i for i in got if "terms" in got[i]["clean_text"]] == [1]
    assert all(got[i]["kept"] for i in range(1, 14))


CLASHING = (
    "n_words n_lines n_dropped dropped _k1 _k2 _words kept clean_text host line template n_hit items_sha256 item best rule path "
    "verdict lang declared ll _node _th component_id n_shingles node class page page_id"
).split()


def runs(spark):
    items = spark.createDataFrame([(1, "shared by all texts")], "item_id long, text string")
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    known = spark.createDataFrame([("some text here", "en"), ("autre texte ici", "fr")], "text string, lang string")
    return {
        "op1": (line_frequency.line_frequency, {"n_words", "kept", "clean_text"}),
        "op3": (lambda d: clean(d, items), {"n_words", "n_hit", "items_sha256"}),
        "op5": (lambda d: language_id.language_of(d, known, page_id="doc_id", url="source", html="text"), {"host", "declared", "lang"}),
        "op7": (near_dedup.near_dedup, {"n_shingles", "component_id", "kept"}),
        "op9": (line_templates.drop_recurring_lines, {"n_lines", "n_dropped"}),
        "op10": (lambda d: url_filter.filter_urls(d, rules, page_id="doc_id", url="source"), {"host", "path", "rule", "verdict"}),
    }


@pytest.mark.parametrize("name", ["op1", "op3", "op5", "op7", "op9", "op10"])
def test_columns_of_the_input_may_have_any_name(spark, name):
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHING)
    text = lambda i: f"text number {chr(97 + i)} of all\nshared by all texts"
    rows = [(i, text(i), "https://a.example.org/fr/", *[c + str(i) for c in CLASHING]) for i in range(4)]
    run, results = runs(spark)[name]
    got = run(spark.createDataFrame(rows, schema))
    assert len(set(got.columns)) == len(got.columns) and {"doc_id", "text", "source", *CLASHING} <= set(got.columns)
    found = got.collect()
    assert len(found) == 4
    for r in found:
        assert all(r[c] == c + str(r["doc_id"]) for c in CLASHING if c not in results)


def test_decontamination_by_brute_force(spark):
    import random

    random.seed(5)
    word = lambda: random.choice("ab")
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([13, 20, 5, 1, 0, 14])]
    docs = [(i, " ".join(word() if random.random() < 0.9 else "c" for _ in range(random.randint(0, 80)))) for i in range(40)]
    docs += [(100, "X " + items[1][1].upper() + " y")]
    got = {r["doc_id"]: r for r in clean(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()}
    for i, text in docs:
        w, hit, found = text.lower().split(), set(), set()
        for item, t in items:
            v = t.split()
            m = min(13, len(v))
            windows = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if v else set()
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    found.add(str(item))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"]) == (len(w), len(hit), len(found))


def test_url_rules_by_brute_force(spark):
    import itertools

    hosts = ["com", "a.com", "A.Com", "xcom", "example.org", "w.example.org", ".org", "org.", ""]
    paths = ["", "/", "/fr/x", "/de/", "/en/12?q", "/es/#f", "/fr"]
    urls = [f"https://{h}{p}" for h, p in itertools.product(hosts, paths)] + [None, "", "no-scheme.com/fr/", "a://b://c/fr/"]
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)] * 2, "page_id long, url string, extra string")
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    got = url_filter.filter_urls(pages, rules).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        fits = [
            (len(h + p), h + p, v) for v, h, p in url_filter.RULES
            if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)
        ]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert (r["rule"], r["verdict"]) == (rule, verdict)
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
