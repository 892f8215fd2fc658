from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from newslake.functions import tags, text
from newslake.functions.dates import iso_or_empty, normalise_date
from newslake.sources.newsapi import source_name


def values(spark, column, inputs, kind="STRING"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i INT, c {kind}")
    return [r["v"] for r in rows.orderBy("i").select(column.alias("v")).collect()]


def test_article_id_is_the_same_for_the_same_url(spark):
    got = values(spark, text.article_id(F.col("c")), ["https://x.example/a", "https://x.example/a", "https://x.example/é"])
    assert got[0] == got[1] == hashlib.md5(b"https://x.example/a").hexdigest()
    assert got[2] == hashlib.md5("https://x.example/é".encode()).hexdigest()


def test_first_filled_skips_null_and_empty(spark):
    row = spark.createDataFrame([(None, "", "c")], "a STRING, b STRING, c STRING")
    assert row.select(text.first_filled(F.col("a"), F.col("b"), F.col("c"))).first()[0] == "c"
    assert row.select(text.first_filled(F.col("a"), F.col("b"))).first()[0] == ""


def test_default_only_for_a_missing_key(spark):
    bodies = ['{"source": {"name": "T"}}', '{"source": {"id": 1}}', '{"source": {"name": null}}', "{}"]
    assert values(spark, source_name(F.col("c")), bodies) == ["T", "NewsAPI", None, "NewsAPI"]


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [
        ("https://www.example.org:8080/a/b?q#f", "example.org:8080", "/a/b"),
        ("http://user@www.x.org", "user@www.x.org", ""),
        ("//www.x.org/p", "x.org", "/p"),
        ("not a url|", "", "not a url|"),
        ("https://wwww.x.org/é é", "wwww.x.org", "/é é"),
    ],
)
def test_url_parts(spark, url, host, path):
    assert values(spark, text.source_host(F.col("c")), [url]) == [host]
    assert values(spark, text.url_path(F.col("c")), [url]) == [path]


def test_repo_name(spark):
    urls = ["https://api.github.com/repos/a/b/releases", "https://api.github.com/repos//a/b", "https://x.org/users/a/b", "https://x.org/repos/a"]
    assert values(spark, text.repo_name(F.col("c")), urls) == ["a/b", "a/b", "", ""]


def test_strip_removes_unicode_white_space(spark):
    assert values(spark, text.strip(F.col("c")), ["　\t a b \n", ""]) == ["a b", ""]


def test_split_tags(spark):
    got = values(spark, text.split_tags(F.col("c")), [None, "", " a ,, b,", "x"])
    assert got == [[], [], ["a", "b"], ["x"]]


def test_expand_query(spark):
    rows = spark.createDataFrame([("q", ["a", "b"]), ("q", []), ("q", None)], "q STRING, t ARRAY<STRING>")
    got = [r[0] for r in rows.select(text.expand_query(F.col("q"), F.col("t"))).collect()]
    assert got == ["q | a, b", "q", "q"]


def test_chunk_ids_split_at_the_last_dash(spark):
    ids = ["hn-12-0", "a-1", "a-b", "12", "a-", "-7", "x-1\n2-3"]
    assert values(spark, text.chunk_article(F.col("c")), ids) == ["hn-12", "a", None, None, None, "", "x-1\n2"]
    assert values(spark, text.chunk_index(F.col("c")), ids) == [0, 1, None, None, None, 7, 3]


def test_answers_of_model_replies(spark):
    raw = ['{"answer": " a "}', ' {"other": 1} ', "plain\n", '["answer"]', '{"answer": 3}', '{"answer": null}']
    got = values(spark, text.extract_answer(F.col("c")), raw)
    assert got == [" a ", '{"other": 1}', "plain", '["answer"]', "3", '{"answer": null}']


def test_recent_means_less_than_eight_days(spark):
    dates = ["2024-01-02 00:00:01", "2024-01-02 00:00:00", "2024-01-10 00:00:00", None]
    recent = text.is_recent(F.col("c").cast("timestamp"), F.lit("2024-01-10").cast("timestamp"))
    assert values(spark, recent, dates) == [True, False, True, False]


def test_dates(spark):
    cases = {
        "2024-01-15T10:00:00Z": "2024-01-15T10:00:00+00:00",
        "2024-01-15T10:00:00+0200": "2024-01-15T08:00:00+00:00",
        "2024-01-15T10:00:00.5-05:30": "2024-01-15T15:30:00+00:00",
        "2024-01-15": "2024-01-15T00:00:00+00:00",
        "2024-01-15 10": "2024-01-15T10:00:00+00:00",
        "Mon, 15 Jan 2024 10:00:00 GMT": "2024-01-15T10:00:00+00:00",
        "15 Jan 24 10:00 EST": "2024-01-15T15:00:00+00:00",
        " Mon, 5 Feb 1999 1:02:03 +0130 ": "1999-02-04T23:32:03+00:00",
        "about 15 Jan 2024 10:00:00": "",
        "2024-13-45": "",
        "2024": "",
        "": "",
        None: "",
    }
    assert values(spark, iso_or_empty(normalise_date(F.col("c"))), list(cases)) == list(cases.values())


def test_tags_match_inside_words_and_are_sorted(spark):
    got = values(spark, tags.detect_tags(F.col("c"), F.lit("On AWS")), ["wellmeant Docker", "nothing"])
    assert got == [["DevOps", "FinOps", "LLM"], ["FinOps"]]
    whole = tags.detect_tags(F.col("c"), whole_words=True)
    assert values(spark, whole, ["wellmeant ci/cd", "an llm."]) == [["DevOps"], ["LLM"]]


def test_tags_of_missing_text(spark):
    assert values(spark, tags.detect_tags(F.col("c")), [None]) == [[]]
