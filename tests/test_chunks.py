from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from newslake.functions.chunker import register_split_text, split_text
from newslake.operators.chunking import chunk_articles, chunk_records, fixed_chunks, stored_articles
from newslake.session import prepare


def test_short_text_is_one_chunk():
    assert split_text("A single short sentence.", 100) == ["A single short sentence."]
    assert split_text("  \n ") == [] and split_text(None) == []


def test_sentences_overlap():
    sentence = "Here stands a sentence of about sixty characters in all. "
    chunks = split_text(sentence * 10, 200, 60)
    assert len(chunks) > 1
    assert all(len(c) <= 200 and c.endswith(".") for c in chunks)
    assert chunks[1].startswith(chunks[0][-len(sentence.strip()):])


def test_paragraphs_do_not_mix():
    text = ("One paragraph on snakes. " * 4).strip() + "\n\n" + ("One paragraph on boats. " * 4).strip()
    assert not any("snakes" in c and "boats" in c for c in split_text(text, 120, 0))


def test_long_text_of_short_sentences():
    chunks = split_text("phrase. " * 500, 600)
    assert len(chunks) >= 2 and all(len(c) <= 700 for c in chunks)


def test_text_without_separator_falls_back_to_windows():
    text = "".join(chr(97 + i % 26) for i in range(3000))
    assert [len(c) for c in split_text(text)] == [1200, 1200, 840]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=400), st.integers(5, 60), st.integers(0, 30))
def test_chunks_cover_the_text(text, limit, overlap):
    chunks = split_text(text, limit, overlap)
    assert all(0 < len(c) <= limit and c in text for c in chunks)
    at = 0
    for chunk in chunks:
        found = text.find(chunk, 0)
        assert found >= 0
        at = max(at, found)
    assert sum(len("".join(c.split())) for c in chunks) >= len("".join(text.split()))


def test_column_form_equals_the_function(spark, sf_dir):
    texts = dict(zip(*[pq.read_table(f"{sf_dir}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text")]))
    rows = chunk_articles(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").collect()
    got = {}
    for row in sorted(rows):
        got.setdefault(row["doc_id"], []).append(row["content"])
    assert len(rows) == 600
    assert got == {i: split_text(t) for i, t in texts.items()}


def test_sql_form(spark):
    register_split_text(spark)
    rows = spark.sql("SELECT * FROM split_text('one two three four', 9, 0)").collect()
    assert [tuple(r) for r in rows] == [(0, "one two"), (1, "three"), (2, "four")]


def test_fixed_windows(spark):
    texts = spark.createDataFrame([(1, "x" * 3000), (2, "abc"), (3, ""), (4, "y" * 1200)], "id INT, t STRING")
    rows = fixed_chunks(texts, "id", "t").orderBy("id", "chunk_index").collect()
    assert [(r["id"], len(r["content"])) for r in rows] == [(1, 1200), (1, 1200), (1, 840), (2, 3), (4, 1200)]


ARTICLES = "article_id STRING, title STRING, source STRING, date TIMESTAMP, content STRING, url STRING, author STRING, tags ARRAY<STRING>, type STRING"


def test_records_and_count_of_stored_articles(spark):
    rows = [
        ("a", "On Docker", "s", None, "long sentence here. " * 100, "u", None, ["zed", "DevOps"], "batch"),
        ("b", "t", "s", None, "   ", "v", None, [], "online"),
        ("c", "t", "s", None, "short", "w", "me", None, "chat"),
    ]
    records = chunk_records(spark.createDataFrame(rows, ARTICLES), F.lit("2024-06-01")).collect()
    by_id = {r["chunk_id"]: r for r in records}
    assert set(by_id) == {"a-0", "a-1", "c-0"}
    assert by_id["a-0"]["tags"] == ["DevOps", "zed"] and by_id["c-0"]["tags"] == []
    assert {r["fetched_at"] for r in records} == {by_id["a-0"]["fetched_at"]}
    stored = stored_articles(chunk_records(spark.createDataFrame(rows, ARTICLES), F.lit("2024-06-01")))
    assert stored.first()["stored"] == 2


def test_texts_cross_to_python_in_small_batches(spark):
    """A Python worker holds a bounded part of its rows, however many and however long they are."""
    rows = prepare(spark).range(0, 5000, 1, 1).select(F.repeat(F.lit("x"), 8000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    got = rows.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 5000 and max(r["n"] for r in got) <= 2048
    assert max(r["size"] for r in got) <= 10 << 20
