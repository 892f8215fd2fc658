from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from newslake.functions.tags import detect_tags, TAG_KEYWORDS, keyword_table
from newslake.operators import context, summary, tagging, upsert
from newslake.plans.answer import answer_questions, expanded_questions, question_context

ITEMS = (
    "question_id STRING, group_no INT, pos INT, title STRING, source STRING, date STRING, content STRING, url STRING, "
    "tags ARRAY<STRING>"
)


def items(spark):
    return spark.createDataFrame(
        [
            ("q", 0, 2, "Second", "s2", "", "c" * 700, "u2", ["LLM", "LLM"]),
            ("q", 0, 1, "First", "s1", "2024-01-01T00:00:00+00:00", "one", "u1", ["LLM", "Data"]),
            ("q", 1, 0, None, None, None, None, None, None),
            ("q", 2, 0, "News", "n", "d", "fresh", "u3", ["Data"]),
            ("q", 4, 1, "Q: x", None, "", "past", "", []),
            ("p", 2, 0, "Only", "n", "d", "fresh", "u3", []),
        ],
        ITEMS,
    )


def test_cards(spark):
    lists = {r["question_id"]: r for r in context.card_lists(items(spark)).collect()}
    cards = lists["q"]["cards"]
    assert [c["title"] for c in cards] == ["First", "Second", "Sans titre", "News", "Q: x"]
    assert [c["source"] for c in cards] == ["s1", "s2", "interne", "n", "newsapi"]
    assert len(cards[1]["snippet"]) == 280 and cards[2]["snippet"] == "" and cards[2]["tags"] == []
    # Tags twice in one card count twice.
    assert lists["q"]["trending"] == ["LLM"] and lists["p"]["trending"] == [] and lists["q"]["n_cards"] == 5


def test_trending_threshold(spark):
    cards = context.build_cards(items(spark))
    assert [tuple(r) for r in tagging.trending_tags(cards).collect()] == [("q", ["LLM"])]
    low = {r["question_id"]: r["trending"] for r in tagging.trending_tags(cards, threshold=2).collect()}
    assert low == {"q": ["Data", "LLM"]}


def test_prompt(spark):
    text = {r["question_id"]: r["context"] for r in context.prompt_context(items(spark)).collect()}
    assert text["q"] == (
        "## Index interne\n\n[1] First — s1 (2024-01-01T00:00:00+00:00)\none\n\n[2] Second — s2 ()\n" + "c" * 600
        + "\n\n[3]  —  ()\n\n\n## Actualité fraîche\n\n[F1] News — n (d)\nfresh\nu3\n\n[F2] Q: x —  ()\npast\n"
    )
    assert text["p"].startswith("## Actualité fraîche\n\n[F1] Only")


QUESTIONS = "question_id STRING, question STRING, topics ARRAY<STRING>, llm_configured BOOLEAN, raw_answer STRING"


def test_status_and_answers(spark):
    questions = spark.createDataFrame(
        [("q", "Why?", ["a"], True, '{"answer": "Because"}'), ("p", "How?", [], False, "x"), ("e", "What?", [], True, "x")], QUESTIONS
    )
    out = {r["question_id"]: r for r in answer_questions(questions, items(spark)).collect()}
    assert {k: r["status"] for k, r in out.items()} == {"q": "ok", "p": "degraded", "e": "empty"}
    assert out["q"]["answer"] == "Because" and out["p"]["answer"].startswith("1 article(s) trouvé(s) pour : How?")
    assert out["e"]["answer"].startswith("Aucun article") and out["e"]["cards"] == []
    payload = json.loads(out["e"]["payload"])
    assert payload == {"question": "What?", "topics": [], "context": "(aucune source disponible)"}
    failed = questions.withColumn("raw_answer", F.lit(None).cast("string"))
    row = {r["question_id"]: r for r in answer_questions(failed, items(spark)).collect()}["q"]
    assert row["status"] == "ok" and row["answer"] == "Synthèse indisponible (erreur LLM). 5 article(s) référencé(s)."


def test_question_context_end_to_end(spark):
    when = datetime(2024, 1, 1)
    kinds = {"a": "batch", "b": "chat", "c": "online"}
    chunk = lambda a, i, v: (f"{a}-{i}", a, i, f"text {a}{i}", f"T{a}", "s", "u", when, None, ["LLM"], kinds[a], when, v)
    chunks = spark.createDataFrame(
        [chunk("a", 0, [1.0, 0.0]), chunk("a", 1, [-1.0, 0.1]), chunk("b", 0, [0.9, 0.1]), chunk("c", 0, [0.0, -1.0])],
        "chunk_id STRING, article_id STRING, chunk_index INT, content STRING, title STRING, source STRING, url STRING, "
        "date TIMESTAMP, author STRING, tags ARRAY<STRING>, type STRING, fetched_at TIMESTAMP, embedding ARRAY<DOUBLE>",
    )
    questions = spark.createDataFrame([("q", "Why?", ["web", "ai"], "day1")], "question_id STRING, question STRING, topics ARRAY<STRING>, snapshot STRING")
    assert expanded_questions(questions).first()["query"] == "Why? | web, ai"
    vectors = spark.createDataFrame([("q", [1.0, 0.0])], "question_id STRING, embedding ARRAY<DOUBLE>")
    news = spark.createDataFrame(
        [("ai", 1, "n1", "N", "s", when, "news", "same", ["ai"]), ("web", 1, "n2", "M", "s", when, "web news", "w", ["web"]),
         ("ai", 2, "n3", "O", "s", when, "dup of url", "w", ["ai"]), ("other", 1, "n4", "X", "s", when, "x", "x", [])],
        "topic STRING, topic_rank INT, article_id STRING, title STRING, source STRING, date TIMESTAMP, content STRING, url STRING, tags ARRAY<STRING>",
    )
    stories = spark.createDataFrame(
        [("day1", 3, "S", "HackerNews", when, "story", "hn", []), ("day2", 1, "S2", "HackerNews", when, "other", "hn", [])],
        "snapshot STRING, feed_rank INT, title STRING, source STRING, date TIMESTAMP, content STRING, url STRING, tags ARRAY<STRING>",
    )
    rows = question_context(questions, vectors, chunks, news, stories, k=2).orderBy("group_no", "pos").collect()
    assert [(r["group_no"], r["content"], r["source"]) for r in rows] == [
        (0, "text a0", "s"), (0, "text b0", "s"), (1, "text a1", "s"), (2, "web news", "s"), (2, "news", "s"),
        (3, "story", "HackerNews"), (4, "text b0", "ChatHistory"),
    ]
    assert rows[-1]["url"] == "" and rows[-1]["tags"] == []


def test_chat_records(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", "q" * 150), (1, 2, "assistant", "a" * 600), (1, 3, "user", "unanswered"), (2, 0, "user", "x"), (2, 1, "user", "y"), (2, 2, "assistant", "z")],
        "conv_id INT, turn INT, role STRING, text STRING",
    )
    records = context.chat_records(context.question_turns(turns), F.col("turn"), F.lit("2024-06-01")).orderBy("title").collect()
    assert [r["content"] for r in records] == ["Q: " + "q" * 150 + "\nA: " + "a" * 500, "Q: y\nA: z"]
    assert records[0]["title"] == "Q: " + "q" * 100 and records[0]["type"] == "chat" and records[0]["url"] == ""


def test_export(spark):
    rows = spark.createDataFrame([("c", "t", "s", None, "u", ["a", "b"]), ("c", "t", "s", datetime(2024, 1, 2), "u", [])],
                                 "content STRING, title STRING, source STRING, date TIMESTAMP, url STRING, tags ARRAY<STRING>")
    got = [(r["date"], r["tags"], r["type"]) for r in context.export_documents(rows).collect()]
    assert got == [("", "a,b", "online"), ("2024-01-02T00:00:00+00:00", "", "online")]


def test_tag_join_agrees_with_detect_tags(spark, sf_dir):
    words = {**TAG_KEYWORDS, "Prose": ["tion", "es", "ü", "ung"], "None": ["zzzz"], "All": [""], "Edge": ["go ", " we"]}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, "we use go"), (-1, "we use go"), (-2, None), (None, "")], "doc_id LONG, text STRING")
    )
    tags = detect_tags(F.col("text"), keywords=words)
    want = sorted(map(str, docs.select("doc_id", F.explode(tags).alias("tag")).collect()))
    table = keyword_table(spark, words).unionByName(spark.createDataFrame([("None", None), (None, "we")], "tag STRING, keyword STRING"))
    for size in (1 << 20, 40):
        assert sorted(map(str, tagging.tag_join(docs, table, "doc_id", "text", size).collect())) == want
    assert tagging.tag_join(docs, table.limit(0), "doc_id", "text").count() == 0


def test_tag_counts(spark):
    rows = spark.createDataFrame([("1", "a", ["x", "y"]), ("2", "b", ["x"]), ("3", "c", [])], "article_id STRING, title STRING, tags ARRAY<STRING>")
    assert {tuple(r) for r in tagging.tag_counts(rows).collect()} == {("x", 2), ("y", 1)}
    assert tagging.tag_listing(rows).count() == 3


CHUNKS = "chunk_id STRING, article_id STRING, type STRING, content STRING, fetched_at INT"


def test_upsert(spark, tmp_path):
    old = spark.createDataFrame([("a-0", "a", "batch", "old", 1), ("a-1", "a", "batch", "tail", 1), ("b-0", "b", "chat", "kept", 9)], CHUNKS)
    new = spark.createDataFrame([("a-0", "a", "batch", "newer", 3), ("a-0", "a", "batch", "new", 2), ("c-0", "c", "chat", "added", 2)], CHUNKS)
    content = lambda df: {r["chunk_id"]: r["content"] for r in df.collect()}
    merged = upsert.upsert_chunks(old, new)
    want = {"a-0": "newer", "a-1": "tail", "b-0": "kept", "c-0": "added"}
    assert merged.count() == 4 and content(merged) == want
    assert content(upsert.upsert_chunks(merged, new)) == want
    assert content(upsert.upsert_chunks(old, new, replace_articles=True)) == {k: v for k, v in want.items() if k != "a-1"}
    first = upsert.write_snapshot(old, str(tmp_path))
    second = upsert.write_snapshot(upsert.upsert_chunks(upsert.read_snapshot(spark, first).select(old.columns), new), str(tmp_path))
    assert content(upsert.read_snapshot(spark, second)) == want and content(upsert.read_snapshot(spark, first))["a-0"] == "old"


def test_summary(spark):
    raw = spark.range(7)
    articles = spark.createDataFrame([(i, f"{i}" * 70) for i in range(7, 0, -1)], "seq INT, title STRING")
    records = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "article_id STRING, chunk_index INT")
    rows = summary.ingest_summary(raw, articles, records).orderBy("item", "pos").collect()
    assert [(r["item"], r["pos"], r["value"]) for r in rows] == [
        ("fetched", 0, "7"), ("indexed", 0, "2"), *[("title", i, f"{i}" * 60) for i in range(1, 6)]
    ]
