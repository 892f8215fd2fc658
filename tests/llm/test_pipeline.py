"""Each stage of the pipeline against SQL over its own input, the last against the library."""

from __future__ import annotations

import hashlib

import duckdb
import public_tokenizers
import sentencepiece

import corpus_pipeline
from newslake.llm import decontaminate, line_frequency, line_templates, near_dedup


def test_stages_equal_their_sql(spark, sf_dir, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    current = f"{sf_dir}/documents.parquet"

    def sql(text):
        connection = duckdb.connect()
        files = current if current.startswith(sf_dir) else f"{current}/*.parquet"
        connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
        connection.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf_dir}/benchmark.parquet'")
        return connection.execute(text).df().set_index("doc_id")

    def run(name):
        before = {r["doc_id"]: r for r in spark.read.parquet(current).collect()}
        out = str(tmp_path / name)
        stages[name](spark, spark.read.parquet(current), sf_dir).write.parquet(out)
        rows = spark.read.parquet(out)
        return before, {r["doc_id"]: r for r in rows.collect()}, out, rows.columns

    want = sql(line_frequency.SQL)
    before, after, current_next, got_columns = run("quality_rules")
    assert got_columns == columns and set(after) == set(want.index[want.kept])
    for i, r in after.items():
        lost = len(before[i]["text"].split()) - len(r["text"].split())
        assert lost == want.n_boilerplate_words[i] and r["n_chars"] == len(r["text"])
    current = current_next

    want = sql(line_templates.SQL)
    before, after, current_next, got_columns = run("line_dedup")
    assert got_columns == columns
    for i in before:
        if i in after:
            assert hashlib.sha256(after[i]["text"].encode()).hexdigest() == want.text_sha256[i]
        else:
            assert want.n_dropped[i] > 0
    current = current_next

    want = sql(near_dedup.SQL.replace("i + 3", "i + 4").replace("len(ws) - 3", "len(ws) - 4"))
    before, after, current_next, got_columns = run("near_dedup")
    assert got_columns == columns and set(after) == set(want.index[want.kept])
    assert all(after[i] == before[i] for i in after)
    current = current_next

    want = sql(decontaminate.SQL)
    before, after, current_next, got_columns = run("decontamination")
    assert got_columns == columns and set(after) == set(want.index[~want.contaminated])
    current = current_next

    before, after, _, _ = run("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(after) == set(before)
    for i, r in after.items():
        assert r["ids"] == library.encode(before[i]["text"]) and r["n_tokens"] == len(r["ids"])

    whole = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert whole == {i: r["ids_sha256"] for i, r in after.items()}


def test_empty_corpus(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
