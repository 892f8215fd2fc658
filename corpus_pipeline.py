"""From raw documents to token ids: quality rules, line dedup, near-dedup, decontamination, encoding.

Each stage takes what the one before kept and returns the columns of ``documents``; the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newslake.llm.common import BLANKS, table, without
from newslake.llm.decontaminate import decontaminate
from newslake.llm.line_frequency import line_frequency
from newslake.llm.line_templates import drop_recurring_lines
from newslake.llm.near_dedup import near_dedup
from newslake.llm.sentencepiece_prefix import encode_decode, model_bytes
from newslake.session import materialise


def recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs``, ``n_chars`` brought up to date."""
    n_chars = F.char_length("text").cast("long").alias("n_chars")
    return docs.select(*[n_chars if c == "n_chars" else c for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that are boilerplate of their host go from the others."""
    judged = line_frequency(docs).where("kept")
    return recounted(judged.drop("text").withColumnRenamed("clean_text", "text"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, and documents of which nothing else is left."""
    shortened = drop_recurring_lines(docs)
    some = without(F.coalesce("text", F.lit("")), BLANKS) != ""
    return recounted(shortened.where((F.col("n_dropped") == 0) | some), docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup(docs).where("kept").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the decoded text."""
    return encode_decode(
        docs, model_bytes(), outputs=("ids", "n_tokens", "ids_sha256", "decoded_sha256")
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", minhash_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]

ORACLE_SQL = None  # SQL can't encode; tests/llm compares with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
