"""Tag detection: a tag holds when any of its keywords occurs as a substring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The tag dictionary.
TAG_KEYWORDS = {
    "LLM": ["llm", "gpt", "claude", "llama", "prompt", "embedding", "langchain", "openai", "transformer"],
    "DevOps": ["docker", "k8s", "kubernetes", "ci/cd", "deploy", "terraform", "jenkins", "github actions"],
    "Frontend": ["react", "vue", "svelte", "css", "html", "typescript", "next.js", "angular", "tailwind"],
    "Backend": ["node", "python", "api", "database", "server", "fastapi", "django", "express", "sql"],
    "Data": ["sql", "bigquery", "analytics", "dataviz", "pandas", "spark", "dbt", "warehouse"],
    "FinOps": ["cost", "billing", "budget", "pricing", "cloud spending", "aws", "gcp", "azure"],
}


def detect_tags(
    text: Column,
    title: Column | None = None,
    keywords: dict[str, list[str]] | None = None,
    whole_words: bool = False,
) -> Column:
    """Sorted tags of a text and its title, by substring tests in the JVM.

    Matching has no word boundary unless ``whole_words`` is asked for.
    """
    words = TAG_KEYWORDS if keywords is None else keywords
    title = F.lit("") if title is None else F.coalesce(title, F.lit(""))
    lowered = F.lower(F.concat(F.coalesce(text, F.lit("")), F.lit(" "), title))

    def found(seen: Column, word: str) -> Column:
        if not whole_words:
            return F.contains(seen, F.lit(word))
        quoted = "".join(c if c.isalnum() else "\\" + c for c in word)
        return seen.rlike(rf"(?<![\p{{L}}\p{{N}}]){quoted}(?![\p{{L}}\p{{N}}])")

    def tags_in(seen: Column) -> Column:
        hits = []
        for tag in sorted(words):
            test = F.lit(False)
            for word in words[tag]:
                test = test | found(seen, word)
            hits.append(F.when(test, F.lit(tag)))
        return F.array_compact(F.array(*hits))

    if not words:
        return F.array().cast("array<string>")
    # The lambda variable holds the lowered text, which would otherwise be made again for every keyword.
    return F.element_at(F.transform(F.array(lowered), tags_in), 1)


def keyword_table(spark: SparkSession, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    words = TAG_KEYWORDS if keywords is None else keywords
    rows = [(tag, word) for tag, ws in words.items() for word in ws]
    return spark.createDataFrame(rows, "tag STRING, keyword STRING")
