"""Recursive text chunking: paragraphs first, then lines, sentences, words, characters."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

# Separators from coarse to fine, and the default sizes.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", " ", "")
MAX_CHARS = 1200
OVERLAP = 120


def _cut_after(text: str, separator: str) -> list[str]:
    if not separator:
        return list(text)
    parts = text.split(separator)
    pieces = [part + separator for part in parts[:-1]]
    return [piece for piece in [*pieces, parts[-1]] if piece]


def _pack(pieces: list[str], limit: int, overlap: int) -> list[str]:
    """Join neighbouring pieces up to the limit; the tail of a chunk opens the next one."""
    chunks, window, size = [], deque(), 0
    for piece in pieces:
        if window and size + len(piece) > limit:
            chunks.append("".join(window).strip())
            while size > overlap or (size and size + len(piece) > limit):
                size -= len(window.popleft())
        window.append(piece)
        size += len(piece)
    chunks.append("".join(window).strip())
    return [chunk for chunk in chunks if chunk]


def _split(text: str, separators: tuple[str, ...], limit: int, overlap: int) -> list[str]:
    level = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[level + 1:]
    chunks, small = [], []
    for piece in _cut_after(text, separators[level]):
        if len(piece) < limit:
            small.append(piece)
            continue
        if small:
            chunks += _pack(small, limit, overlap)
            small = []
        chunks += _split(piece, finer, limit, overlap) if finer else [piece]
    return chunks + (_pack(small, limit, overlap) if small else [])


def split_text(text: str | None, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Chunks of one text. Empty text has none, and a text within the limit is one chunk."""
    text = (text or "").strip()
    if len(text) <= max_chars:
        return [text] if text else []
    return _split(text, SEPARATORS, max_chars, min(overlap, max_chars // 2))


def chunk_text(text: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Array of chunks. Texts within the limit stay in the JVM; only longer ones cross to Python."""
    from newslake.functions.text import strip

    @F.pandas_udf("array<string>")
    def split_long(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_text(t, max_chars, overlap))

    clean = strip(F.coalesce(text, F.lit("")))
    short = F.when(clean == "", F.array().cast("array<string>")).otherwise(F.array(clean))
    return F.coalesce(split_long(F.when(F.length(clean) > max_chars, clean)), short)


def fixed_windows(text: Column, size: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Windows of ``size`` characters that start every ``size - overlap`` characters."""
    stride = size - min(overlap, size // 2)
    extra = F.greatest(F.length(text) - size, F.lit(0))
    last = F.ceil(extra / stride).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * stride + 1, size))
    return F.when(F.length(text) > 0, windows).otherwise(F.array().cast("array<string>"))


def register_split_text(spark: SparkSession) -> None:
    """SQL surface: ``SELECT ... FROM t, LATERAL split_text(t.content, 1200, 120)``."""

    @F.udtf(returnType="chunk_index INT, content STRING")
    class SplitText:
        def eval(self, text: str, max_chars: int, overlap: int):
            yield from enumerate(split_text(text, max_chars, overlap))

    spark.udtf.register("split_text", SplitText)
