"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are single words and pairs of words, and up to three shapes in a row (lower case, capitalised, upper case,
number, or the symbols themselves), each hashed to one of ``2 ** BITS`` places. A text is the vector of their counts,
scaled to unit length; its score is the logistic function of a sparse dot product.

Training uses a bounded sample, ``SAMPLE_ROWS`` labelled rows of the training folds chosen by a hash of their ids. They
are dealt to ``SHARDS`` learners, each bounded too, whose weights are averaged; a logistic fit of slope and offset on
the same rows brings the averaged weights to scale.

Cases: null and empty texts have no features and score by the bias alone. Without labels every score is one half.
Of several labels of an id the largest counts. Null labels and ids are not learned from. Repeated rows score alike.
Extra columns pass through unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newslake.llm.common import crc_mod, table

FOLDS = 3
HELD_OUT = 1
BITS = 18
SAMPLE_ROWS = 24_000
SHARDS = 8
PASSES = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.002, 0.001
KNOWN_TOKENS = 300_000
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)  # odd constants

find_tokens = re.compile(r"\w+|[^\w\s]+").findall


def shape(token: str) -> str:
    if token.isdigit():
        return "0"
    if token.islower():
        return "a"
    if token.isupper():
        return "A" if len(token) == 1 else "AA"
    if token[:1].isupper():
        return "Aa"
    return "w" if token[:1].isalnum() else token[:8]


class TokenHashes(dict):
    """Index of a token's word and shape hash in a growing table, remembered up to a bound."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= KNOWN_TOKENS:
            self.clear()
        found = self[token] = (
            xxhash.xxh3_64_intdigest(token.lower(), seed=1), xxhash.xxh3_64_intdigest(shape(token), seed=2)
        )
        return found


def features(text: str | None, known: TokenHashes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's unit vector; place 0 is the bias and holds 1."""
    tokens = find_tokens(text or "")
    if not tokens:
        return np.zeros(1, np.int64), np.ones(1)
    both = np.array(list(map(known.__getitem__, tokens)), np.uint64)
    words, shapes = both[:, 0], both[:, 1]
    grams = [words, shapes]
    for hashes, longest in ((words, 2), (shapes, 3)):
        gram = hashes
        for n in range(1, longest):
            if len(hashes) > n:
                gram = (gram[:-1] * STEPS[n]) ^ (hashes[n:] * STEPS[0])
                gram ^= gram >> np.uint64(29)
                grams.append(gram * STEPS[2])
    mixed = np.concatenate(grams)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * STEPS[1]
    places, counts = np.unique((mixed >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    values = counts / np.sqrt((counts.astype(float) ** 2).sum())
    at = int(np.searchsorted(places, 0))
    if at == len(places) or places[at]:
        places, values = np.insert(places, 0, 0), np.insert(values, 0, 0.0)
    values[0] = 1.0
    return places, values


class Learner:
    """FTRL-proximal on sparse vectors."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    def learn(self, places: np.ndarray, values: np.ndarray, y: int) -> None:
        w = self.weights(places)
        g = (logistic(w @ values) - y) * values
        n = self.n[places]
        self.z[places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[places] = n + g * g


def logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def train_shard(rows: pd.DataFrame) -> pd.DataFrame:
    learner, known = Learner(), TokenHashes()
    rows = rows.sort_values(["order", "label"], kind="stable")
    vectors = [features(t, known) for t in rows["text"]]
    for _ in range(PASSES):
        for (places, values), y in zip(vectors, rows["label"]):
            learner.learn(places, values, int(y > 0))
    w = learner.weights(slice(None))
    at = np.flatnonzero(w)
    return pd.DataFrame({"place": at, "weight": w[at]})


def held_out(doc_id: str) -> Column:
    return crc_mod(F.col(doc_id), FOLDS) == HELD_OUT


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id") -> np.ndarray:
    """Averaged weights. The sample of the labels is bounded, so it may be sent to the texts."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
        .groupBy(doc_id).agg(F.max(label).cast("int").alias("label"))
    )
    part = min(1.0, SAMPLE_ROWS / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1 << 20)) < int(part * (1 << 20)))
    order = F.xxhash64(F.lit("order"), F.col(doc_id).cast("string"))
    rows = docs.select(doc_id, "text").join(F.broadcast(sample), doc_id).select(
        "text", "label", order.alias("order"), F.pmod(order, F.lit(SHARDS)).alias("shard")
    )
    weights = (
        rows.groupBy("shard").applyInPandas(train_shard, "place long, weight double")
        .groupBy("place").agg((F.sum("weight") / SHARDS).alias("weight")).toPandas()  # at most 2 ** BITS rows
    )
    out = np.zeros(1 << BITS)
    out[weights["place"].to_numpy(np.int64)] = weights["weight"]
    if not len(weights):
        return out.astype(np.float32)
    seen = margins(rows.select("label", "text"), out.astype(np.float32)).select("label", "margin").toPandas()
    slope, offset = calibration(seen["margin"].to_numpy(), seen["label"].to_numpy() > 0)
    out *= slope
    out[0] += offset
    return out.astype(np.float32)


def calibration(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit: averaging shrinks the weights of what few learners have seen."""
    a, b, y = 1.0, 0.0, good.astype(float)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - y) * margin).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        h = np.array([[(v * margin**2).sum() + 1e-2, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
    return float(max(a, 1e-3)), float(b)


def margins(texts: DataFrame, weights: np.ndarray) -> DataFrame:
    """``texts`` with ``margin``, the dot product, in place of ``text``."""
    other = [c for c in texts.columns if c != "text"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = TokenHashes()
        for batch in batches:
            found = []
            for body in batch["text"]:
                places, values = features(body, known)
                found.append(float(weights[places] @ values))
            yield batch[other].assign(margin=found)

    schema = [f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "text"]
    return texts.mapInPandas(score, ", ".join([*schema, "margin double"]))


def score_quality(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id held_out score predicted`` for every row."""
    scored = margins(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")), weights)
    bounded = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), "margin"))
    return scored.select(
        F.col("_id").alias(doc_id), held_out("_id").alias("held_out"), (1 / (1 + F.exp(-bounded))).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
