"""Centroid clustering and spelling variants against plain versions, and their odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from newslake.llm import shallot, spelling_variants

VECTORS = "vec_id long, embedding array<float>, cluster string, distance string"  # two columns clash with results


def plain_clusters(rows, dims, k, rounds):
    kept = [
        (i, [math.floor(256 * x) for x in map(float, np.float32(v))])
        for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    digest = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [c for _, c in sorted((digest(i), c) for i, c in kept)][:k]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        found = [min((apart(c, m), j) for j, m in enumerate(centroids)) for _, c in kept]
        if r < rounds:
            for j in range(len(centroids)):
                members = [c for (_, c), (_, at) in zip(kept, found) if at == j]
                if members:
                    centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    inertia = Counter()
    for d, j in found:
        inertia[j] += d
    whole = sum(inertia.values())
    return sorted(
        (str(i), j, d, inertia[j], whole, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest())
        for (i, _), (d, j) in zip(kept, found)
    )


def clusters(spark, rows, **how):
    found = shallot.cluster(spark.createDataFrame(rows, VECTORS), **how).drop("centroid")
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in found.collect())


@pytest.mark.parametrize("seed", range(4))
def test_clusters_equal_plain_search(spark, seed):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(9)]
    grid = seed % 2  # coarse values make many ties
    value = lambda x: round(x * 2) / 256 if grid else x + rng.gauss(0, 0.2)
    rows = [(i, [value(x) for x in rng.choice(centres)], "c", "d") for i in range(600)]
    assert clusters(spark, rows, dims=6, k=12, rounds=4) == plain_clusters(rows, 6, 12, 4)


def test_odd_vectors(spark):
    rows = [(i, [i / 7, -i / 9], "c", None) for i in range(20)]
    odd = [
        (None, [0.5, 0.5]), (None, None), (50, []), (51, [1.0]), (52, [1.0, None]), (53, [1.0, float("nan")]),
        (54, [float("inf"), 0.0]), (3, [3 / 7, -3 / 9]), (3, [9.0, 9.0]), (1 << 62, [0.1, 0.2]),
    ]
    rows += [(i, v, None, "d") for i, v in odd]
    assert clusters(spark, rows, dims=2, k=5, rounds=3) == plain_clusters(rows, 2, 5, 3)
    assert clusters(spark, rows, dims=2, k=100, rounds=2) == plain_clusters(rows, 2, 100, 2)
    assert clusters(spark, rows, dims=2, k=1, rounds=2) == plain_clusters(rows, 2, 1, 2)
    assert clusters(spark, [], dims=2) == []
    assert clusters(spark, [(7, [1.0, 2.0], None, None)], dims=2) == plain_clusters([(7, [1.0, 2.0])], 2, 40, 5)


def plain_variants(docs):
    import re

    counts = Counter()
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1:] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out = {}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        form = min(others, key=lambda v: (-words[v], v), default=None)
        out[w] = (form if form and words[form] >= 5 * n else None, len(others))
    def root(w):  # noqa: E306
        while out[w][0]:
            w = out[w][0]
        return w
    return sorted((w, out[w][0] or "", root(w), n, out[w][1], words.get(out[w][0], 0)) for w, n in words.items())


def variants(spark, docs, **how):
    found = spelling_variants.spelling_variants(
        spelling_variants.word_counts(spark.createDataFrame(docs, "doc_id long, text string, word string, n string")), **how
    )
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r[0], r[1] or "", r[2], r[3], r[4], r[5] or 0) for r in found.collect())


def documents(seed, n=120):
    rng = random.Random(seed)
    stems = ["letter", "better", "retells", "àlphabet", "aaaaaa", "tellers", "mississippi", "Öffnung"]
    texts = []
    for _ in range(n):
        words = []
        for _ in range(60):
            w = stems[min(int(rng.expovariate(0.7)), len(stems) - 1)]
            i = rng.randrange(len(w))
            change = rng.random()
            if change < 0.1:
                w = w[:i] + w[i + 1:]
            elif change < 0.2:
                w = w[:i] + rng.choice("abeRtÿ") + w[i:]
            elif change < 0.3:
                w = w[:i] + rng.choice("abeRt") + w[i + 1:]
            words.append(w)
        texts.append(rng.choice([" ", "\n", "-", "×"]).join(words))
    return [(i, t, "w", "n") for i, t in enumerate(texts)]


@pytest.mark.parametrize("how", [{}, {"group": 2}, {"parts": 4, "group": 1}])
def test_variants_equal_brute_force(spark, how):
    docs = documents(len(how))
    got = variants(spark, docs, **how)
    assert got == plain_variants(docs)
    assert any(form for _, form, *_ in got)


def test_odd_documents(spark):
    docs = documents(7, 20)
    docs += docs[:5] + [(None, None, None, None), (None, "letter letter", None, None), (1, "", None, None), (2, " \n", None, None)]
    docs += [(9, ("x" * 5000 + " ") * 6 + ("x" * 4999 + "y ") * 40, None, None)]
    assert variants(spark, docs) == plain_variants(docs)
    assert variants(spark, []) == []


def test_forms_lead_to_the_last(spark):
    chain = [("aaaaaa" + "b" * i, 5 ** i) for i in range(1, 9)]
    found = spelling_variants.spelling_variants(spark.createDataFrame(chain, "word string, n long"))
    assert {r["root"] for r in found.collect()} == {"aaaaaa" + "b" * 8}
