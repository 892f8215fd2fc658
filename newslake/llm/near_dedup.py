"""MinHash near-dedup with tensored banding.

Two small collections of half keys are computed for each document, ``SIDE`` half keys of ``ROWS`` minhashes each.
A table key is a pair of half keys, one of either collection: ``SIDE ** 2`` keys for ``2 * SIDE`` half keys, so the
minhash work is about the square root of that of independent tables. At a similarity of s a pair shares no key
with probability ``2 * (1 - s ** ROWS) ** SIDE``: 2e-5 at 0.8, 2e-6 at 0.85. Half keys that no other document has are
dropped before pairs are formed.

Texts with the same words are one class from the start. Documents that are connected by common keys form a cluster;
within it, links are confirmed on full shingle sets, in blocks of bounded size. First each block is compared in
itself and with the first one, and what links is contracted; then only the members outside the cluster's largest
component meet the other blocks. Of the links of a block only a spanning forest leaves a task. Nothing is capped, and
no pair of documents becomes a row.

Cases: a null text and a text without words have an empty set and link with nothing. Repeated rows are copies of each
other; a repeated id is one document with all its links. A null id counts as the largest id and is never a
component's name unless alone. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newslake.llm.common import table, under_own_names
from newslake.session import materialise

SHINGLE = 5
THRESHOLD = 80  # percent
SIDE = 16  # half keys of either collection
ROWS = 3  # minhashes of a half key
SEED = 20240229
BLOCK = 2048  # members of a cluster that one task compares with as many others
BLOCK_SHINGLES = 1_000_000  # and their shingles
KNOWN_WORDS = 300_000  # hashes of words that a task remembers

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)  # odd constants


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(words: list[bytes], n: int, known: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``n`` words; of the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64)
    size = len(h) - n + 1
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + size]) * MIX[k % len(MIX)]
        out ^= out >> np.uint64(29)
    out *= MIX[-1]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def split_words(text: str) -> list[bytes]:
    """ASCII letters lower-cased, words between blanks."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def half_keys(shingles: np.ndarray, factors: np.ndarray, block: int = 4096) -> np.ndarray:
    """One hash for each half key: of ``ROWS`` minhashes, all in blocks of shingles."""
    least = np.full(len(factors), np.uint64(2**64 - 1))
    for at in range(0, len(shingles), block):
        np.minimum(least, (shingles[at : at + block, None] * factors).min(axis=0), out=least)
    rows = least.reshape(-1, ROWS)
    out = np.zeros(len(rows), np.uint64)
    for k in range(ROWS):
        out = (out ^ rows[:, k]) * MIX[k]
        out ^= out >> np.uint64(31)
    return out


def minhash_factors() -> np.ndarray:
    draw = np.random.default_rng(SEED)
    return draw.integers(0, 2**63, size=2 * SIDE * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


SKETCH = "node long, th long, n_shingles long, d1 long, d2 long, halves array<long>"
NAMELESS = 2**62  # nodes of rows without id lie from here on


def node_of(doc_id: str, text: str) -> Column:
    """The id of a row; for a row without one, a large number drawn from its text."""
    drawn = F.xxhash64(text).bitwiseAND(F.lit(NAMELESS - 1)).bitwiseOR(F.lit(NAMELESS))
    return F.coalesce(F.col(doc_id).cast("long"), drawn)


def sketches(nodes: DataFrame, shingle: int) -> DataFrame:
    """``node``, ``th`` as given, size of the set, 128-bit digest of the words, half keys of the first and then the second side."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, factors = WordHashes(), minhash_factors()
        for batch in batches:
            rows = []
            for node, th, body in batch[["node", "th", "text"]].itertuples(index=False):
                words = split_words(body) if body is not None else []
                shingles = shingle_set(words, shingle, known)
                d1, d2 = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.int64)
                halves = half_keys(shingles, factors).view(np.int64) if len(shingles) else np.empty(0, np.int64)
                rows.append((node, th, len(shingles), d1, d2, halves))
            yield pd.DataFrame(rows, columns=["node", "th", "n_shingles", "d1", "d2", "halves"])

    return nodes.mapInPandas(sketch, SKETCH)


def bucket_stars(classes: DataFrame) -> DataFrame:
    """``hub, node``: every member of a bucket with the least one, once."""
    halves = classes.select("node", F.posexplode("halves").alias("pos", "half"))
    shared = halves.groupBy("pos", "half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    active = halves.join(shared, ["pos", "half"]).groupBy("node").agg(
        F.collect_list(F.struct("pos", "half")).alias("halves")  # at most 2 * SIDE
    )
    side = lambda first: F.filter("halves", lambda h: (h["pos"] < SIDE) if first else (h["pos"] >= SIDE))
    paired = (
        active.select("node", side(True).alias("a"), side(False).alias("b"))
        .select("node", F.explode("a").alias("a"), "b")
        .select("node", "a", F.explode("b").alias("b"))
        .select("node", F.xxhash64("a.pos", "a.half", "b.pos", "b.half").alias("key"))
    )
    paired = materialise(paired, "keys")
    full = paired.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where("n > 1")
    return paired.join(full.select("key", "hub"), "key").where("hub != node").select("hub", "node").distinct()


def common_counts(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of all intersections. Shingles of many sets are multiplied as columns, the others counted by their pairs."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, ids, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), np.float32)
    order = np.argsort(ids, kind="stable")
    starts = np.concatenate([[0], np.cumsum(df)])[:-1]
    frequent = max(8, min(32, n // 64))
    wide = np.flatnonzero(df >= frequent)
    for at in range(0, len(wide), columns):
        part = wide[at : at + columns]
        column = np.full(len(df), -1)
        column[part] = np.arange(len(part))
        held = column[ids] >= 0
        dense = np.zeros((n, len(part)), np.float32)
        dense[owner[held], column[ids[held]]] = 1
        out += dense @ dense.T
    flat = out.reshape(-1)
    for k in range(2, frequent):
        first = starts[df == k]
        if len(first):
            who = owner[order[first[:, None] + np.arange(k)]]
            for i in range(k):
                for j in range(k):
                    if i != j:
                        np.add.at(flat, who[:, i] * n + who[:, j], 1)
    return out


def spanning_links(nodes: list[int], sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Links that connect what all links among the sets connect."""
    if len(nodes) < 2:
        return []
    size = np.array([len(s) for s in sets], np.float64)
    both = common_counts(sets)  # exact up to 2 ** 24
    fresh, out = np.ones(len(nodes), bool), []
    for root in range(len(nodes)):
        if not fresh[root]:
            continue
        fresh[root], stack = False, [root]
        while stack:
            u = stack.pop()
            common = both[u].astype(np.float64)
            found = np.flatnonzero(fresh & (100 * common >= threshold * (size[u] + size - common)))
            fresh[found] = False
            out += [(nodes[u], nodes[v]) for v in found]
            stack += found.tolist()
    return out


def block_links(rows: DataFrame, threshold: int) -> DataFrame:
    """``hub, node``: spanning links of each group of ``rows`` (``g1 g2 g3 node set``); a group is two blocks at most."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, nodes, sets = None, [], []

        def links_of_group() -> pd.DataFrame:
            found = spanning_links(nodes, sets, threshold)
            nodes.clear()
            sets.clear()
            return pd.DataFrame(found, columns=["hub", "node"], dtype="int64")

        for batch in batches:
            for g1, g2, g3, node, body in batch.itertuples(index=False):
                if at != (g1, g2, g3):
                    if len(nodes) > 1:
                        yield links_of_group()
                    at = (g1, g2, g3)
                    nodes.clear()
                    sets.clear()
                nodes.append(node)
                sets.append(np.frombuffer(body, np.uint64))
        yield links_of_group()

    groups = ["g1", "g2", "g3"]
    return (
        rows.select(*groups, "node", "set").repartition(*groups).sortWithinPartitions(*groups)
        .mapInPandas(compare, "hub long, node long")
    )


def shingle_sets(placed: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``placed`` (``node cluster block``) with the whole set of each node, as bytes."""
    texts = nodes.where("text IS NOT NULL").join(placed, "node").select("node", "cluster", "block", "text")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            made = [shingle_set(split_words(t), shingle, known).tobytes() for t in batch.pop("text")]
            yield batch.assign(set=made)

    return texts.mapInPandas(build, "node long, cluster long, block int, set binary")


def in_blocks(nodes: DataFrame, *group: str) -> DataFrame:
    """``nodes`` (``node n_shingles`` and ``group``) with ``block``: bounded in members and in bytes, by their hash."""
    sizes = nodes.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("bulk"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bulk") / BLOCK_SHINGLES))
    sizes = sizes.select(*group, blocks.cast("int").alias("blocks"))
    return nodes.join(sizes, list(group)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, comp``: the least node reachable, for every node of ``edges`` (``hub``, ``node``).

    Alternates the two star contractions of map-reduce components; only edges move, in written tables.
    """
    pairs = edges.select(F.greatest("hub", "node").alias("u"), F.least("hub", "node").alias("v")).where("u != v")
    pairs = materialise(pairs.distinct(), label)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lower, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            joined.select("u", F.col("m").alias("v"))
        )
        after = materialise(small.distinct(), label)
        stars = after.groupBy("u").count().where("count > 1").isEmpty() and after.join(
            after.select(F.col("u").alias("v")), "v", "left_semi"
        ).isEmpty()
        pairs = after
        if stars:  # every node points at one root, and no root points on
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def links(classes: DataFrame, nodes: DataFrame, given: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """``node, comp`` of all nodes that link with another; ``given`` has links (``hub``, ``node``) known before."""
    coarse = components(bucket_stars(classes), "clusters").select("node", F.col("comp").alias("cluster"))
    roots = coarse.select(F.col("cluster").alias("node"), "cluster").distinct()
    coarse = coarse.unionByName(roots).join(classes.select("node", "n_shingles"), "node")
    placed = materialise(in_blocks(coarse, "cluster"), "blocks")
    sets = materialise(shingle_sets(placed.select("node", "cluster", "block"), nodes, shingle), "sets")

    # Each block in itself and, where a cluster has several, together with its first one.
    own = sets.select(F.col("cluster").alias("g1"), F.col("block").alias("g2"), F.lit(0).alias("g3"), "node", "set")
    others = placed.where("blocks > 1 AND block > 0").select("cluster", "block").distinct()
    first = sets.where("block = 0").select("cluster", "node", "set").join(others, "cluster")
    first = first.select(F.col("cluster").alias("g1"), F.col("block").alias("g2"), F.lit(0).alias("g3"), "node", "set")
    found = materialise(block_links(own.unionByName(first), threshold).unionByName(given), "links")
    comps = components(found)
    large = placed.where("blocks > 1").select("node", "cluster", "n_shingles").join(comps, "node", "left").select(
        "node", "cluster", "n_shingles", F.coalesce("comp", "node").alias("comp")
    )
    sizes = large.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("k"))
    open_nodes = large.join(main.where("k > 1"), "cluster").withColumn("odd", (F.col("comp") != F.col("main")))
    dealt = materialise(in_blocks(open_nodes.select("node", "cluster", "n_shingles", "odd"), "cluster", "odd"), "odd-blocks")
    if dealt.isEmpty():
        return comps
    # Members outside a cluster's largest component meet all others, in pairs of blocks; within it nothing is left to do.
    counts = dealt.select("cluster", "odd", "blocks").distinct().groupBy("cluster").agg(
        F.max(F.when(F.col("odd"), F.col("blocks"))).alias("odd_blocks"),
        F.max(F.when(~F.col("odd"), F.col("blocks"))).alias("main_blocks"),
    )
    pairs = (
        counts.select("*", F.explode(F.sequence(F.lit(0), F.col("odd_blocks") - 1)).alias("g2"))
        .select("cluster", "odd_blocks", "g2", F.explode(
            F.sequence(F.col("g2"), F.col("odd_blocks") + F.col("main_blocks") - 1)
        ).alias("g3"))
    )
    wanted = pairs.select("cluster", "odd_blocks", "g2", "g3", F.explode(F.array_distinct(F.array("g2", "g3"))).alias("at"))
    wanted = wanted.select(
        "cluster", "g2", "g3",
        (F.col("at") < F.col("odd_blocks")).alias("odd"),
        F.when(F.col("at") < F.col("odd_blocks"), F.col("at")).otherwise(F.col("at") - F.col("odd_blocks")).alias("block"),
    )
    rows = sets.select("node", "set").join(dealt.select("node", "cluster", "odd", "block"), "node").join(
        wanted, ["cluster", "odd", "block"]
    )
    more = block_links(rows.withColumnRenamed("cluster", "g1"), threshold)
    known = comps.select(F.col("comp").alias("hub"), "node")
    return components(known.unionByName(more))


def near_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD
) -> DataFrame:
    """``docs`` with ``n_shingles``, ``component_id`` and ``kept``."""
    return under_own_names(
        docs, ["n_shingles", "component_id", "kept"], lambda plain, own: _near_dedup(plain, own[doc_id], own[text], shingle, threshold)
    )


def _near_dedup(docs: DataFrame, doc_id: str, text: str, shingle: int, threshold: int) -> DataFrame:
    named = docs.select("*", node_of(doc_id, text).alias("_node"), F.xxhash64(text).alias("_th"))
    nodes = named.select(F.col("_node").alias("node"), F.col("_th").alias("th"), F.col(text).alias("text"))
    drawn = materialise(sketches(nodes, shingle), "sketches")
    worded = drawn.where("n_shingles > 0")
    classes = worded.groupBy("d1", "d2").agg(
        F.min("node").alias("class"), F.first("halves").alias("halves"), F.first("n_shingles").alias("n_shingles")
    )
    classes = materialise(classes, "classes")
    of_row = worded.select("node", "th", "n_shingles", "d1", "d2").join(classes.select("d1", "d2", "class"), ["d1", "d2"])
    repeated = drawn.groupBy("node").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).where("lo != hi")
    given = of_row.join(repeated.select("node"), "node").select(F.col("class").alias("hub"), "node")
    named_classes = classes.select(F.col("class").alias("node"), "halves", "n_shingles")
    comps = links(named_classes, nodes.select("node", "text"), given, shingle, threshold)
    comps = comps.withColumnRenamed("node", "class")
    found = (
        of_row.join(comps, "class", "left")
        .groupBy(F.col("node").alias("_node"), F.col("th").alias("_th"))
        .agg(F.min("n_shingles").alias("n_shingles"), F.min(F.coalesce("comp", "class")).alias("_comp"))
    )
    comp = F.coalesce("_comp", "_node")
    return named.join(found, ["_node", "_th"], "left").select(
        *docs.columns,
        F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"),
        F.when(comp < NAMELESS, comp).alias("component_id"),
        (comp == F.col("_node")).alias("kept"),
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup(docs, shingle=4).drop("text")


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9)||chr(10)||chr(11)||chr(12)||chr(13),
    'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda w: w <> '') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 3))) AS i FROM words WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * common >= 80 * (a.n + b.n - common)
), edge AS (
  SELECT x, y FROM link UNION SELECT y, x FROM link
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""
