"""Secret scans: patterns, and a character convolutional network over every candidate with its context.

The patterns' findings always stand. Candidates are the other long runs of key characters that mix letters and digits.
The network sees the candidate in the middle of its surrounding characters; it is trained on all labelled findings of
all texts: pattern findings, written without the telltale prefix of their kind, against ordinary words, numbers,
addresses and links. A quarter of the findings is kept to calibrate the network's score and to choose the threshold: one
that finds ``RECALL`` of the labelled secrets, as far as it can be from the ordinary findings, and never below even odds.

Findings lie in shards of about ``SHARD_FINDINGS``. In each of ``PASSES`` passes, however many shards there are, every
shard trains the same network on, and what the shards made of it is averaged; both kinds of findings count alike, whichever is rarer. Calibration sees all findings
that were kept, in bins of the network's output.

Cases: a null text is empty and has no findings. Offsets count code points. Repeated rows give the same findings. If
the texts have no secrets, or nothing else, the network adds nothing. Extra columns pass through unread.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from newslake.llm.common import table
from newslake.session import materialise

BASE = [
    ("assign", re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
    ), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
]
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
EVERYDAY = re.compile(r"[\w@./:-]{6,}")  # what ordinary findings are drawn from
ADDED = "model"
SHARD_FINDINGS = 100_000
HELD_PARTS = 4  # one of them is kept for calibration
BIN = 1e-3  # of the network's output
RECALL = 0.95
BODY, SIDE = 48, 12  # characters of a candidate and on either side of it that the network sees
KERNELS, WIDTH, PASSES, BATCH, RATE = 24, 5, 6, 64, 0.02
CLASSES = 12
SEED = 7


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then in the order of the kinds."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        if kind == "access" and "AKIA" not in text:
            continue
        found += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [(start, end, kind) for start, _, end, kind in sorted(found)]


def outside(spans: list[tuple[int, int]], taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The spans that overlap none of ``taken``; both in order."""
    if not taken:
        return spans
    out = []
    ends = sorted((s, e) for s, e, _ in taken)
    reach = np.maximum.accumulate([e for _, e in ends]) if ends else []
    starts = [s for s, _ in ends]
    for s, e in spans:
        at = int(np.searchsorted(starts, e)) - 1  # the last that starts before the span ends
        if at < 0 or reach[at] <= s:
            out.append((s, e))
    return out


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Long runs that mix letters and digits, outside the patterns' findings."""
    spans = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
            spans.append(m.span())
    return outside(spans, taken)


def classes_of(chars: str) -> np.ndarray:
    """Class of each character: blank, digit, hex letter, other lower, hex capital, other upper, marks, other."""
    codes = np.frombuffer(chars.encode("utf-32-le"), np.uint32)
    return CHAR_CLASS[np.minimum(codes, 255)]


def _char_classes() -> np.ndarray:
    out = np.full(256, CLASSES - 1, np.int8)
    groups = [" \t\n\r", "0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "-_", "=:", "\"'`", "."]
    for k, group in enumerate(groups):
        out[[ord(c) for c in group]] = k
    return out


CHAR_CLASS = _char_classes()


def window(text: str, start: int, end: int) -> np.ndarray:
    """Classes of the left side, the first characters of the candidate, and the right side, padded with blanks."""
    left = text[max(0, start - SIDE) : start].rjust(SIDE)
    body = text[start : min(end, start + BODY)].ljust(BODY)
    right = text[end : end + SIDE].ljust(SIDE)
    return classes_of(left + body + right)


def summary(text: str, start: int, end: int) -> list[float]:
    """Length, and entropy of the characters, of the whole candidate."""
    run = text[start:end]
    _, n = np.unique(np.frombuffer(run.encode("utf-32-le"), np.uint32), return_counts=True)
    p = n / n.sum()
    return [min(len(run), 256) / 64, float(-(p * np.log2(p)).sum()) / 6]


class Network:
    """One convolution with the strongest response of each kernel, then a logistic layer; scaled by calibration."""

    def __init__(self, rng: np.random.Generator):
        self.k = rng.normal(0, 0.3, (WIDTH * CLASSES, KERNELS))
        self.b = np.zeros(KERNELS)
        self.w = rng.normal(0, 0.3, KERNELS + 2)
        self.c = 0.0
        self.squares = [np.full_like(p, 1e-6) for p in (self.k, self.b, self.w)] + [1e-6]
        self.slope, self.offset, self.threshold = 1.0, 0.0, 2.0

    def state(self) -> np.ndarray:
        """All that training changes, as one row of numbers."""
        return np.concatenate([np.ravel(p) for p in (self.k, self.b, self.w, self.c, *self.squares)])

    def restore(self, state: np.ndarray) -> None:
        parts, at = [], 0
        for p in (self.k, self.b, self.w, self.c, *self.squares):
            n = np.size(p)
            parts.append(state[at : at + n].reshape(np.shape(p)))
            at += n
        self.k, self.b, self.w, c, *squares = parts
        self.c, self.squares = float(c), [*squares[:3], float(squares[3])]

    def responses(self, windows: np.ndarray) -> np.ndarray:
        """Rows, places and kernels. Sums of rows of the kernels, those of two neighbouring characters added before."""
        k = self.k.reshape(WIDTH, CLASSES, KERNELS)
        n = windows.shape[1] - WIDTH + 1
        seen = windows.astype(np.intp)
        pairs = seen[:, :-1] * CLASSES + seen[:, 1:]
        out = np.repeat(self.b[None], len(windows) * n, axis=0).reshape(len(windows), n, KERNELS)
        for at in range(0, WIDTH - 1, 2):
            out += (k[at][:, None] + k[at + 1]).reshape(-1, KERNELS)[pairs[:, at : at + n]]
        if WIDTH % 2:
            out += k[-1][seen[:, WIDTH - 1 :]]
        return out

    def forward(self, windows: np.ndarray, extra: np.ndarray) -> tuple:
        response = self.responses(windows)
        at = response.argmax(axis=1)
        best = np.maximum(np.take_along_axis(response, at[:, None, :], 1)[:, 0], 0)
        hidden = np.concatenate([best, extra], axis=1)
        return hidden @ self.w + self.c, hidden, at

    def train(
        self, windows: np.ndarray, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator
    ) -> None:
        """One pass over the findings."""
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            out, hidden, at = self.forward(windows[rows], extra[rows])
            g = weight[rows] * (sigmoid(out) - y[rows]) / len(rows)
            g_hidden = np.outer(g, self.w)[:, :KERNELS] * (hidden[:, :KERNELS] > 0)
            places = np.arange(WIDTH)
            chosen = windows[rows][np.arange(len(rows))[:, None, None], at[:, :, None] + places]  # rows, kernels, width
            cells = (places * CLASSES + chosen) * KERNELS + np.arange(KERNELS)[:, None]
            g_k = np.bincount(cells.ravel(), np.repeat(g_hidden, WIDTH), WIDTH * CLASSES * KERNELS)
            grads = [g_k.reshape(WIDTH * CLASSES, KERNELS), g_hidden.sum(0), hidden.T @ g, g.sum()]
            for n, grad in enumerate(grads):
                self.squares[n] = self.squares[n] + grad * grad
                step = RATE * grad / np.sqrt(self.squares[n])
                name = ("k", "b", "w", "c")[n]
                setattr(self, name, getattr(self, name) - step)

    def calibrate(self, out: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Slope and offset by Newton steps on outputs for held-back findings, then the threshold."""
        a, b = 1.0, 0.0
        for _ in range(20):
            p = sigmoid(a * out + b)
            v = weight * (p * (1 - p) + 1e-9)
            off = weight * (p - y)
            g = np.array([(off * out).sum() + 1e-2 * (a - 1), off.sum() + 1e-2 * b])
            h = np.array([[(v * out * out).sum() + 1e-2, (v * out).sum()], [(v * out).sum(), v.sum() + 1e-2]])
            a, b = np.array([a, b]) - np.linalg.solve(h, g)
        self.slope, self.offset = float(a), float(b)
        p = sigmoid(a * out + b)
        secrets, plain = p[y > 0], p[y == 0]
        order = np.argsort(secrets, kind="stable")
        secrets, share = secrets[order], np.cumsum(weight[y > 0][order])
        # The highest value that leaves at most a share of 1 - RECALL of the secrets below it, and from there half
        # the way down to the next ordinary finding.
        most = float(secrets[np.searchsorted(share, (1 - RECALL) * share[-1], side="right")])
        self.threshold = max(0.5, (most + float(plain[plain < most].max(initial=0.0))) / 2)

    def probabilities(self, windows: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.forward(windows, extra)[0] + self.offset)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def labelled_findings(text: str) -> list[tuple[np.ndarray, list[float], int]]:
    """Windows of all secrets and ordinary findings of the text, and whether they are secrets."""
    taken, out = base_findings(text), []
    for start, end, kind in taken:
        if kind == "assign":
            value = BASE[0][1].match(text, start)
            start = value.start(2)
        if end - start >= 16:
            out.append((window(text, start, end), summary(text, start, end), 1))
    spans = []
    for m in EVERYDAY.finditer(text):
        run = m[0]
        if len(run) >= 12 or not run.isalpha() and any(map(str.isdigit, run)):
            spans.append(m.span())
    for start, end in outside(spans, taken):
        out.append((window(text, start, end), summary(text, start, end), 0))
    return out


def findings(docs: DataFrame, text: str = "text") -> DataFrame:
    """``order window size entropy y``: the different labelled findings of every text."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (w.tobytes(), *extra, y) for body in batch["text"] for w, extra, y in labelled_findings(body or "")
            ]
            yield pd.DataFrame(rows, columns=["window", "size", "entropy", "y"]).astype({"y": "int32"}).drop_duplicates()

    found = docs.select(F.col(text).alias("text")).mapInPandas(gather, "window binary, size double, entropy double, y int")
    return found.distinct().select(F.md5("window").alias("order"), "*")


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    windows = np.frombuffer(b"".join(rows["window"]), np.int8).reshape(len(rows), -1)
    return windows, rows[["size", "entropy"]].to_numpy(float), rows["y"].to_numpy(float)


def _packed(train: DataFrame, shards: int) -> DataFrame:
    """A row for each shard with all of its findings, in a fixed order; moved once, for all passes."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        windows, extra, y = _arrays(rows.sort_values(["order", "size", "y"], kind="stable"))
        blobs = [x.tobytes() for x in (windows, extra, y.astype(np.int8))]
        return pd.DataFrame([[key[0], *blobs]], columns=["shard", "windows", "extra", "y"])

    dealt = train.repartition(shards, "shard").groupBy("shard")
    return materialise(dealt.applyInPandas(pack, "shard int, windows binary, extra binary, y binary"), "shards")


def _trained(net: Network, shards: DataFrame, weights: np.ndarray, turn: int) -> np.ndarray:
    """The state of ``net`` after one pass of each of ``shards``, averaged."""
    start = net.state()

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, *blobs in batch.itertuples(index=False):
                y = np.frombuffer(blobs[2], np.int8).astype(int)
                windows = np.frombuffer(blobs[0], np.int8).reshape(len(y), -1)
                extra = np.frombuffer(blobs[1], float).reshape(len(y), -1)
                own = Network(np.random.default_rng(SEED))
                own.restore(start)
                own.train(windows, extra, y, weights[y], np.random.default_rng([SEED, turn, shard]))
                yield pd.DataFrame({"shard": [shard], "state": [own.state()]})

    made = shards.mapInPandas(learn, "shard int, state array<double>")
    return np.mean([r["state"] for r in sorted(made.collect(), key=lambda r: r["shard"])], axis=0)


def fit(docs: DataFrame, text: str = "text") -> Network:
    """Trains on all findings of every document, ``PASSES`` times. The driver holds networks, one of each shard, and bins."""
    net = Network(np.random.default_rng(SEED))
    found = materialise(findings(docs, text).drop("order"), "findings").select(F.md5("window").alias("order"), "*")
    digest = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    held = F.pmod(digest, F.lit(HELD_PARTS)) == HELD_PARTS - 1
    found = found.withColumn("held", held)
    n = {(r["held"], r["y"]): r["count"] for r in found.groupBy("held", "y").count().collect()}
    if len(n) < 4:
        return net
    total = n[False, 0] + n[False, 1]
    weights = np.array([total / (2 * n[False, y]) for y in (0, 1)])
    shards = -(-total // SHARD_FINDINGS)
    shard = F.pmod(F.floor(digest / HELD_PARTS), F.lit(shards)).cast("int")
    train = _packed(found.where("NOT held").withColumn("shard", shard), shards)
    for turn in range(PASSES):
        net.restore(_trained(net, train, weights, turn))

    def outputs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                windows, extra, y = _arrays(batch[at : at + 4096])
                bins = np.round(net.forward(windows, extra)[0] / BIN).astype(np.int64)
                yield pd.DataFrame({"bin": bins, "y": y.astype(np.int32)})

    bins = found.where("held").mapInPandas(outputs, "bin long, y int").groupBy("bin", "y").count()
    bins = bins.toPandas().sort_values(["bin", "y"])
    y = bins["y"].to_numpy()
    net.calibrate(bins["bin"].to_numpy() * BIN, y.astype(float), bins["count"].to_numpy() * weights[y])
    return net


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join([f"{kind}:{start}:{end}" for start, end, kind in spans])


def scan(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id n_assign n_access n_hex base_sha256 spans`` for every row."""
    named = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kinds = [b[0] for b in BASE]
    rank = {kind: k for k, kind in enumerate([*kinds, ADDED])}

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bases, seen, windows, extra = [], [], [], []
            for row, body in enumerate(batch["_text"]):
                body = body or ""
                base = base_findings(body)
                bases.append(base)
                for start, end in candidates(body, base):
                    seen.append((row, start, end))
                    windows.append(window(body, start, end))
                    extra.append(summary(body, start, end))
            spans = [list(b) for b in bases]
            for at in range(0, len(seen), 4096):
                part = slice(at, at + 4096)
                p = net.probabilities(np.array(windows[part]), np.array(extra[part]))
                for (row, start, end), sure in zip(seen[part], p >= net.threshold):
                    if sure:
                        spans[row].append((start, end, ADDED))
            out = pd.DataFrame({"_id": batch["_id"]})
            for kind in kinds:
                out[f"n_{kind}"] = [sum(x[2] == kind for x in b) for b in bases]
            out["base_sha256"] = [hashlib.sha256(listed(b).encode()).hexdigest() for b in bases]
            out["spans"] = [listed(sorted(s, key=lambda x: (x[0], rank[x[2]]))) for s in spans]
            yield out

    kind = named.schema["_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in kinds)
    found = named.mapInPandas(find, f"_id {kind}, {counts}, base_sha256 string, spans string")
    return found.withColumnRenamed("_id", doc_id)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, fit(docs))
