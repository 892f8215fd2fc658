"""SentencePiece encoding and decoding with a merge-type prefix table.

A model of the merge type joins, again and again, the neighbouring pieces whose concatenation has the best score.
Its encoding of a text extends the encoding of a prefix: every prefix has one encoding, hence one last token. The
table holds that token for each prefix of a run of text. Candidates are the pieces that end there (automaton
matches); the right one is the one that is compatible with the last token of the prefix before it, that is, the pair
of both is its own encoding. Ids are then read from the end backwards. Time is linear in the length of the run.

A run ends where no piece could cross: before a word mark that follows another character, around a line feed, and
where symbols meet letters or digits, as far as the model's pieces keep them apart. All of that is read off the model.
Runs that occur again are remembered, up to a bound.

Cases: null counts as empty; an empty text has no ids and decodes to an empty text. Characters that the model lacks
become bytes. Word marks in a text are encoded like blanks, as the library does, and decode to blanks.
Repeated rows are encoded each. Extra columns pass through unread.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F
from sentencepiece import sentencepiece_model_pb2 as model_format

from newslake.llm.common import table

MARK = "▁"
MODEL = "piece_bpe_32k.model"
REMEMBERED_RUNS = 400_000  # in a task
REMEMBERED_PAIRS = 1_000_000
LONG_RUN = 48  # longer runs are not remembered
NEVER = float("-inf")


class KnownRuns(dict):
    """What ``make`` makes of each run, remembered if it is short."""

    def __init__(self, make: Callable[[str], tuple[str, bytes, bytes]]):
        super().__init__()
        self.make = make

    def __missing__(self, run: str) -> tuple[str, bytes, bytes]:
        found = self.make(run)
        if len(run) <= LONG_RUN:
            if len(self) >= REMEMBERED_RUNS:
                self.clear()
            self[run] = found
        return found


class PrefixEncoder:
    """Encoder and decoder of one model file's contents."""

    def __init__(self, model: bytes):
        proto = model_format.ModelProto()
        proto.ParseFromString(model)
        kinds = proto.SentencePiece
        normal, norm = proto.normalizer_spec, proto.trainer_spec
        if norm.model_type != proto.trainer_spec.BPE or not norm.byte_fallback or norm.treat_whitespace_as_suffix:
            raise ValueError("not a merge-type model with byte fallback")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix:
            raise ValueError("this normaliser is not supported")
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.bytes_of: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.NORMAL:
                self.ids[p.piece], self.scores[p.piece] = i, p.score
                self.bytes_of.append(p.piece.replace(MARK, " ").encode())
            elif p.type == kinds.BYTE:
                value = int(p.piece[3:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif p.type in (kinds.USER_DEFINED, kinds.UNUSED):
                raise ValueError("user-defined and unused pieces are not supported")
            else:
                self.bytes_of.append(b"")
        self.names = [p.piece for p in proto.pieces]
        if any(MARK in p.lstrip(MARK) for p in self.ids) or any("\n" in p for p in self.ids):
            raise ValueError("a piece crosses words")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.histories: dict[int, tuple[list, list] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.known = KnownRuns(self.run)
        self.id_text = [str(i) for i in range(len(self.names))]
        alone = re.escape("".join(sorted(self.symbols_apart()))) or MARK
        letters, end = r"[^\W_]", f"{MARK}\n"
        # A word up to a symbol or an end, symbols up to a word or an end, or all up to an end.
        self.split = re.compile(
            f"{MARK}*+{letters}++(?=[{alone}{end}]|$)|{MARK}*+[{alone}]++(?={letters}|[{end}]|$)|{MARK}*+[^{end}]++|{MARK}++|\n"
        ).findall

    def symbols_apart(self) -> set[str]:
        """Characters that no piece has next to a letter or digit; a run may end where they meet."""
        bound = {x for p in self.ids for a, b in zip(p, p[1:]) if a.isalnum() != b.isalnum() for x in (a, b)}
        return {p for p in self.ids if len(p) == 1 and not p.isalnum() and p not in (MARK, "_") and p not in bound}

    def merges(self, text: str) -> tuple[list[str], list[tuple[float, int, int, str]]]:
        """The definition: join the best neighbouring pair, the left one of equals, until none is a piece.

        Returns the pieces left and every join in order: score, start, end, piece.
        """
        parts = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts) and (score := self.scores.get(parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (-score, i, parts[i] + parts[after[i]]))

        for i in range(len(parts) - 1):
            offer(i)
        joins = []
        while heap:
            score, i, joined = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= len(parts) or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            joins.append((-score, i, after[i], joined))
            offer(before[i])
            offer(i)
        return [p for p in parts if p], joins

    def edges(self, token: int) -> tuple[list, list] | None:
        """Joins inside a piece with what each makes of its last, and of its first, part; None if it is never made."""
        if token not in self.histories:
            name = self.names[token]
            parts, joins = self.merges(name)
            self.histories[token] = None if parts != [name] else (
                [(score, made if end == len(name) else None) for score, _, end, made in joins],
                [(score, made if start == 0 else None) for score, start, _, made in joins],
            )
        return self.histories[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the text of both pieces is encoded as just these two; ``left`` below 0: as ``right`` alone.

        The joins inside either piece happen as they do alone, the better first and of equals those on the left,
        unless a join across the boundary is better than what is due next.
        """
        if left < 0:
            return self.edges(right) is not None
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        found = self.pairs[left * 65536 + right] = self._stay_apart(left, right)
        return found

    def _stay_apart(self, left: int, right: int) -> bool:
        one, two = self.edges(left), self.edges(right)
        if one is None or two is None:
            return False
        score, due, due_too = self.scores.get, one[0], two[1]
        x, y, i, j = self.names[left][-1], self.names[right][0], 0, 0
        across = score(x + y)
        while True:
            next_x = due[i][0] if i < len(due) else NEVER
            next_y = due_too[j][0] if j < len(due_too) else NEVER
            if across is not None and across > next_x and across >= next_y:
                return False
            if next_x >= next_y:
                if next_x == NEVER:
                    return True
                made, i = due[i][1], i + 1
                if made:
                    x = made
                    across = score(x + y)
            else:
                made, j = due_too[j][1], j + 1
                if made:
                    y = made
                    across = score(x + y)

    def prefix_table(self, run: str) -> list[int]:
        """The last token of each prefix of ``run``; where a character is no piece, the negative of its code point."""
        last = [-1 - ord(c) for c in run]
        pairs, compatible, done = self.pairs, self.compatible, -1
        for end, (token, size) in self.automaton.iter(run):  # by end, long pieces first
            if end == done:
                continue
            before = last[end - size] if end >= size else -1
            if before < 0:
                fits = compatible(-1, token)
            else:
                fits = pairs.get(before * 65536 + token)
                if fits is None:
                    fits = compatible(before, token)
            if fits:
                last[end], done = token, end
        return last

    def encode_run(self, run: str) -> list[int]:
        last = self.prefix_table(run)
        back, at = [], len(run) - 1
        while at >= 0:
            token = last[at]
            if token < 0:
                back.extend(self.byte_ids[b] for b in reversed(chr(-1 - token).encode("utf-8", "surrogatepass")))
                at -= 1
            else:
                back.append(token)
                at -= len(self.names[token])
        return back[::-1]

    def decode_ids(self, ids: list[int]) -> bytes:
        """Bytes of the ids, before the mark that encoding puts in front is taken off."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def run(self, run: str) -> tuple[str, bytes, bytes]:
        """Ids of a run joined by commas, its decoded bytes, and the ids as 32-bit integers."""
        ids = self.encode_run(run)
        return ",".join(map(self.id_text.__getitem__, ids)), self.decode_ids(ids), array("i", ids).tobytes()

    def runs(self, text: str) -> list[tuple[str, bytes, bytes]]:
        return list(map(self.known.__getitem__, self.split(MARK + text.replace(" ", MARK)))) if text else []

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join([r[2] for r in self.runs(text)]), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decode_ids(ids).decode("utf-8", "replace").removeprefix(" ")


def encode_decode(
    docs: DataFrame,
    model: bytes,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    outputs: tuple[str, ...] = ("n_tokens", "ids_sha256", "decoded_sha256"),
) -> DataFrame:
    """The columns ``keep`` with ``outputs``: ``ids``, ``decoded``, ``n_tokens`` and digests of the first two."""
    kinds = {"ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = PrefixEncoder(model)
        for batch in batches:
            made: dict[str, list] = {name: [] for name in outputs}
            for body in batch["_text"]:
                runs = coder.runs(body or "")
                ids = ",".join([r[0] for r in runs])
                decoded = b"".join([r[1] for r in runs]).removeprefix(b" ").decode("utf-8", "replace")
                row = {
                    "n_tokens": ids.count(",") + 1 if ids else 0,
                    "ids_sha256": hashlib.sha256(ids.encode()).hexdigest(),
                    "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest(),
                    "decoded": decoded,
                }
                if "ids" in made:
                    row["ids"] = np.frombuffer(b"".join([r[2] for r in runs]), np.int32)
                for name, values in made.items():
                    values.append(row[name])
            out = pd.DataFrame(made, index=batch.index)
            yield pd.concat([batch[[f"_keep{k}" for k in range(len(keep))]], out], axis=1)

    kept = docs.select(*[F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)], F.col(text).alias("_text"))
    schema = [f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text"]
    encoded = kept.mapInPandas(encode, ", ".join(schema + [f"{name} {kinds[name]}" for name in outputs]))
    return encoded.select(*[F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)], *outputs)


def model_bytes(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path(MODEL), "rb") as f:
        return f.read()


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), model_bytes())
