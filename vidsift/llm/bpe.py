"""Byte-level BPE encoding of whole texts with a public vocabulary, merged through a hierarchical-bitmap rank queue."""

from __future__ import annotations

import ast
import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidsift.session import spread

TOKENIZERS = "/opt/tokenizers"
#: Pre-tokens that a task remembers; beyond it the memory starts anew, which changes no result.
REMEMBERED = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def load_pattern(root: str) -> str:
    """The pre-token pattern that the vocabulary's package states, read as data: nothing of the package is executed."""
    tree = ast.parse((Path(root) / "__init__.py").read_text(encoding="utf-8"))
    for node in tree.body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "PATTERN" for t in node.targets):
            return ast.literal_eval(node.value)
    raise ValueError(f"{root} states no pattern")


class RankQueue:
    """Ranks in use as bits of 64-bit words, with two levels of summary words above: the least rank in a few steps."""

    def __init__(self, ranks: int) -> None:
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.at: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.at.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.at[rank] = [position]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]] | None:
        """The least rank and all its positions; its bucket is then empty."""
        if not self.top:
            return None
        i = (self.top & -self.top).bit_length() - 1
        w = self.mid[i]
        j = (i << 6) + (w & -w).bit_length() - 1
        w = self.low[j]
        rank = (j << 6) + (w & -w).bit_length() - 1
        self.low[j] &= self.low[j] - 1
        if not self.low[j]:
            self.mid[i] &= self.mid[i] - 1
            if not self.mid[i]:
                self.top &= self.top - 1
        return rank, self.at.pop(rank)


class Encoder:
    """Ids of a text: pre-tokens by pattern, then merges in order of rank, leftmost first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.single = [ranks[bytes([b])] for b in range(256)]
        token = {r: t for t, r in ranks.items()}
        # A merge is the pair of ids that makes a token. All ways to cut a token into two tokens count.
        self.pair: dict[int, int] = {}
        for r, t in token.items():
            for cut_at in range(1, len(t)):
                a, b = ranks.get(t[:cut_at]), ranks.get(t[cut_at:])
                if a is not None and b is not None:
                    self.pair[a << 32 | b] = r
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.known: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token: a linked list of ids, whose pairs wait in the queue under their rank."""
        n, pair, queue = len(data), self.pair, self.queue
        ids = [self.single[b] for b in data]
        if n == 1:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get, push = pair.get, queue.push
        for i in range(n - 1):
            r = get(ids[i] << 32 | ids[i + 1])
            if r is not None:
                push(r, i)
        while (least := queue.pop()) is not None:
            rank, positions = least
            positions.sort()
            for i in positions:
                j = after[i]
                # stale: the place was merged away, or its pair has changed since
                if ids[i] < 0 or j >= n or get(ids[i] << 32 | ids[j]) != rank:
                    continue
                k = after[j]
                ids[i], ids[j], after[i] = rank, -1, k
                if k < n:
                    before[k] = i
                    r = get(rank << 32 | ids[k])
                    if r is not None:
                        push(r, i)
                h = before[i]
                if h >= 0:
                    r = get(ids[h] << 32 | rank)
                    if r is not None:
                        push(r, h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for word in self.find(text):
            ids = known.get(word)
            if ids is None:
                data = word.encode("utf-8")
                whole = self.ranks.get(data)
                ids = self.merge(data) if whole is None else [whole]
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(word) <= 64:
                    known[word] = ids
            out += ids
        return out


#: Encoders that a worker process has built; its later tasks use them again.
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def kept_encoder(name: tuple[str, str], sent) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(*sent.value)
    return _ENCODERS[name]


def encode_corpus(df: DataFrame, *, doc_id: str, text: str, tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """doc_id and ids (array<int>) of each row: the token ids of its whole text, without special tokens.

    Empty and null texts give an empty list; strings of special tokens are ordinary text. Repeated rows give a
    row each; an empty table gives none. Other columns are ignored. No shuffle, save that few input files are
    spread over the cores. The vocabulary (a fixed file of about 1 MB) is read on the driver and sent to the tasks.
    """
    ranks, pattern = load_ranks(f"{tokenizers}/{vocabulary}.tiktoken"), load_pattern(tokenizers)
    sent = df.sparkSession.sparkContext.broadcast((ranks, pattern))
    key = df.schema[doc_id].dataType
    out_type = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_encoder((tokenizers, vocabulary), sent)
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, out_type)], ["k", "ids"])

    slim = spread(df.select(F.col(doc_id).alias("k"), F.col(text).alias("t")))
    return slim.mapInArrow(run, f"k {key.simpleString()}, ids array<int>").select(F.col("k").alias(doc_id), "ids")
