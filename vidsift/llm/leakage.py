"""Passages of held-out test texts in a corpus: Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidsift.llm.visual_forms import connect, folded_sql, form_sql
from vidsift.session import cut, spread

#: Words of a passage; words of a block of the shift table.
PASSAGE_WORDS = 10
BLOCK_WORDS = 2
#: Slots of the shift table and bits of the suffix buckets, as powers of two. Fixed sizes, whatever the test texts: blocks that
#: share a slot take the smaller shift and passages that share a bucket are told apart by comparison, so nothing is missed.
SHIFT_BITS, BUCKET_BITS = 20, 24
#: Words that a task remembers; beyond it the memory starts anew.
REMEMBERED = 500_000
#: Parts over which the places of one passage are dealt when they are compared.
SALTS = 8

_ODD = 0x9E3779B97F4A7C15


class Words:
    """64-bit hashes of words, and of runs of them; equal in all tasks."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Of texts with single spaces: where each text's words begin (and the last ends), each word's number, the words, each word's hash."""
        lists = pc.split_pattern(texts, " ")
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for w in words:
            if w not in self.known:
                self.known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        ids = coded.indices.to_numpy(zero_copy_only=False)
        hashes = np.array([self.known[w] for w in words], np.uint64)
        begin = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        return begin, ids, words, hashes[ids] if len(ids) else hashes

    @staticmethod
    def runs(h: np.ndarray, size: int) -> np.ndarray:
        """The hash of the `size` words from each place on."""
        n = max(len(h) - size + 1, 0)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(size):
                out += h[i : i + n] * np.uint64(pow(_ODD, i + 1, 1 << 64))
            # the last bits of a sum of products are weak
            return (out ^ out >> np.uint64(29)) * np.uint64(_ODD)


def slots(blocks: np.ndarray) -> np.ndarray:
    return (blocks >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)


def patterns(items: list[int], texts: pa.Array, m: int = PASSAGE_WORDS, block: int = BLOCK_WORDS) -> tuple[list[tuple[int, int, str]], dict[int, int]]:
    """Passages (item, hash, words) of test texts, and the shift of each slot: how far the end of a block lies before that of the
    first passage that holds it."""
    begin, ids, words, h = Words().split(texts)
    passages, blocks = Words.runs(h, m).view(np.int64).tolist(), slots(Words.runs(h, block)).tolist()
    out: list[tuple[int, int, str]] = []
    shift: dict[int, int] = {}
    for item, a, b in zip(items, begin[:-1].tolist(), begin[1:].tolist()):
        if b - a < m:
            continue
        out += [(item, passages[j], " ".join(words[i] for i in ids[j : j + m])) for j in range(a, b - m + 1)]
        for j in range(a, b - block + 1):
            shift[blocks[j]] = min(shift.get(blocks[j], m), max(0, m - block - (j - a)))
    return out, shift


class Matcher:
    """The places where a test passage of `m` words may begin. The search looks at the block of words that ends a window: the
    shift table says how far the window can move without missing a passage; where it can't move, the bucket of the window's
    hash says whether a passage of this hash may exist."""

    def __init__(self, shift: np.ndarray, bucket: np.ndarray, m: int = PASSAGE_WORDS, block: int = BLOCK_WORDS) -> None:
        self.shift, self.bucket, self.m, self.block = shift, bucket, m, block
        self.words = Words()

    @staticmethod
    def tables(shift: dict[int, int] | tuple[np.ndarray, np.ndarray], bucket: tuple[np.ndarray, np.ndarray], m: int = PASSAGE_WORDS, block: int = BLOCK_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """The shift of every slot (the longest where no block is) and the bits of the buckets, from the entries that are set."""
        at, value = shift
        moves = np.full(1 << SHIFT_BITS, m - block + 1, np.uint8)
        moves[at] = value
        bits = np.zeros(1 << BUCKET_BITS - 6, np.uint64)
        bits[bucket[0]] = bucket[1]
        return moves, bits

    def search(self, texts: pa.Array) -> list[tuple[int, int, str]]:
        """(number of the text, passage hash, passage) of each place."""
        m, block = self.m, self.block
        begin, ids, words, h = self.words.split(texts)
        # the move for the block that ends the window beginning at each word
        moves = self.shift[slots(self.words.runs(h, block))[m - block :]].tolist()
        found, owner = [], []
        for text, (at, end) in enumerate(zip(begin[:-1].tolist(), (begin[1:] - m).tolist())):
            while at <= end:
                move = moves[at]
                if move:
                    at += move
                else:
                    found.append(at)
                    owner.append(text)
                    at += 1
        if not found:
            return []
        each = (np.array(found)[:, None] + np.arange(m)).ravel()
        passages = self.words.runs(h[each], m)[::m]
        b = (passages >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        ok = (self.bucket[b >> 6] >> (b & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        signed = passages.view(np.int64)
        return [(owner[i], int(signed[i]), " ".join(words[x] for x in ids[found[i] : found[i] + m])) for i in np.flatnonzero(ok).tolist()]


def _fold(con, batch: pa.RecordBatch, folded: str) -> pa.Table:
    con.register("b", pa.Table.from_batches([batch]))
    got = con.sql(f"SELECT k, {folded} AS w FROM b").to_arrow_table()
    con.unregister("b")
    return got.combine_chunks()


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t[name].combine_chunks()
    return c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)


def leaked_passages(docs: DataFrame, items: DataFrame, *, doc_id: str, text: str, item_id: str, item_text: str, words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, item_id (long), windows (long): each item of which a document holds `words` consecutive words or more, once.

    Both are compared in the consistent form of `visual_forms`, without case, accents (đ counts as d), punctuation
    and spacing; a word is an unbroken sequence of letters and digits. `windows` counts the places in the document
    where a window of `words` words of the item begins. Null and empty texts hold nothing; items of fewer words leak
    nowhere; an item that occurs several times under one id counts once; rows of one doc_id are one document. Empty
    tables give no rows. Other columns are ignored.

    The corpus is read once, in one narrow map, however many test texts there are: what each task knows of them is a shift
    table and buckets of fixed size (3 MB). The few places that these let pass are compared with the passages themselves by
    a join; places of one passage are dealt over SALTS parts.
    """
    spark = docs.sparkSession
    key = docs.schema[doc_id].dataType.simpleString()
    folded, block = folded_sql(form_sql("t", other_scripts=False)), BLOCK_WORDS

    def to_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect()
        for batch in batches:
            got = _fold(con, batch, folded)
            rows, shift = patterns(got["k"].to_pylist(), _column(got, "w"), words, block)
            item, h, p = zip(*rows) if rows else ((), (), ())
            none = [None] * len(shift)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*item, *none], pa.int64()), pa.array([*h, *shift], pa.int64()), pa.array([*p, *none], pa.string()), pa.array([None] * len(item) + list(shift.values()), pa.int32())], ["item", "h", "p", "shift"]
            )

    tests = items.select(F.col(item_id).cast("long").alias("k"), F.col(item_text).alias("t")).filter(F.col("t").isNotNull() & F.col("k").isNotNull())
    known = cut(tests.mapInArrow(to_patterns, "item long, h long, p string, shift int"))
    passages = known.filter("item IS NOT NULL").select("item", "h", "p").distinct()
    bucket = F.shiftrightunsigned("h", 64 - BUCKET_BITS)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bucket.bitwiseAND(F.lit(63)).cast("int"))
    moves = known.filter("item IS NULL").groupBy(F.col("h").alias("at")).agg(F.min("shift").alias("value"))
    bits = known.filter("item IS NOT NULL").groupBy(F.shiftrightunsigned(bucket, 6).alias("at")).agg(F.bit_or(one).alias("value"))
    pair = lambda t, kind: (t["at"].to_numpy(), t["value"].to_numpy().astype(kind))
    sent = spark.sparkContext.broadcast(Matcher.tables(pair(moves.toArrow(), np.uint8), pair(bits.toArrow(), np.uint64), words, block))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, matcher = connect(), Matcher(*sent.value, words, block)
        for batch in batches:
            got = _fold(con, batch, folded)
            found = matcher.search(_column(got, "w"))
            if found:
                owner, h, p = zip(*found)
                yield pa.RecordBatch.from_arrays([_column(got, "k").take(pa.array(owner)), pa.array(h, pa.int64()), pa.array(p, pa.string())], ["k", "h", "p"])

    slim = spread(docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t")).filter(F.col("t").isNotNull()))
    places = slim.mapInArrow(scan, f"k {key}, h long, p string").groupBy("k", "h", "p").agg(F.count(F.lit(1)).alias("n"))
    places = places.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int"))
    sure = places.join(passages.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h", "p", "salt"])
    return sure.groupBy("k", "item").agg(F.sum("n").alias("windows")).select(F.col("k").alias(doc_id), F.col("item").alias(item_id), "windows")
