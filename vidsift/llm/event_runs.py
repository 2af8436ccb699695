"""Runs of near-identical consecutive events: optimal segmentation by pruned dynamic programming."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidsift.session import cut, parallelism

#: Costs are whole numbers, so that sums are exact: a dissimilarity of 1.0 is UNIT.
UNIT = 10**9
#: Events that a task should segment.
PART_ROWS = 250_000

_RUNS = pa.schema(
    [
        ("part", pa.int64()),
        ("seq", pa.int64()),
        ("entity", pa.string()),
        ("first_id", pa.int64()),
        ("last_id", pa.int64()),
        ("n", pa.int64()),
        ("t_first", pa.float64()),
        ("t_last", pa.float64()),
        ("open_left", pa.bool_()),
        ("open_right", pa.bool_()),
        ("first_key", pa.string()),
        ("last_key", pa.string()),
    ]
)
_RUNS_DDL = "part long, seq long, entity string, first_id long, last_id long, n long, t_first double, t_last double, open_left boolean, open_right boolean, first_key string, last_key string"


def text_key(text: str) -> str:
    """Letters and digits only, without case and accents (đ counts as d)."""
    d = unicodedata.normalize("NFD", text.casefold())
    return "".join(c for c in d if c.isalnum() and unicodedata.category(c) != "Mn").replace("đ", "d")


def edits_within(a: str, b: str, most: int) -> int:
    """Insertions, deletions and substitutions that turn a into b; most + 1 if more are needed.

    Bit-parallel over the columns of the edit matrix, after equal ends are taken off.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    lo, hi = 0, min(len(a), len(b))
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < hi - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[lo : len(a) - end], b[lo : len(b) - end]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, left = full, 0, m, len(b)
    for c in b:
        left -= 1
        eq = where.get(c, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(h | up))
        mh = up & h
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score - left > most:  # no later column can bring it down far enough
            return most + 1
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        up = mh | (full & ~(x | ph))
        down = ph & x
    return min(score, most + 1)


def dissimilarity(a: str, b: str, per_mille: int) -> int:
    """Edits by the longer length in UNITs, rounded down; UNIT if above per_mille thousandths (rounding hides no excess)."""
    longest = max(len(a), len(b))
    if a == b or not longest:
        return 0
    most = longest * per_mille // 1000
    d = edits_within(a, b, most)
    return d * UNIT // longest if d <= most else UNIT


class Segmenter:
    """Cheapest segmentation of one ordered sequence: the costs within runs plus a penalty for each run.

    A run costs the sum of the dissimilarities of its neighbouring events. F(t) is the least cost of the first t
    events; a candidate is a start of the run that holds event t, with its cost, its first event and the runs before
    it. A candidate that costs more than closing at t and starting anew can never win and is pruned, so only few are
    ever kept. Equal costs: the longer run. Once a single candidate is left, the runs before it are settled.
    """

    def __init__(self, penalty: int) -> None:
        self.penalty, self.best, self.count = penalty, 0, 0
        #: cost, number of the first event, first event, runs before as a chain (chain, first event, last event, events).
        self.open: list[tuple] = []
        self.last = None

    def _closed(self) -> tuple:
        """The runs of the cheapest segmentation of all events so far."""
        _, at, first, before = min(self.open, key=lambda c: c[0])
        return before, first, self.last, self.count - at

    def add(self, cost: int, event: object) -> None:
        """The next event, whose dissimilarity to the one before is cost (any value for the first)."""
        before = self._closed() if self.open else None
        grown = [(c + cost, at, first, b) for c, at, first, b in self.open]
        grown.append((self.best + self.penalty, self.count, event, before))
        self.best = min(c[0] for c in grown)
        self.open = [c for c in grown if c[0] <= self.best + self.penalty]
        self.last, self.count = event, self.count + 1

    @staticmethod
    def _listed(chain: tuple | None) -> list[tuple]:
        out = []
        while chain is not None:
            out.append(chain[1:])
            chain = chain[0]
        return out[::-1]

    def settled(self) -> list[tuple]:
        """First event, last event and number of events of the runs that nothing can change any more, each once, in order."""
        if len(self.open) != 1 or self.open[0][3] is None:
            return []
        cost, at, first, before = self.open[0]
        self.open = [(cost, at, first, None)]
        return self._listed(before)

    def rest(self) -> list[tuple]:
        """The runs after the settled ones, when no event follows."""
        return self._listed(self._closed())


def _segments(per_mille: int):
    """One range partition, in order, to its runs; the runs at its ends keep their texts, to be joined with the next part's."""
    penalty = per_mille * UNIT // 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, entity, part, seq, opening, first_key, last_key = None, None, 0, 0, True, None, None
        out: list[dict] = []

        def emit(runs: list[tuple], ending: bool) -> None:
            nonlocal seq, opening
            for i, ((first_id, t_first), (last_id, t_last), n) in enumerate(runs):
                right = ending and i == len(runs) - 1
                out.append(
                    {
                        "part": part, "seq": seq, "entity": entity, "first_id": first_id, "last_id": last_id, "n": n, "t_first": t_first, "t_last": t_last,
                        "open_left": opening, "open_right": right, "first_key": first_key if opening else None, "last_key": last_key if right else None,
                    }
                )
                seq, opening = seq + 1, False

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for part_now, own, rid, t, text in zip(*cols):
                key = text_key(text)
                if seg is None or own != entity:
                    if seg is not None:
                        emit(seg.rest(), False)
                    else:
                        first_key = key
                    part, entity, seg = part_now, own, Segmenter(penalty)
                    seg.add(0, (rid, t))
                else:
                    seg.add(dissimilarity(last_key, key, per_mille), (rid, t))
                    emit(seg.settled(), False)
                last_key = key
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=_RUNS)
                out.clear()
        if seg is not None:
            emit(seg.rest(), True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_RUNS)

    return run


def _stitch(per_mille: int):
    """The end runs of all parts, in order: neighbours whose facing events agree become one run."""
    penalty = per_mille * UNIT // 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now and now["open_right"] and r["open_left"] and now["entity"] == r["entity"] and dissimilarity(now["last_key"], r["first_key"], per_mille) <= penalty:
                    now |= {k: r[k] for k in ("last_id", "t_last", "open_right", "last_key")} | {"n": now["n"] + r["n"]}
                else:
                    if now:
                        out.append(now)
                    now = r
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_RUNS)
        if now:
            yield pa.RecordBatch.from_pylist([now], schema=_RUNS)

    return run


def collapse_runs(
    events: DataFrame,
    *,
    entity: str,
    event_id: str,
    position: str,
    time: str,
    text: str,
    per_mille: int = 150,
    parts: int | None = None,
) -> DataFrame:
    """One row per run: entity, first_id, last_id, n_events, first_time, last_time, duration_seconds.

    Events with null `position` or null or blank text are left out; of several events of one entity and position
    only the one with the smallest event_id counts. Order within an entity: time (null last), then position. The
    segmentation minimises the dissimilarity of neighbours within runs (edits by the longer of the two texts,
    compared by `text_key`) plus per_mille / 1000 for each run; since a run's cost is a sum over neighbours, its
    runs are those in which each event differs from the one before by per_mille thousandths at most. Texts without
    letters and digits are equal to each other. Runs of one event are rows too; an empty table gives none. A null
    entity counts as one of its own. duration_seconds is null where a time is. Other columns are ignored.

    Events are range-partitioned by entity, time and position, so that a long entity lies in several tasks; each
    task segments its part, and the (at most two) runs at the ends of each part are joined afterwards, by the same cost.
    The number of parts follows the number of rows; a task holds only runs that later events can still change.
    """
    parts = parts or max(parallelism(events.sparkSession), events.count() // PART_ROWS + 1)
    e = events.select(
        F.col(entity).alias("entity"),
        F.col(event_id).cast("long").alias("rid"),
        F.col(position).alias("pos"),
        F.col(time).cast("double").alias("t"),
        F.col(text).alias("text"),
    ).filter(F.col("pos").isNotNull() & F.col("rid").isNotNull() & F.col("text").rlike(r"(?U)\S"))
    once = e.groupBy("entity", "pos").agg(F.min_by(F.struct("t", "text"), "rid").alias("v"), F.min("rid").alias("rid")).select("entity", "pos", "rid", "v.t", "v.text")
    order = [F.col("entity").asc_nulls_first(), F.col("t").asc_nulls_last(), F.col("pos").asc()]
    placed = once.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    runs = cut(
        placed.select(F.spark_partition_id().cast("long").alias("part"), "entity", "rid", "t", "text").mapInArrow(_segments(per_mille), _RUNS_DDL)
    )
    ends = F.col("open_left") | F.col("open_right")
    joined = runs.filter(ends).repartition(1).sortWithinPartitions("part", "seq").mapInArrow(_stitch(per_mille), _RUNS_DDL)
    return (
        runs.filter(~ends)
        .unionByName(joined)
        .select(
            F.col("entity").alias(entity),
            F.col("first_id"),
            F.col("last_id"),
            F.col("n").alias("n_events"),
            F.col("t_first").alias("first_time"),
            F.col("t_last").alias("last_time"),
            (F.col("t_last") - F.col("t_first")).alias("duration_seconds"),
        )
    )
