"""Joins in time and alignment of ordered events within a video."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidsift.operators.ranking import by_score, rank_by


def distinct_times(refs: DataFrame, entity: str = "video_id", ref: str = "keyframe_id", time: str = "pts_time") -> DataFrame:
    """One ref per entity and time, its smallest id; rows without a time don't count."""
    return refs.filter(F.col(time).isNotNull() & F.col(ref).isNotNull()).groupBy(F.col(entity).alias("entity"), F.col(time).alias("t")).agg(F.min(ref).alias("ref"))


def asof_nearest(points: DataFrame, refs: DataFrame, most: float, span: float = 60.0) -> DataFrame:
    """The nearest ref of each point (entity, id, t) within `most`: entity, id, ref, distance; ties go to the smaller ref.

    Both sides are cut into time spans, refs also go to the neighbouring span when they lie within `most` of its
    border. So a window holds one entity's span, not its whole time line, and long entities spread over tasks.
    """
    span = max(span, most)  # a ref reaches no farther than the neighbouring span
    cell = lambda t: F.floor(t / span).cast("long")
    p = points.filter(F.col("t").isNotNull()).withColumn("cell", cell(F.col("t"))).select("entity", "cell", "t", F.lit(0).alias("side"), "id", F.lit(None).cast("long").alias("ref"))
    r = refs.withColumn("cell", F.explode(F.array_distinct(F.array(cell(F.col("t") - most), cell(F.col("t")), cell(F.col("t") + most)))))
    r = r.select("entity", "cell", "t", F.lit(1).alias("side"), F.lit(None).cast("long").alias("id"), F.col("ref").cast("long"))
    order = Window.partitionBy("entity", "cell").orderBy("t", "side", "ref", "id")
    seen = F.when(F.col("side") == 1, F.struct("t", "ref"))
    both = p.unionByName(r).withColumn("before", F.last(seen, True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first(seen, True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    option = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("t") - F.col(f"{c}.t")).alias("distance"), F.col(f"{c}.ref").alias("ref")))
    best = F.least(option("before"), option("after"))
    out = both.filter("side = 0").withColumn("b", best).filter(F.col("b.distance") <= most)
    return out.select("entity", "id", F.col("b.ref").alias("ref"), F.col("b.distance").alias("distance"))


def inside_intervals(intervals: DataFrame, refs: DataFrame, width: float = 30.0) -> DataFrame:
    """For each interval (entity, id, t0, t1) the ref inside it that is closest to its middle (ties: the smaller ref).

    Intervals are dealt to time bins of `width` and joined with the refs of the bin, so no interval meets all refs.
    """
    cell = lambda t: F.floor(t / width).cast("long")
    i = intervals.filter(F.col("t0").isNotNull() & F.col("t1").isNotNull() & (F.col("t1") >= F.col("t0"))).withColumn("cell", F.explode(F.sequence(cell(F.col("t0")), cell(F.col("t1")))))
    j = i.join(refs.withColumn("cell", cell(F.col("t"))), ["entity", "cell"]).filter(F.col("t").between(F.col("t0"), F.col("t1")))
    off = F.round(F.abs(F.col("t") - (F.col("t0") + F.col("t1")) / 2), 9)
    return j.groupBy("entity", "id").agg(F.min(F.struct(off.alias("off"), "ref")).alias("b"), F.count(F.lit(1)).alias("inside")).select("entity", "id", F.col("b.ref").alias("ref"), F.col("b.off").alias("off_middle"), "inside")


def within_radius(seeds: DataFrame, refs: DataFrame, radius: float) -> DataFrame:
    """Refs within `radius` of any seed (entity, t) of their entity, each once."""
    cell = lambda t: F.floor(t / radius).cast("long")
    s = seeds.filter(F.col("t").isNotNull()).select("entity", F.col("t").alias("at")).distinct().withColumn("cell", F.explode(F.sequence(cell(F.col("at")) - 1, cell(F.col("at")) + 1)))
    j = refs.withColumn("cell", cell(F.col("t"))).join(s, ["entity", "cell"]).filter(F.abs(F.col("t") - F.col("at")) <= radius)
    return j.groupBy("entity", "ref", "t").agg(F.min(F.round(F.abs(F.col("t") - F.col("at")), 9)).alias("distance"))


def gap_cost(gap: Column, preferred_least: float | None, preferred_most: float | None) -> Column:
    """.25 for a preferred gap that is violated, plus .25 * gap / (gap + 60)."""
    bad: Column = F.lit(False)
    if preferred_least is not None:
        bad = bad | (gap < preferred_least)
    if preferred_most is not None:
        bad = bad | (gap > preferred_most)
    return F.when(bad, F.lit(0.25)).otherwise(F.lit(0.0)) + 0.25 * gap / (gap + 60.0)


def align(
    candidates: DataFrame,
    events: Sequence[str],
    *,
    beam: int = 100,
    least_gap: float = 0.0,
    most_gap: float | None = None,
    hard: bool = True,
    optional: Sequence[str] = (),
    same_frame: bool = False,
    skip_cost: float = 0.15,
    top: int = 20,
) -> DataFrame:
    """Ordered paths through the events' candidates (event_id, video_id, candidate_id, t, local_score) within a video.

    video_id, objective, path (candidate ids joined by `>`; `~skip` for a skipped optional event), matched, first_t,
    last_t, rank. Objective: the sum of local scores less the gap costs and skip costs. After each event the best
    `beam` states of a video stay, by objective, then path; a video without a candidate for a required event drops
    out. A step joins the states with all of the next event's candidates on the video, with order and gap inside the join.
    """
    state = None
    for step, event in enumerate(events):
        own = candidates.filter(F.col("event_id") == event).select("video_id", F.col("candidate_id").cast("string").alias("cid"), F.col("t").alias("ct"), "local_score")
        if state is None:
            started = own.select("video_id", F.col("local_score").alias("objective"), F.col("cid").alias("path"), F.lit(1).alias("matched"), F.col("ct").alias("first_t"), F.col("ct").alias("last_t"))
            state = started
            if event in optional:
                raise ValueError("the first event must be required")
        else:
            gap = F.col("ct") - F.col("last_t")
            ok = (gap >= 0) if same_frame else (gap > 0)
            if hard:
                ok = ok & (gap >= least_gap) & (F.lit(True) if most_gap is None else gap <= most_gap)
            cost = gap_cost(gap, None if hard else least_gap, None if hard else most_gap)
            grown = state.join(own, "video_id").filter(ok).select(
                "video_id", (F.col("objective") + F.col("local_score") - cost).alias("objective"), F.concat_ws(">", "path", "cid").alias("path"),
                (F.col("matched") + 1).alias("matched"), "first_t", F.col("ct").alias("last_t"),
            )
            if event in optional:
                grown = grown.unionByName(state.select("video_id", (F.col("objective") - skip_cost).alias("objective"), F.concat_ws(">", "path", F.lit("~skip")).alias("path"), "matched", "first_t", "last_t"))
            state = grown
        last = step == len(events) - 1
        state = rank_by(state, ["video_id"], [by_score("objective"), F.col("path")], "rank", top if last else beam)
    return state


def feasible(candidates: DataFrame, events: Sequence[str], least_gap: float = 0.0, most_gap: float | None = None) -> DataFrame:
    """Per video with any candidate: FEASIBLE, REQUIRED_EVENT_MISSING:<first missing event> or NO_MONOTONIC_REQUIRED_PATH.

    Exact, with no beam: a candidate is reachable if the latest reachable candidate of the event before it, earlier by
    more than 0 and at least `least_gap`, is earlier by `most_gap` at most. Rows are sorted once per step, never paired.
    """
    have = candidates.groupBy("video_id").agg(*[F.count_if(F.col("event_id") == e).alias(f"n{i}") for i, e in enumerate(events)])
    missing = F.coalesce(*[F.when(F.col(f"n{i}") == 0, F.lit(f"REQUIRED_EVENT_MISSING:{e}")) for i, e in enumerate(events)])
    of = lambda e: candidates.filter(F.col("event_id") == e).select("video_id", F.col("t").cast("double").alias("t"))
    reached = of(events[0])
    for event in events[1:]:
        # sorted by the time from which on a candidate can follow; at equal times a strict order puts followers first
        before = reached.filter("t IS NOT NULL").select("video_id", (F.col("t") + max(least_gap, 0.0)).alias("at"), F.lit(0 if least_gap > 0 else 2).alias("side"), F.col("t").alias("from"))
        own = of(event).filter("t IS NOT NULL").select("video_id", F.col("t").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("double").alias("from"))
        w = Window.partitionBy("video_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
        latest = before.unionByName(own).withColumn("latest", F.max("from").over(w)).filter("side = 1 AND latest IS NOT NULL")
        reached = (latest if most_gap is None else latest.filter(F.col("at") - F.col("latest") <= most_gap)).select("video_id", F.col("at").alias("t"))
    ok = reached.select("video_id", F.lit(True).alias("ok")).distinct()
    return have.join(ok, "video_id", "left").select("video_id", F.coalesce(missing, F.when(F.col("ok"), "FEASIBLE").otherwise("NO_MONOTONIC_REQUIRED_PATH")).alias("status"))


def witnesses(candidates: DataFrame, events: Sequence[str], least_gap: float = 0.0, most_gap: float | None = None, hard: bool = True, same_frame: bool = False) -> DataFrame:
    """Per video with a path through all events the best one: video_id, path (candidate ids), total, first_t, last_t.

    Best: the highest sum of local scores, then the smallest ids. A step goes forward in time (with `same_frame` it may
    stand still); gaps only count where they are `hard`. Each candidate keeps its best path, nothing is cut. With an upper
    gap, states and candidates meet in time bins of that width; without one, rows are sorted once and never paired.
    """
    if not hard:
        least_gap, most_gap = 0.0, None
    of = lambda e: candidates.filter((F.col("event_id") == e) & F.col("t").isNotNull()).select("video_id", F.col("candidate_id").cast("string").alias("c"), F.col("t").cast("double").alias("t"), F.col("local_score").cast("double").alias("s"))
    key = lambda neg, path: F.struct(neg.alias("neg"), path.alias("path"))
    state = of(events[0]).select("video_id", "t", F.col("t").alias("first_t"), key(-F.col("s"), F.array("c")).alias("k"))
    for event in events[1:]:
        own = of(event)
        if most_gap is None:
            # the time from which on a state can be followed; at equal times a strict order puts followers first
            before = state.select("video_id", (F.col("t") + max(least_gap, 0.0)).alias("at"), F.lit(0 if same_frame or least_gap > 0 else 2).alias("side"), F.struct("k", "first_t").alias("b"), F.lit(None).cast("string").alias("c"), F.lit(None).cast("double").alias("t"), F.lit(None).cast("double").alias("s"))
            after = own.select("video_id", F.col("t").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(before.schema["b"].dataType).alias("b"), "c", "t", "s")
            w = Window.partitionBy("video_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
            met = before.unionByName(after).withColumn("best", F.min("b").over(w)).filter("side = 1 AND best IS NOT NULL")
        else:
            wide = max(most_gap, 1e-6)
            cell = lambda c: F.floor(c / wide).cast("long")  # noqa: B023, E731
            p = state.withColumnRenamed("t", "pt").withColumn("cell", F.explode(F.array(cell(F.col("pt")), cell(F.col("pt")) + 1)))
            gap = F.col("t") - F.col("pt")
            ok = (gap >= 0 if same_frame else gap > 0) & (gap >= least_gap) & (gap <= most_gap)
            pairs = own.withColumn("cell", cell(F.col("t"))).join(p, ["video_id", "cell"]).filter(ok)
            met = pairs.groupBy("video_id", "c", "t", "s").agg(F.min(F.struct("k", "first_t")).alias("best"))
        state = met.select("video_id", "t", F.col("best.first_t").alias("first_t"), key(F.col("best.k.neg") - F.col("s"), F.array_append("best.k.path", F.col("c"))).alias("k"))
    best = state.groupBy("video_id").agg(F.min(F.struct("k", "t", "first_t")).alias("b"))
    return best.select("video_id", F.array_join("b.k.path", ">").alias("path"), (-F.col("b.k.neg")).alias("total"), "b.first_t", F.col("b.t").alias("last_t"))


def sessions(rows: DataFrame, entity: str, time: Column, key: str, gap_seconds: float) -> DataFrame:
    """Sessions of an entity: a new one begins after more than gap_seconds without a row."""
    w = Window.partitionBy(entity).orderBy("__t", key)
    d = rows.withColumn("__t", time)
    new = F.when(F.col("__t") - F.lag("__t").over(w) > gap_seconds, 1).otherwise(0)
    numbered = d.withColumn("__new", new).withColumn("session", F.sum("__new").over(w))
    return numbered.groupBy(entity, "session").agg(F.count(F.lit(1)).alias("n"), F.min("__t").alias("first_t"), F.max("__t").alias("last_t"))
