"""Frames around seeds within a video, sampling grids, and mapping of source frames to stored ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidsift.functions.vectors import cosine
from vidsift.operators.ranking import by_score, rank_by, spaced
from vidsift.operators.temporal import asof_nearest

MOST_MAPPING_SECONDS = 5.0
#: Seconds between the anchors around which frames are looked at closely.
ANCHOR_GAP = 1.0


def localised(seeds: DataFrame, frames: DataFrame, queries: DataFrame, radius: float, top: int | None = None) -> DataFrame:
    """query_id, video_id, keyframe_id, t, score, rank: frames (video_id, keyframe_id, t, vector) within `radius` of a seed
    (query_id, video_id, t) of their video, by similarity to the query (query_id, query_vector). Time bins join them; the order
    of videos isn't touched."""
    cell = lambda t: F.floor(t / radius).cast("long")
    s = seeds.filter(F.col("t").isNotNull()).select("query_id", "video_id", F.col("t").alias("at")).distinct()
    s = s.withColumn("cell", F.explode(F.sequence(cell(F.col("at")) - 1, cell(F.col("at")) + 1)))
    near = frames.withColumn("cell", cell(F.col("t"))).select("video_id", "cell", "keyframe_id", "t").join(s, ["video_id", "cell"]).filter(F.abs(F.col("t") - F.col("at")) <= radius)
    keys = near.select("query_id", "video_id", "keyframe_id").distinct()
    scored = keys.join(frames, ["video_id", "keyframe_id"]).join(queries, "query_id").withColumn("score", cosine(F.col("vector"), F.col("query_vector")))
    one = scored.groupBy("query_id", "video_id", "keyframe_id").agg(F.max(F.struct("score", "t")).alias("b")).select("query_id", "video_id", "keyframe_id", "b.score", "b.t")
    return rank_by(one, ["query_id", "video_id"], [by_score("score"), F.col("keyframe_id")], "rank", top)


def localised_spaced(seeds: DataFrame, frames: DataFrame, queries: DataFrame, radius: float, gap: float, keep: int) -> DataFrame:
    """`localised`, then of each video `keep` frames that lie `gap` seconds apart, the best first: adds is_spaced, spaced_rank."""
    return spaced(localised(seeds, frames, queries, radius), ["query_id", "video_id"], "t", "rank", gap, keep)


def _near(rows: DataFrame, centres: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Rows (keys, t) within `reach` of a centre (keys, at) of theirs, each once; joined by time bins."""
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    c = centres.withColumn("cell", F.explode(F.sequence(cell("at") - 1, cell("at") + 1)))
    return rows.withColumn("cell", cell("t")).join(c, [*keys, "cell"]).filter(F.abs(F.col("t") - F.col("at")) <= reach).select(*rows.columns).distinct()


def two_stage(coarse: DataFrame, fine: DataFrame, keys: list[str], *, anchors: int, window: float, gap: float, keep: int, fps: float) -> DataFrame:
    """Frames of a video in two stages from tables of scored times (keys, t, score): keys, frame_idx, t, score, is_spaced, rank.

    The best coarse times that lie ANCHOR_GAP apart are anchors (`anchors` at most); fine times within `window` of one join
    them. A frame number counts once, with its best score; of these, `keep` that lie `gap` apart, the best first, filled up by rank.
    The scores come from a decoder and a model elsewhere; null scores don't count.
    """
    order = [by_score("score"), F.col("t")]
    c = coarse.filter(F.col("score").isNotNull()).select(*keys, F.col("t").cast("double").alias("t"), F.col("score").cast("double").alias("score"))
    f = fine.filter(F.col("score").isNotNull()).select(*keys, F.col("t").cast("double").alias("t"), F.col("score").cast("double").alias("score"))
    picked = spaced(rank_by(c.dropDuplicates([*keys, "t", "score"]), keys, order, "__r"), keys, "t", "__r", ANCHOR_GAP, anchors).filter("is_spaced")
    both = c.unionByName(_near(f, picked.select(*keys, F.col("t").alias("at")), keys, window))
    once = both.groupBy(*keys, F.bround(F.col("t") * fps, 0).cast("long").alias("frame_idx")).agg(F.max(F.struct("score", (-F.col("t")).alias("n"))).alias("b")).select(*keys, "frame_idx", (-F.col("b.n")).alias("t"), F.col("b.score").alias("score"))
    ranked = spaced(rank_by(once, keys, [*order, F.col("frame_idx")], "__r"), keys, "t", "__r", gap, keep)
    return ranked.select(*keys, "frame_idx", "t", "score", "is_spaced", F.col("spaced_rank").alias("rank"))


def refined_events(coarse: DataFrame, fine: DataFrame, keys: list[str], window: float, fps: float) -> DataFrame:
    """The best moment of an event: the best coarse time, then the best fine time within `window` of it (earlier ones first):
    keys, coarse_t, t, score, frame_idx; t is null where no fine time is near."""
    best = lambda df, name: df.filter(F.col("score").isNotNull()).groupBy(*keys).agg(F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("t")).alias("n"))).alias("b")).select(*keys, (-F.col("b.n")).alias(name), F.col("b.s").alias(f"{name}_score"))
    rough = best(coarse, "coarse_t")
    near = fine.join(rough.select(*keys, "coarse_t"), keys).filter(F.abs(F.col("t") - F.col("coarse_t")) <= window)
    exact = best(near.select(*keys, "t", "score"), "t")
    return rough.join(exact, keys, "left").select(*keys, "coarse_t", "t", F.col("t_score").alias("score"), F.bround(F.col("t") * fps, 0).cast("long").alias("frame_idx"))


def dense_candidates(events: DataFrame, scores: DataFrame, shift: float, top: int = 12) -> DataFrame:
    """For each chosen moment (video_id, event_id, at) the `top` best scored times (video_id, event_id, t, score) within `shift`
    seconds: video_id, event_id, at, t, score, rank."""
    keys = ["video_id", "event_id"]
    cell = lambda c: F.floor(F.col(c) / shift).cast("long")
    e = events.select(*keys, "at").distinct().withColumn("cell", F.explode(F.sequence(cell("at") - 1, cell("at") + 1)))
    near = scores.filter(F.col("score").isNotNull()).withColumn("cell", cell("t")).join(e, [*keys, "cell"]).filter(F.abs(F.col("t") - F.col("at")) <= shift)
    return rank_by(near.select(*keys, "at", "t", "score").distinct(), [*keys, "at"], [by_score("score"), F.col("t")], "rank", top)


def sampling_times(start: Column, end: Column, fps: float, limit: int) -> Column:
    """Times from start on at fps, `limit` at most, not before 0."""
    first = F.greatest(start, F.lit(0.0))
    count = F.least(F.lit(limit), F.floor((F.greatest(end, first) - first) * fps).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.round(first + i / fps, 6))


def thinned(times: Column, limit: int) -> Column:
    """An ordered array thinned evenly to `limit` values; rounding is half to even."""
    n = F.size(times)
    if limit == 1:
        return F.when(n <= 1, times).otherwise(F.array(F.get(times, F.floor(n / 2).cast("int"))))
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.bround(i * (n - 1) / F.lit(limit - 1), 0).cast("int")))
    return F.when(n <= limit, times).otherwise(F.transform(at, lambda i: F.get(times, i)))


def time_to_frame(times: DataFrame, refs: DataFrame, fps: Column, most: float = 600.0) -> DataFrame:
    """The frame number of each time (entity, id, t): the nearest ref's number plus the rest of the time in frames, not below 0.

    Times farther than `most` seconds from any ref give none."""
    near = asof_nearest(times, refs.select("entity", "t", "ref"), most)
    j = near.select("id", "ref", "entity").join(refs.withColumnRenamed("t", "rt"), ["entity", "ref"]).join(times.select("id", "t"), "id")
    return j.select("id", "ref", F.greatest(F.bround(F.col("frame_idx") + (F.col("t") - F.col("rt")) * fps, 0), F.lit(0.0)).cast("long").alias("frame"))


def map_source_frames(source: DataFrame, frames: DataFrame, most: float = MOST_MAPPING_SECONDS) -> DataFrame:
    """Source rows (id, video_id, seconds, frame) to stored frames: by time where it is known, else by frame number.

    id, keyframe_id, distance_seconds, by (time or frame). Rows farther than `most` seconds from any frame give none.
    """
    known = frames.filter(F.col("pts_time").isNotNull() & F.col("keyframe_id").isNotNull())
    by_time = known.groupBy(F.col("video_id").alias("entity"), F.col("pts_time").alias("t")).agg(F.min("keyframe_id").alias("ref"))
    rate = known.filter("fps > 0").groupBy(F.col("video_id").alias("entity")).agg(F.max("fps").alias("fps"))
    # frame numbers become seconds at the video's rate on both sides, so that one join and one limit serve
    numbered = known.filter("frame_idx IS NOT NULL").groupBy(F.col("video_id").alias("entity"), "frame_idx").agg(F.min("keyframe_id").alias("ref"))
    by_frame = numbered.join(rate, "entity").select("entity", (F.col("frame_idx") / F.col("fps")).alias("t"), "ref")
    s = source.withColumnRenamed("video_id", "entity")
    a = asof_nearest(s.filter("seconds IS NOT NULL").select("entity", "id", F.col("seconds").alias("t")), by_time, most).withColumn("by", F.lit("time"))
    f = s.filter("seconds IS NULL AND frame IS NOT NULL").join(rate, "entity").select("entity", "id", (F.col("frame") / F.col("fps")).alias("t"))
    b = asof_nearest(f, by_frame, most).withColumn("by", F.lit("frame"))
    return a.unionByName(b).select("id", F.col("ref").alias("keyframe_id"), F.col("distance").alias("distance_seconds"), "by")
