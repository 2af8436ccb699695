"""Reciprocal-rank fusion in its forms, and reranking over fused lists. Raw scores of different channels are never added."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidsift.operators.ranking import by_score, rank_by
from vidsift.operators.temporal import asof_nearest
from vidsift.session import cut

K = 60
#: A text's time is resolved to a stored frame within an hour.
MOST_RESOLVED_SECONDS = 3600.0
STRUCTURED_WEIGHTS = {"clip": 1.0, "object": 0.5, "attribute": 0.35, "metadata": 0.3, "ocr": 0.6, "asr": 0.55}


def _weight(channel: Column, weights: Mapping[str, float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[channel], F.lit(1.0))


def _ordered_sum(parts: Column) -> Column:
    """A sum in the order of the channels' names: sums of floats depend on their order."""
    return F.aggregate(F.array_sort(parts), F.lit(0.0), lambda s, x: s + x["c"])


def rrf_videos(hits: DataFrame, weights: Mapping[str, float] | None = None, k: int = K, top: int | None = None, tie: str = "document_id") -> DataFrame:
    """query_id, video_id, score, best_rank, best_channel, channels, rank from hits (query_id, channel, rank, video_id, `tie`).

    Per channel the first hit of each video (by rank, then tie) gives its rank among videos; contributions are
    weight / (k + rank), channels of weight 0 are left out. Order: score, best rank, video_id. best_channel holds the
    largest contribution (ties: smaller rank, then channel name).
    """
    w = _weight(F.col("channel"), weights)
    one = rank_by(hits.filter(w > 0), ["query_id", "channel", "video_id"], [F.col("rank"), F.coalesce(F.col(tie).cast("string"), F.lit(""))], "__n", 1)
    ranks = rank_by(one, ["query_id", "channel"], [F.col("rank"), F.col("video_id")], "r")
    parts = ranks.withColumn("c", w / (F.lit(k) + F.col("r")))
    agg = parts.groupBy("query_id", "video_id").agg(
        _ordered_sum(F.collect_list(F.struct("channel", "c"))).alias("score"),
        F.min("r").alias("best_rank"),
        F.min(F.struct((-F.col("c")).alias("neg"), "r", "channel")).alias("b"),
        F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"),
    )
    return rank_by(agg.withColumn("best_channel", F.col("b.channel")).drop("b"), ["query_id"], [by_score("score"), F.col("best_rank"), F.col("video_id")], "rank", top)


def rrf_entities(hits: DataFrame, keys: list[str], weights: Mapping[str, float] | None = None, k: int = K) -> DataFrame:
    """The sum of weight / (k + rank) over all hits of an entity, with its best rank and number of hits."""
    parts = hits.withColumn("c", _weight(F.col("channel"), weights) / (F.lit(k) + F.col("rank")))
    agg = parts.groupBy("query_id", *keys).agg(_ordered_sum(F.collect_list(F.struct("channel", "rank", "c"))).alias("score"), F.min("rank").alias("best_rank"), F.count(F.lit(1)).alias("hits"))
    return rank_by(agg, ["query_id"], [by_score("score"), F.col("best_rank"), *[F.col(c) for c in keys]], "rank")


def channel_pool(k: int, pool: int = 200) -> int:
    """How many hits each channel is asked for: `pool`, or k where that is more, 1,000 at most."""
    return min(1000, max(k, pool))


def hybrid(channels: Mapping[str, Callable[[int], DataFrame]], k: int, *, weights: Mapping[str, float] | None = None, pool: int = 200, strict: bool = False, tie: str = "document_id") -> tuple[DataFrame, dict[str, str]]:
    """Videos over several retrievers: each is called with the size of its pool and gives hits (query_id, rank, video_id, `tie`); of
    each query its first hits up to that size are fused. The fused table (see `rrf_videos`, k rows a query) and the retrievers that
    failed with their errors. `strict` raises the first error; without it the others answer, unless all failed."""
    if not channels:
        raise ValueError("at least one retriever is needed")
    size, found, failed = channel_pool(k, pool), [], {}
    for name in sorted(channels):
        try:
            hits = channels[name](size)
            found.append(hits.filter(F.col("rank") <= size).select("query_id", F.lit(name).alias("channel"), "rank", "video_id", tie))
        except Exception as e:
            if strict or len(failed) + 1 == len(channels):
                raise
            failed[name] = f"{type(e).__name__}: {e}"
    return rrf_videos(reduce(DataFrame.unionByName, found), weights, top=k, tie=tie), failed


def refined_frames(clip: DataFrame, text: DataFrame, refs: DataFrame, *, radius: float, limit: int, k: int = K) -> DataFrame:
    """Frames of chosen videos by similarity and by text: query_id, video_id, keyframe_id, t, score, channels, rank.

    clip: query_id, video_id, keyframe_id, rank. text: query_id, channel, video_id, keyframe_id, t, rank, seed_t: a hit farther
    than `radius` from its seed's time (where there is one) doesn't count; one whose frame isn't stored counts for the stored
    frame nearest in time. refs: video_id, keyframe_id, t. A frame's best rank of each channel adds 1 / (k + rank).
    """
    stored = refs.filter(F.col("t").isNotNull()).groupBy("video_id", "keyframe_id").agg(F.min("t").alias("t"))
    near = text.filter(F.col("t").isNotNull() & (F.col("seed_t").isNull() | (F.abs(F.col("t") - F.col("seed_t")) <= radius))).withColumn("__id", F.monotonically_increasing_id())
    near = cut(near)  # the numbers must not change between the two joins below
    exact = near.join(stored.select("video_id", "keyframe_id"), ["video_id", "keyframe_id"]).select("query_id", "channel", "video_id", "keyframe_id", "rank", "__id")
    lost = near.join(exact.select("__id"), "__id", "left_anti")
    points = lost.select(F.col("video_id").alias("entity"), F.col("__id").alias("id"), "t")
    at = asof_nearest(points, stored.groupBy(F.col("video_id").alias("entity"), "t").agg(F.min("keyframe_id").alias("ref")), most=MOST_RESOLVED_SECONDS)
    resolved = lost.drop("keyframe_id").join(at.select(F.col("id").alias("__id"), F.col("ref").cast("int").alias("keyframe_id")), "__id").select("query_id", "channel", "video_id", "keyframe_id", "rank", "__id")
    hits = clip.select("query_id", F.lit("clip").alias("channel"), "video_id", "keyframe_id", "rank").unionByName(exact.unionByName(resolved).drop("__id"))
    best = hits.groupBy("query_id", "video_id", "keyframe_id", "channel").agg(F.min("rank").alias("r"))
    parts = best.withColumn("c", 1.0 / (F.lit(k) + F.col("r")))
    agg = parts.groupBy("query_id", "video_id", "keyframe_id").agg(_ordered_sum(F.collect_list(F.struct("channel", "c"))).alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))
    return rank_by(agg.join(stored, ["video_id", "keyframe_id"]), ["query_id", "video_id"], [by_score("score"), F.col("t"), F.col("keyframe_id")], "rank", limit)


def rrf_columns(ranks: Mapping[str, Column], weights: Mapping[str, float] = STRUCTURED_WEIGHTS, k: int = K) -> Column:
    """The fused score of a wide row with one rank column per channel; a null rank adds nothing."""
    total: Column = F.lit(0.0)
    for channel in weights:
        if channel in ranks:
            total = total + F.coalesce(F.lit(weights[channel]) / (F.lit(k) + ranks[channel]), F.lit(0.0))
    return total


def light_score(base: Column, best: Column, matches: Column, query: Column, evidence: Column, required: Column, matched: Column) -> Column:
    """Base score by the largest, plus .08 per match, .12 times the share of query tokens in the evidence, .06 times the share of required modalities."""
    share = lambda a, b: F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))
    return base / F.greatest(F.abs(best), F.lit(1e-9)) + 0.08 * matches + 0.12 * share(query, evidence) + 0.06 * share(required, matched)


def externally_ranked(hits: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Hits (query_id, keys, rank) in the order of scores that a model elsewhere gave them: adds external_score, new_rank. Scores may only
    reorder: one for what isn't among the hits, or out of 0..1, doesn't count; hits without a score follow in their order."""
    known = scores.filter(F.col("score").between(0.0, 1.0)).groupBy("query_id", *keys).agg(F.max("score").alias("external_score"))
    return rank_by(hits.join(known, ["query_id", *keys], "left"), ["query_id"], [by_score("external_score"), F.col("rank"), *[F.col(k) for k in keys]], "new_rank")
