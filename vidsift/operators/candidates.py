"""Union of channel hits into frame candidates, filter modes, representatives and structured ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidsift.operators.fusion import STRUCTURED_WEIGHTS, rrf_columns
from vidsift.operators.ranking import by_score, rank_by

FRAME_CHANNELS = ("clip", "object", "attribute", "ocr", "asr")
LAST = 10**9


def channel_hits(df: DataFrame, channel: str, rank: str = "rank", score: str = "score") -> DataFrame:
    """query_id, video_id, keyframe_id, channel, rank, score: the shape in which channels meet."""
    return df.select(F.col("query_id").cast("long").alias("query_id"), "video_id", F.col("keyframe_id").cast("int").alias("keyframe_id"), F.lit(channel).alias("channel"), F.col(rank).cast("long").alias("rank"), F.col(score).cast("double").alias("score"))


def union_candidates(channels: Sequence[DataFrame]) -> DataFrame:
    """One row per query and frame with each channel's best rank and its score; absent ones are null.

    One exchange: the tagged hits of all channels are united and grouped once, instead of a chain of outer joins.
    """
    hits = reduce(DataFrame.unionByName, channels).filter(F.col("keyframe_id").isNotNull())
    aggs = []
    for c in FRAME_CHANNELS:
        own = F.min(F.when(F.col("channel") == c, F.struct("rank", F.col("score"))))
        aggs.append(own.alias(f"__{c}"))
    wide = hits.groupBy("query_id", "video_id", "keyframe_id").agg(*aggs, F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("provenance"))
    cols = [x for c in FRAME_CHANNELS for x in (F.col(f"__{c}.rank").alias(f"{c}_rank"), F.col(f"__{c}.score").alias(f"{c}_score"))]
    return wide.select("query_id", "video_id", "keyframe_id", *cols, "provenance")


def apply_modes(candidates: DataFrame, modes: Mapping[str, str]) -> DataFrame:
    """hard: only frames the channel found stay; soft: it adds ranks; disabled: its ranks don't count."""
    out = candidates
    for c, mode in modes.items():
        if mode == "hard":
            out = out.filter(F.col(f"{c}_rank").isNotNull())
        elif mode == "disabled":
            out = out.withColumns({f"{c}_rank": F.lit(None).cast("long"), f"{c}_score": F.lit(None).cast("double")})
        elif mode != "soft":
            raise ValueError(f"unknown mode {mode}")
    return out


def frame_score() -> Column:
    return rrf_columns({c: F.col(f"{c}_rank") for c in FRAME_CHANNELS})


def _late(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(LAST))


def representative_order(rule: str) -> list[Column]:
    """The sort key of a video's representative frame. Rules by what is active: hard_attribute, hard_object, clip, object, attribute, hybrid."""
    down = lambda c: F.col(c).desc_nulls_last()
    return {
        "hard_attribute": [F.col("attribute_rank").isNull(), F.col("clip_score").isNull(), down("clip_score"), down("attribute_score"), _late("attribute_rank"), _late("clip_rank")],
        "hard_object": [F.col("object_rank").isNull(), F.col("clip_score").isNull(), down("clip_score"), down("object_score"), _late("clip_rank"), _late("object_rank")],
        "clip": [down("clip_score"), _late("clip_rank")],
        "object": [down("object_score"), _late("object_rank")],
        "attribute": [down("attribute_score"), _late("attribute_rank")],
        "hybrid": [by_score(frame_score()), *[_late(f"{c}_rank") for c in ("clip", "object", "attribute")]],
    }[rule] + [F.col("keyframe_id")]


def structured_videos(candidates: DataFrame, rule: str = "hybrid", frames: int = 5, top: int | None = None) -> DataFrame:
    """Videos by weighted reciprocal ranks: each channel's best rank of a video becomes a rank among videos, then fuses.

    query_id, video_id, score, keyframe_id (the representative's), frame_count, frames (representative first, then by
    frame score, joined by `>`), rank.
    """
    order = rank_by(candidates, ["query_id", "video_id"], [by_score(frame_score()), *[_late(f"{c}_rank") for c in ("clip", "object", "attribute")], F.col("keyframe_id")], "__by_score")
    rep = rank_by(order, ["query_id", "video_id"], representative_order(rule), "__rep")
    first = F.col("__rep") == 1
    seq = F.struct((~first).alias("late"), "__by_score", "keyframe_id")
    per = rep.groupBy("query_id", "video_id").agg(
        *[F.min(f"{c}_rank").alias(f"{c}_best") for c in FRAME_CHANNELS],
        F.max(F.when(first, F.col("keyframe_id"))).alias("keyframe_id"),
        F.count(F.lit(1)).alias("frame_count"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(first | (F.col("__by_score") <= frames), seq))), 1, frames), lambda x: x["keyframe_id"].cast("string")), ">").alias("frames"),
    )
    for c in FRAME_CHANNELS:
        per = rank_by(per, ["query_id"], [F.col(f"{c}_best").asc_nulls_last(), F.col("video_id")], f"__{c}")
        per = per.withColumn(f"{c}_video_rank", F.when(F.col(f"{c}_best").isNotNull(), F.col(f"__{c}"))).drop(f"__{c}")
    ranks = {c: F.col(f"{c}_video_rank") for c in FRAME_CHANNELS if c in STRUCTURED_WEIGHTS}
    scored = per.withColumn("score", rrf_columns(ranks))
    out = rank_by(scored, ["query_id"], [by_score("score"), *[_late(f"{c}_video_rank") for c in ("clip", "object", "attribute")], F.col("video_id")], "rank", top)
    return out.select("query_id", "video_id", "score", "keyframe_id", "frame_count", "frames", *[f"{c}_video_rank" for c in FRAME_CHANNELS], "rank")


def fallback_frames(videos: DataFrame, candidates: DataFrame, best_frames: DataFrame) -> DataFrame:
    """Videos (query_id, video_id) without a candidate frame get their best frame, marked as representative only, without a rank."""
    missing = videos.select("query_id", "video_id").distinct().join(candidates, ["query_id", "video_id"], "left_anti")
    return missing.join(best_frames, ["query_id", "video_id"], "left").withColumn("representative_only", F.lit(True))


def evidence_states(candidates: DataFrame, enabled: Mapping[str, bool], known: Mapping[str, Column]) -> DataFrame:
    """Per modality matched, not_matched, unknown (no data to test) or disabled."""
    def state(c: str) -> Column:
        if not enabled.get(c, True):
            return F.lit("disabled")
        return F.when(F.col(f"{c}_rank").isNotNull(), "matched").when(F.coalesce(known.get(c, F.lit(True)), F.lit(False)), "not_matched").otherwise("unknown")

    return candidates.withColumns({f"{c}_state": state(c) for c in FRAME_CHANNELS})


def enriched(hits: DataFrame, metadata: DataFrame, keywords: str = "keywords", most: int = 8) -> DataFrame:
    """Hits with what is known of their video (one row each in `metadata`), the first `most` keywords of it; a video without keeps nulls."""
    own = metadata.withColumn(keywords, F.slice(keywords, 1, most))
    return hits.join(own, "video_id", "left")
