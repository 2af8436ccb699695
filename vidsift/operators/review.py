"""Around what people see and decide: chosen frames, judged frames' objects, chains that are safe to show, exports, clean payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidsift.operators.objects import FRAME, valid_confidence
from vidsift.operators.ranking import rank_by

METADATA_FIELDS = ("title", "author", "channel_id", "publish_date", "duration", "keywords", "description", "watch_url")


def frame_addressable(hits: DataFrame) -> DataFrame:
    """Hits that name a frame; those of whole videos can't be aligned in time and are only counted (`skipped_hits`)."""
    return hits.filter(F.col("keyframe_id").isNotNull())


def skipped_hits(hits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group how many hits name a frame, and how many don't."""
    return hits.groupBy(*by).agg(F.count("keyframe_id").alias("kept"), F.count_if(F.col("keyframe_id").isNull()).alias("skipped"))


def selected_frames(requests: DataFrame, refs: DataFrame) -> DataFrame:
    """The frame each request (request_id, video_id, keyframe_id) has chosen, without any search; the video's first where it names
    none: request_id, video_id, keyframe_id, status (SELECTED or NOT_IN_INDEX, with a null frame)."""
    first = refs.groupBy("video_id").agg(F.min("keyframe_id").alias("__first"))
    known = refs.select("video_id", F.col("keyframe_id").alias("__k")).distinct()
    r = requests.select("request_id", "video_id", "keyframe_id").join(first, "video_id", "left").withColumn("__want", F.coalesce("keyframe_id", "__first"))
    j = r.join(known, (r["video_id"] == known["video_id"]) & (r["__want"] == known["__k"]), "left")
    return j.select("request_id", r["video_id"], F.col("__k").alias("keyframe_id"), F.when(F.col("__k").isNotNull(), "SELECTED").otherwise("NOT_IN_INDEX").alias("status"))


def judged_objects(judged: DataFrame, detections: DataFrame, wanted: Sequence[str], top: int = 8) -> DataFrame:
    """The best `top` objects of each judged frame (query_id, rank, video_id, keyframe_id, judgement) whose judgement is one of
    `wanted`: the row's keys, object_rank, label, confidence; a frame without objects gives one row without."""
    rows = judged.withColumn("judgement", F.lower(F.trim("judgement"))).filter(F.col("judgement").isin(*wanted))
    best = detections.filter(valid_confidence() & F.col("label_raw").isNotNull()).join(rows.select(*FRAME).distinct(), FRAME, "left_semi")
    first = rank_by(best, FRAME, [F.col("confidence").desc(), F.col("label_raw"), F.col("detection_id")], "object_rank", top).select(*FRAME, "object_rank", F.col("label_raw").alias("label"), "confidence")
    return rows.join(first, FRAME, "left").select("query_id", "rank", "judgement", *FRAME, "object_rank", "label", "confidence")


def trigger_reasons(scores: Column, linkages: Column, confidences: Column, out_of_domain: Column, *, margin: float = 0.05, linkage: float = 0.4, confidence: float = 0.7, top: int = 3) -> Column:
    """Why a request's chains deserve a closer look, as an array: scores and linkages are arrays in rank order."""
    known = F.filter(F.slice(scores, 1, 2), lambda s: s.isNotNull())
    close = (F.size(known) == 2) & (F.get(known, F.lit(0)) - F.get(known, F.lit(1)) <= margin)
    weak = F.exists(F.slice(linkages, 1, top), lambda x: F.coalesce(x < linkage, F.lit(False)))
    unsure = F.exists(confidences, lambda x: F.coalesce(x < confidence, F.lit(False)))
    named = [("SMALL_TOP1_TOP2_MARGIN", close), ("LOW_LINKAGE", weak), ("LOW_EVENT_CONFIDENCE", unsure), ("OOD_EVENT", out_of_domain)]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in named]))


def safe_chains(chains: DataFrame, steps: DataFrame, required: Sequence[str], top: int = 3) -> DataFrame:
    """Steps of the first `top` chains (request_id, chain_id, rank) of each request that may be shown: in one video, strictly forward
    in time, with all required events. steps: request_id, chain_id, event_id, event_order, video_id, t (null where an event was left out)."""
    first = rank_by(chains, ["request_id"], [F.col("rank"), F.col("chain_id")], "__n", top).select("request_id", "chain_id", F.col("rank").alias("chain_rank"))
    filled = steps.filter(F.col("t").isNotNull())
    w = Window.partitionBy("request_id", "chain_id").orderBy("event_order")
    d = filled.withColumn("__back", F.coalesce(F.col("t") <= F.lag("t").over(w), F.lit(False)))
    need = F.array(*[F.lit(e) for e in required]) if required else F.array().cast("array<string>")
    ok = d.groupBy("request_id", "chain_id").agg((F.count_distinct("video_id") == 1).alias("one"), F.bool_or("__back").alias("back"), (F.size(F.array_except(need, F.collect_set("event_id"))) == 0).alias("whole"))
    good = ok.filter("one AND NOT back AND whole").select("request_id", "chain_id")
    return filled.join(first, ["request_id", "chain_id"]).join(good, ["request_id", "chain_id"], "left_semi").select("request_id", "chain_rank", "chain_id", "event_order", "event_id", "video_id", "t")


def export_candidates(exports: DataFrame) -> DataFrame:
    """Confirmed answers as submission candidates: ids and answer as strings, the latest review of each query and frame, and what
    was known about it merged into one map (the export's own entries win over the review's)."""
    d = exports.withColumn("metadata", F.map_filter("metadata", lambda k, v: v.isNotNull()))
    own = F.create_map(F.lit("export_id"), F.col("export_id").cast("string"), F.lit("question"), F.col("question").cast("string"))
    merged = F.map_concat(F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(F.coalesce("metadata", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))), k)), F.coalesce("metadata", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    latest = rank_by(d, ["query_id", "video_id", "frame_id"], [F.col("exported_at").desc_nulls_last(), F.col("export_id").desc()], "__n", 1)
    return latest.select(F.col("query_id").cast("string").alias("query_id"), "video_id", F.col("frame_id").cast("long").alias("frame_id"), F.col("answer").cast("string").alias("answer"), F.lit("qa_confirmed_export").alias("source"), merged.alias("metadata"))


def clean_payload(values: Column, allowed: Sequence[str] = METADATA_FIELDS) -> Column:
    """Of a map<string, string> the allowed entries that hold something: not null, not empty, not an empty list."""
    names = F.array(*[F.lit(a) for a in allowed])
    return F.map_filter(values, lambda k, v: F.array_contains(names, k) & v.isNotNull() & ~v.isin("", "[]"))
