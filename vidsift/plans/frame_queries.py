"""Localisation, source-frame mapping, sampling grids and colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidsift.operators import colors, localise
from vidsift.plans.vector_queries import _FRAMES, frame_hits
from vidsift.registry import Registry
from vidsift.sources.tables import table

registry = Registry()


@registry(
    _FRAMES
    + """, k AS (SELECT video_id, keyframe_id, min(pts_time) AS t FROM keyframes WHERE pts_time IS NOT NULL GROUP BY ALL),
sd AS (SELECT DISTINCT query_id, hits.video_id, k.t FROM hits JOIN k USING (video_id, keyframe_id) WHERE rank <= 5),
c AS (SELECT DISTINCT sd.query_id, k.video_id, k.keyframe_id FROM sd JOIN k USING (video_id) WHERE abs(k.t - sd.t) <= 20),
m AS (SELECT c.query_id, c.video_id, c.keyframe_id, max(s.score) AS score FROM c JOIN s USING (query_id, video_id, keyframe_id) GROUP BY ALL)
SELECT query_id, video_id, keyframe_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id, video_id ORDER BY round(score, 9) DESC, keyframe_id) AS rank FROM m"""
)
def frame_localisation(spark: SparkSession, sf: str) -> DataFrame:
    """Frames within 20 seconds of the five best hits of each query, by similarity."""
    from vidsift.functions.vectors import usable

    k = table(spark, sf, "keyframes").filter("pts_time IS NOT NULL").groupBy("video_id", "keyframe_id").agg(F.min("pts_time").alias("t"))
    f = table(spark, sf, "clip_features").filter(usable(F.col("clip_feature"), 128))
    seeds = frame_hits(spark, sf, 5).join(k, ["video_id", "keyframe_id"])
    frames = f.join(k, ["video_id", "keyframe_id"]).select("video_id", "keyframe_id", "t", F.col("clip_feature").alias("vector"))
    queries = f.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("clip_feature").alias("query_vector"))
    out = localise.localised(seeds, frames, queries, 20.0)
    return out.select("query_id", "video_id", "keyframe_id", F.round("score", 6).alias("score"), "rank")


@registry("""WITH k AS (SELECT * FROM keyframes WHERE pts_time IS NOT NULL AND keyframe_id IS NOT NULL), r AS (SELECT video_id, max(fps) AS fps FROM k WHERE fps > 0 GROUP BY 1),
a AS (SELECT ocr_id, 'time' AS how, k.keyframe_id, abs(k.pts_time - o.source_pts_time) AS d FROM ocr o JOIN k ON o.video_id = k.video_id AND abs(k.pts_time - o.source_pts_time) <= 5
  UNION ALL SELECT ocr_id, 'frame', k.keyframe_id, abs(k.frame_idx / r.fps - o.source_frame_idx / r.fps) FROM ocr o JOIN r ON o.video_id = r.video_id JOIN k ON o.video_id = k.video_id
    WHERE o.source_pts_time IS NULL AND o.source_frame_idx IS NOT NULL AND abs(k.frame_idx / r.fps - o.source_frame_idx / r.fps) <= 5)
SELECT ocr_id, keyframe_id, round(d, 6) AS distance, how FROM a QUALIFY row_number() OVER (PARTITION BY ocr_id ORDER BY round(d, 9), keyframe_id) = 1""")
def source_frame_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Every text's source position to the nearest stored frame, by time, else by frame number."""
    o = table(spark, sf, "ocr").select(F.col("ocr_id").alias("id"), "video_id", F.col("source_pts_time").alias("seconds"), F.col("source_frame_idx").alias("frame"))
    m = localise.map_source_frames(o, table(spark, sf, "keyframes"))
    return m.select(F.col("id").alias("ocr_id"), F.col("keyframe_id").cast("int").alias("keyframe_id"), F.round("distance_seconds", 6).alias("distance"), F.col("by").alias("how"))


@registry("""SELECT asr_id, len(g) AS times, round(list_sum(g), 4) AS total, list_last(g) AS last FROM (
  SELECT asr_id, list_transform(range(0, least(16, floor((greatest(end_time, greatest(start_time, 0)) - greatest(start_time, 0)) * 2)::INT + 1)), lambda i: round(greatest(start_time, 0) + i / 2.0, 6)) AS g FROM asr WHERE start_time IS NOT NULL AND end_time IS NOT NULL)""")
def sampling_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Two frames a second of each segment, sixteen at most: the decoder's list of times."""
    g = localise.sampling_times(F.col("start_time"), F.col("end_time"), 2.0, 16)
    a = table(spark, sf, "asr").filter("start_time IS NOT NULL AND end_time IS NOT NULL").withColumn("g", g)
    return a.select("asr_id", F.size("g").cast("long").alias("times"), F.round(F.aggregate("g", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.element_at("g", -1).alias("last"))


_PIXELS = "SELECT video_id, keyframe_id, floor(least(greatest(center_x, 0), 1) * 255) AS red, floor(least(greatest(center_y, 0), 1) * 255) AS green, floor(least(greatest(bbox_y1, 0), 1) * 255) AS blue FROM detections"


@registry(f"""WITH p AS ({_PIXELS}), r AS (SELECT video_id, keyframe_id, avg((red > 95 AND red > green * 1.35 AND red > blue * 1.35)::INT) AS ratio FROM p GROUP BY ALL)
SELECT video_id, keyframe_id, round(ratio, 6) AS color_ratio, round(least(1, ratio / 0.04), 6) AS attribute_score, row_number() OVER (ORDER BY round(least(1, ratio / 0.04), 9) DESC, round(ratio, 9) DESC, video_id, keyframe_id) AS rank FROM r WHERE ratio >= 0.04""")
def color_search(spark: SparkSession, sf: str) -> DataFrame:
    """Colour shares per frame; box positions stand for pixels, as the tables hold no images."""
    c = lambda n: F.floor(F.least(F.greatest(F.col(n), F.lit(0.0)), F.lit(1.0)) * 255)
    p = table(spark, sf, "detections").select("video_id", "keyframe_id", c("center_x").alias("red"), c("center_y").alias("green"), c("bbox_y1").alias("blue"))
    out = colors.color_search(p, ["video_id", "keyframe_id"], "red")
    return out.select("video_id", "keyframe_id", F.round("color_ratio", 6).alias("color_ratio"), F.round("attribute_score", 6).alias("attribute_score"), "rank")
