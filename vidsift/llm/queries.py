"""The queries of the training-data operators and the SQL that some are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidsift.llm import bpe, event_runs, group_top, leakage, mojibake, time_match, vector_neighbours, visual_forms
from vidsift.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return visual_forms.lookalike_pairs(table(spark, sf, "documents"), doc_id="doc_id", text="text")


def p1_forms(spark: SparkSession, sf: str) -> DataFrame:
    return visual_forms.consistent_texts(table(spark, sf, "documents"), doc_id="doc_id", text="text")


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    return visual_forms.lookalike_classes(table(spark, sf, "documents"), doc_id="doc_id", text="text")


def _nearest(spark: SparkSession, sf: str) -> DataFrame:
    return vector_neighbours.nearest_vectors(table(spark, sf, "clip_features"), vec_id="vec_id", vector="clip_feature")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return vector_neighbours.neighbour_pairs(_nearest(spark, sf), "vec_id")


def p2_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf)


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return event_runs.collapse_runs(table(spark, sf, "ocr"), entity="video_id", event_id="ocr_id", position="keyframe_id", time="pts_time", text="text_normalized")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf).filter("n_events >= 2").select("video_id", F.col("first_id").alias("first_ocr_id"), F.col("last_id").alias("last_ocr_id"))


def p3_events(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf).withColumn("duration_seconds", F.round("duration_seconds", 6))


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    frames = table(spark, sf, "keyframes")
    near = lambda records, rid, time: time_match.nearest_in_time(records, frames, entity="video_id", record_id=rid, record_time=time, ref_id="keyframe_id", ref_time="pts_time")
    kind = lambda df, name, rid: df.select(F.lit(name).alias("source_kind"), F.col(rid).alias("record_id"), F.col("keyframe_id").cast("int").alias("keyframe_id"), "pts_time", "distance_seconds")
    asr = kind(near(table(spark, sf, "asr"), "asr_id", "start_time"), "asr", "asr_id")
    lost = table(spark, sf, "ocr").filter(F.col("keyframe_id").isNull())
    return asr.unionByName(kind(near(lost, "ocr_id", "source_pts_time"), "ocr", "ocr_id"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf).select("source_kind", "record_id", "keyframe_id")


def p4_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf).withColumn("distance_seconds", F.round("distance_seconds", 6))


def _best_detections(spark: SparkSession, sf: str) -> DataFrame:
    return group_top.top_n_per_group(
        table(spark, sf, "detections"),
        group=["video_id", "keyframe_id"],
        score="confidence",
        label="label_normalized",
        row_id="detection_id",
        same=["bbox_y1", "bbox_x1", "bbox_y2", "bbox_x2"],
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _best_detections(spark, sf).select("detection_id")


def p5_top_detections(spark: SparkSession, sf: str) -> DataFrame:
    return _best_detections(spark, sf)


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf, "documents"), doc_id="doc_id", text="text")


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_passages(
        table(spark, sf, "documents"), table(spark, sf, "eval_items"), doc_id="doc_id", text="text", item_id="item_id", item_text="query_text"
    )


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.garbled(table(spark, sf, "documents"), doc_id="doc_id", text="text")


def p8_restored(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.restored(table(spark, sf, "documents"), doc_id="doc_id", text="text")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_forms, p1_classes, p2_found, p2_neighbours, p3_found, p3_events, p4_found, p4_mapping, p5_found, p5_top_detections, p6_ids, p7_found, p7_leaks, p8_found, p8_restored)}


_P4 = """
WITH frames AS (SELECT DISTINCT video_id, keyframe_id, pts_time FROM keyframes WHERE pts_time IS NOT NULL),
records AS (
  SELECT 'asr' AS source_kind, asr_id AS record_id, video_id, start_time AS t FROM asr WHERE start_time IS NOT NULL
  UNION ALL
  SELECT 'ocr', ocr_id, video_id, source_pts_time FROM ocr WHERE keyframe_id IS NULL AND source_pts_time IS NOT NULL),
near AS (
  SELECT source_kind, record_id, keyframe_id, pts_time, abs(pts_time - t) AS d,
         row_number() OVER (PARTITION BY source_kind, record_id ORDER BY abs(pts_time - t), keyframe_id) AS k
  FROM records JOIN frames USING (video_id) WHERE abs(pts_time - t) <= 3.0)
"""

_P5 = """
WITH valid AS (
  SELECT * FROM detections WHERE confidence IS NOT NULL AND NOT isnan(confidence) AND confidence BETWEEN 0 AND 1),
once AS (
  SELECT *, row_number() OVER (
    PARTITION BY video_id, keyframe_id, label_normalized, confidence, bbox_y1, bbox_x1, bbox_y2, bbox_x2,
                 CASE WHEN label_normalized IS NULL THEN detection_id END
    ORDER BY detection_id) AS copy FROM valid),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY video_id, keyframe_id
    ORDER BY confidence DESC, label_normalized ASC NULLS LAST, detection_id) AS result_rank
  FROM once WHERE copy = 1)
"""


_P1 = f"""
WITH f AS (SELECT doc_id, text, {visual_forms.form_sql('text')} AS f FROM documents WHERE regexp_matches(text, '[^\\s\\p{{Z}}]')),
looks AS (SELECT * FROM f WHERE regexp_matches(f, '[^\\s]'))
"""

_P3 = """
WITH ok AS (SELECT video_id, keyframe_id, ocr_id, pts_time, text_normalized AS t FROM ocr WHERE keyframe_id IS NOT NULL AND regexp_matches(text_normalized, '[^\\s\\p{Z}]')),
once AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY video_id, keyframe_id ORDER BY ocr_id) = 1),
keyed AS (SELECT *, regexp_replace(replace(strip_accents(lower(t)), 'đ', 'd'), '[^\\p{L}\\p{N}]', '', 'g') AS k FROM once),
pairs AS (SELECT *, lag(k) OVER w AS b, row_number() OVER w AS n FROM keyed WINDOW w AS (PARTITION BY video_id ORDER BY pts_time NULLS LAST, keyframe_id)),
marked AS (SELECT *, CASE WHEN b IS NULL OR levenshtein(k, b) * 1000 > 150 * greatest(length(k), length(b)) THEN 1 ELSE 0 END AS fresh FROM pairs),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY n) AS run FROM marked),
ends AS (SELECT video_id, run, arg_min(ocr_id, n) AS first_ocr_id, arg_max(ocr_id, n) AS last_ocr_id, count(*) AS n_events, min_by({'t': pts_time}, n).t AS first_time, max_by({'t': pts_time}, n).t AS last_time FROM runs GROUP BY ALL)
"""


def _passages(key: str, column: str, source: str, once: bool = True) -> str:
    words = f"string_split({visual_forms.folded_sql(visual_forms.form_sql(column, other_scripts=False))}, ' ')"
    return f"""(SELECT {'DISTINCT' if once else ''} {key}, array_to_string(w[i:i + 9], ' ') AS p FROM (
  SELECT {key}, w, unnest(generate_series(1, len(w) - 9)) AS i FROM (SELECT {key}, {words} AS w FROM {source} WHERE {column} IS NOT NULL) WHERE len(w) >= 10))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + "SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM looks a JOIN looks b ON a.f = b.f AND a.doc_id < b.doc_id AND a.text <> b.text",
        "p1_classes": _P1
        + """, n AS (SELECT *, md5(f) AS class_id, count(*) OVER (PARTITION BY f) AS documents, count(*) OVER (PARTITION BY f, text) AS same FROM looks),
s AS (SELECT class_id, count(DISTINCT text) AS spellings FROM n GROUP BY 1)
SELECT doc_id, class_id, spellings, documents - same AS links FROM n JOIN s USING (class_id) WHERE spellings > 1""",
        "p3_found": _P3 + "SELECT video_id, first_ocr_id, last_ocr_id FROM ends WHERE n_events >= 2",
        "p7_found": f"SELECT DISTINCT doc_id, item_id FROM {_passages('doc_id', 'text', 'documents')} JOIN {_passages('item_id', 'query_text', 'eval_items')} USING (p)",
        "p3_events": _P3 + "SELECT video_id, first_ocr_id AS first_id, last_ocr_id AS last_id, n_events, first_time, last_time, round(last_time - first_time, 6) AS duration_seconds FROM ends",
        "p7_leaks": f"SELECT doc_id, item_id, count(*) AS windows FROM {_passages('doc_id', 'text', 'documents', once=False)} JOIN {_passages('item_id', 'query_text', 'eval_items')} USING (p) GROUP BY ALL",
        "p4_found": _P4 + "SELECT source_kind, record_id, keyframe_id FROM near WHERE k = 1",
        "p4_mapping": _P4 + "SELECT source_kind, record_id, keyframe_id, pts_time, round(d, 6) AS distance_seconds FROM near WHERE k = 1",
        "p5_found": _P5 + "SELECT detection_id FROM ranked WHERE result_rank <= 5",
        "p5_top_detections": _P5
        + "SELECT video_id, keyframe_id, detection_id, label_normalized, confidence, CAST(result_rank AS INTEGER) AS result_rank FROM ranked WHERE result_rank <= 5",
    }
