"""Validation and audits: rules become issue rows or counts in one pass over the table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidsift.functions.text import VIDEO_ID_PATTERN

Rule = tuple[str, str, Column]


def issues(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """keys, code, severity: a row for each rule (code, severity, condition) that a row breaks; unknown conditions break none."""
    each = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, sev, cond in rules]))
    return df.select(*keys, F.explode(each).alias("i")).select(*keys, "i.code", "i.severity")


def asset_rules(dims: int = 512, dtype: str = "float16") -> list[Rule]:
    c = F.col
    missing = [(f"missing_{n}", "ERROR", c(n).isNull()) for n in ("clip_feature_path", "mapping_path", "media_info_path", "object_path")]
    has = c("has_keyframe_images")
    return [
        *missing,
        ("feature_mapping_row_mismatch", "ERROR", c("feature_rows") != c("mapping_rows")),
        ("unexpected_feature_dim", "ERROR", c("feature_dim") != dims),
        ("unexpected_feature_dtype", "WARNING", c("feature_dtype") != dtype),
        ("mapping_keyframe_count_mismatch", "ERROR", has & ~c("mapping_rows").eqNullSafe(c("keyframe_image_count"))),
        ("missing_keyframe_images", "WARNING", ~has),
    ]


def coverage(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per group the rows and, for each column, how many hold a value (not null, not empty)."""
    held = lambda n: F.col(n).isNotNull() & (F.col(n).cast("string") != "")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(held(n)).alias(f"has_{n}") for n in columns])


def repeats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, and the difference."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_keys"), (F.sum("n") - F.count(F.lit(1))).alias("repeated"))


def severity(status: Column) -> Column:
    """INVALID > MISSING > WARNING > OK as numbers, so that max() rolls them up."""
    return F.when(status == "INVALID", 3).when(status == "MISSING", 2).when(status == "WARNING", 1).otherwise(0)


def roll_up(df: DataFrame, by: Sequence[str], status: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("OK", "WARNING", "MISSING", "INVALID")])
    return df.groupBy(*by).agg(F.element_at(names, F.max(severity(F.col(status))) + 1).alias("status"), F.count(F.lit(1)).alias("checks"))


def bucketed(distance: Column, edges: Sequence[float] = (0.25, 0.5, 1, 2, 3, 5)) -> Column:
    out: Column | None = None
    for e in edges:
        out = F.when(distance <= e, F.lit(f"<={e:g}")) if out is None else out.when(distance <= e, F.lit(f"<={e:g}"))
    return F.when(distance.isNull(), F.lit("unmapped")).otherwise(out.otherwise(F.lit(f">{edges[-1]:g}")))


def expected_minimum(counts: Mapping[str, int], found: Mapping[str, int]) -> dict[str, str]:
    """OK where a count reaches what is expected, MISSING where it is 0, else WARNING."""
    return {k: "OK" if found.get(k, 0) >= v else "MISSING" if not found.get(k) else "WARNING" for k, v in counts.items()}


def minimum_status(counts: DataFrame) -> DataFrame:
    """counts (name, found, expected) with status: OK where a count reaches what is expected, MISSING where it is 0, else WARNING."""
    f = F.coalesce("found", F.lit(0))
    return counts.withColumn("status", F.when(f >= F.col("expected"), "OK").when(f == 0, "MISSING").otherwise("WARNING"))


QUESTION_TYPES = ("ocr", "asr", "metadata", "object", "attribute_color", "count", "temporal", "visual")
MODALITIES = ("keyframe", "ocr", "asr", "metadata", "object", "attribute", "temporal")


def annotation_rules(longest_answer: int = 100) -> list[Rule]:
    """Rules of labelled questions (query_id, query_text, question_type, expected_videos, expected_answers, modalities, time_ranges,
    annotator, annotated_at, answerable); ranges are arrays of structs (start, end)."""
    c = F.col
    empty = lambda x: F.coalesce(F.size(x), F.lit(0)) <= 0
    answerable = F.coalesce(c("answerable"), F.lit(True))
    blank = lambda x: F.coalesce(F.trim(c(x)), F.lit("")) == ""
    return [
        ("QUERY_ID_REQUIRED", "ERROR", blank("query_id")),
        ("QUERY_TEXT_REQUIRED", "ERROR", blank("query_text")),
        ("UNSUPPORTED_QUESTION_TYPE", "ERROR", ~F.coalesce(c("question_type").isin(*QUESTION_TYPES), F.lit(False))),
        ("EXPECTED_VIDEO_REQUIRED", "ERROR", answerable & empty("expected_videos")),
        ("INVALID_VIDEO_ID", "ERROR", F.exists("expected_videos", lambda v: ~F.coalesce(v.rlike(VIDEO_ID_PATTERN), F.lit(False)))),
        ("EXPECTED_ANSWER_REQUIRED", "ERROR", answerable & empty(F.filter("expected_answers", lambda a: F.trim(a) != ""))),
        ("ANSWER_TOO_LONG", "ERROR", F.exists("expected_answers", lambda a: F.length(F.trim(a)) > longest_answer)),
        ("KEYFRAME_EVIDENCE_REQUIRED", "ERROR", answerable & ~F.coalesce(F.array_contains("modalities", "keyframe"), F.lit(False))),
        ("UNSUPPORTED_MODALITY", "ERROR", F.size(F.array_except("modalities", F.array(*[F.lit(m) for m in MODALITIES]))) > 0),
        ("INVALID_RANGE", "ERROR", F.exists("time_ranges", lambda r: ~F.coalesce((r["start"] >= 0) & (r["end"] >= r["start"]), F.lit(False)))),
        ("RANGE_REQUIRED", "ERROR", answerable & empty("time_ranges")),
        ("ANNOTATOR_REQUIRED", "ERROR", blank("annotator") | c("annotated_at").isNull()),
    ]


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def staleness(stated: DataFrame, found: DataFrame, keys: Sequence[str], fingerprint: str) -> DataFrame:
    """keys, status of each artifact a manifest states or that exists: READY where the fingerprints agree, STALE where they differ,
    MISSING where it doesn't exist, UNLISTED where no manifest states it."""
    a = stated.select(*keys, F.col(fingerprint).alias("__stated"), F.lit(True).alias("__a"))
    b = found.select(*keys, F.col(fingerprint).alias("__found"), F.lit(True).alias("__b"))
    j = a.join(b, list(keys), "full")
    status = F.when(F.col("__a").isNull(), "UNLISTED").when(F.col("__b").isNull(), "MISSING").when(F.col("__stated").eqNullSafe(F.col("__found")), "READY").otherwise("STALE")
    return j.select(*keys, status.alias("status"))


def store_audit(df: DataFrame, time: str, confidence: str, text: str) -> DataFrame:
    """One row of an evidence table's health: rows, videos, rows without a frame, without text, with a confidence out of range, before zero."""
    c = F.col
    bad = c(confidence).isNull() | F.isnan(confidence) | ~c(confidence).between(0.0, 1.0)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("video_id").alias("videos"), F.count_if(c("keyframe_id").isNull()).alias("no_frame"), F.count_if(F.coalesce(F.trim(c(text)), F.lit("")) == "").alias("no_text"), F.count_if(bad).alias("bad_confidence"), F.count_if(c(time) < 0).alias("negative_time"))
