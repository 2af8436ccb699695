"""Submission rows: validation codes, canonical lines, latest state of an append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidsift.functions.text import VIDEO_ID_PATTERN
from vidsift.operators.audit import issues

QUERY_ID_PATTERN = r"^query-\d+-(kis|qa|trake)$"
MAX_PREDICTIONS, MAX_ANSWER = 100, 100


def prediction_issues(p: DataFrame) -> DataFrame:
    """Issues of prediction rows: query_id, task, row_no, video_id, frame_ids (array<long>), answer, event_count."""
    c, n = F.col, F.size("frame_ids")
    query = Window.partitionBy("query_id")
    again = F.row_number().over(Window.partitionBy("query_id", "video_id", "frame_ids", "answer").orderBy("row_no")) > 1
    d = p.withColumns({"__again": again, "__count": F.count(F.lit(1)).over(query)})
    trake, qa = c("task") == "TRAKE", c("task") == "QA"
    falling = F.exists(F.zip_with(F.slice(c("frame_ids"), 1, F.greatest(n - 1, F.lit(0))), F.slice(c("frame_ids"), 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a >= b), lambda x: x)
    known = c("task").isin("KIS", "QA", "TRAKE")
    suffix = F.regexp_extract("query_id", QUERY_ID_PATTERN, 1)
    rules = [
        ("UNSUPPORTED_TASK", "ERROR", ~known),
        ("INVALID_QUERY_ID", "ERROR", known & (suffix != F.lower("task"))),
        ("INVALID_PREDICTION_COUNT", "ERROR", known & (c("__count") > MAX_PREDICTIONS)),
        ("INVALID_EVENT_COUNT", "ERROR", trake & (F.coalesce(c("event_count"), F.lit(0)) < 1)),
        ("INVALID_VIDEO_ID", "ERROR", known & ~c("video_id").rlike(VIDEO_ID_PATTERN)),
        ("INVALID_FRAME_ID", "ERROR", known & ((n == 0) | F.exists("frame_ids", lambda f: f.isNull() | (f < 0)))),
        ("INVALID_COLUMN_COUNT", "ERROR", (c("task").isin("KIS", "QA") & (n != 1)) | (trake & (n != c("event_count")))),
        ("FRAME_ORDER_FALLBACK", "WARNING", trake & falling),
        ("ANSWER_REQUIRED", "ERROR", qa & (F.coalesce(c("answer"), F.lit("")) == "")),
        ("ANSWER_TOO_LONG", "ERROR", qa & (F.length("answer") > MAX_ANSWER)),
        ("UNEXPECTED_ANSWER", "ERROR", known & ~qa & c("answer").isNotNull()),
        ("DUPLICATE_PREDICTION", "ERROR", known & c("__again")),
    ]
    return issues(d, ["query_id", "row_no"], rules)


def line(task: Column, video: Column, frames: Column, answer: Column) -> Column:
    """`video, frame[, frame...]`; with a quoted answer for QA."""
    plain = F.concat_ws(", ", video, F.array_join(F.transform(frames, lambda f: f.cast("string")), ", "))
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.coalesce(answer, F.lit("")), '"', '""'), F.lit('"'))
    return F.when(task == "QA", F.concat_ws(", ", video, F.element_at(frames, 1).cast("string"), quoted)).otherwise(plain)


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The current state of an append-only log: each key's last row."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return log.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
