"""Answers from evidence, the guard before confirmation, and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidsift.operators.ranking import rank_by

NEEDS = {"ocr": "ocr", "asr": "asr", "metadata": "metadata", "object": "object", "attribute_color": "attribute"}


def first_answer(questions: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Per question (keys, question_type) the first evidence with text of the modality that its type needs, in evidence order; none: null."""
    need = F.create_map(*[F.lit(x) for kv in NEEDS.items() for x in kv])[F.col("question_type")]
    e = evidence.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")).withColumnRenamed("modality", "__m")
    j = questions.withColumn("__need", need).join(e, keys).filter(F.col("__need").isNull() | (F.col("__need") == F.col("__m")))
    one = rank_by(j, keys, [F.col("evidence_order"), F.col("evidence_id")], "__n", 1)
    return questions.join(one.select(*keys, F.trim("text").alias("answer"), "evidence_id"), keys, "left")


def guard(state: Column, answer: Column, selected: Column, used: Column, question_type: Column, selected_modalities: Column) -> Column:
    """Why an answer can't be confirmed, or `ok`; the first rule that is broken."""
    return (
        F.when(state.isin("NEEDS_EVIDENCE", "UNSUPPORTED"), "state")
        .when(F.coalesce(answer, F.lit("")) == "", "no_answer")
        .when(F.coalesce(F.size(selected), F.lit(0)) <= 0, "nothing_selected")
        .when(F.size(F.array_except(used, selected)) > 0, "evidence_not_selected")
        .when((question_type == "asr") & ~F.coalesce(F.array_contains(selected_modalities, "asr"), F.lit(False)), "speech_needs_asr")
        .otherwise("ok")
    )


def one_video(selection: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the selected evidence of each key exists and lies in one video."""
    return selection.groupBy(*keys).agg(((F.count_distinct("video_id") == 1) & (F.count_if(F.col("video_id").isNull()) == 0)).alias("one_video"))


def answer_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy of video and answer over judged questions, coverage over all; null where nothing is judged."""
    share = lambda hit, known: F.avg(F.when(known, hit.cast("double")))
    c = F.col
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("questions"),
        F.round(F.avg(c("answer").isNotNull().cast("double")), 6).alias("answered"),
        F.round(share(F.coalesce(c("video_id") == c("expected_video_id"), F.lit(False)), c("expected_video_id").isNotNull()), 6).alias("video_accuracy"),
        F.round(share(F.coalesce(c("answer") == c("expected_answer"), F.lit(False)), c("expected_answer").isNotNull()), 6).alias("answer_accuracy"),
    )
