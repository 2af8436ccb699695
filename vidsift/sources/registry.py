"""The asset registry from a folder tree, judgement and benchmark files, and validating scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidsift.sources.readers import _id_of

#: Folder, column and whether the id is a folder of files.
TREES = (("clip-features", "clip_feature_path", False), ("map-keyframes", "mapping_path", False), ("media-info", "media_info_path", False), ("objects", "object_path", True), ("keyframes", "keyframe_path", True), ("video", "video_path", False))


def scan_assets(spark: SparkSession, root: str) -> DataFrame:
    """One row per video id of any tree: its paths (null where a tree lacks it), file counts, size. Listed, not read: only names and lengths are selected."""
    parts = []
    for folder, column, nested in TREES:
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/{folder}").select("path", "length")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        key = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1) if nested else _id_of(F.col("path"))
        where = F.regexp_extract("path", r"^(.*)/[^/]+$", 1) if nested else F.col("path")
        parts.append(files.groupBy(key.alias("video_id")).agg(F.min(where).alias("path"), F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")).withColumn("kind", F.lit(column)))
    if not parts:
        raise FileNotFoundError(f"{root} holds none of {', '.join(f for f, _, _ in TREES)}")
    every = reduce(DataFrame.unionByName, parts)
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return every.groupBy("video_id").agg(
        *[pick(c, "path").alias(c) for _, c, _ in TREES], pick("keyframe_path", "files").alias("keyframe_image_count"), pick("object_path", "files").alias("object_file_count"), pick("video_path", "bytes").alias("video_file_size_bytes")
    ).withColumn("video_group", F.split_part("video_id", F.lit("_"), F.lit(1)))


def features_with_frames(vectors: DataFrame, mapping: DataFrame) -> DataFrame:
    """Vectors joined with the mapping on row position; videos whose row counts differ are left out, as their rows can't be trusted."""
    n = lambda d, c: d.groupBy("video_id").agg(F.count(F.lit(1)).alias(c))
    even = n(vectors, "a").join(n(mapping, "b"), "video_id").filter("a = b").select("video_id")
    rows = mapping.withColumn("feature_row", F.col("n") - 1)
    return vectors.join(even, "video_id", "left_semi").join(rows, ["video_id", "feature_row"])


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed results; an empty judgement is not judged."""
    d = spark.read.csv(path, header=True, schema="query_id string, query_text string, rank int, video_id string, keyframe_id int, manual_judgement string", encoding="UTF-8")
    return d.withColumn("manual_judgement", F.nullif(F.trim(F.lower("manual_judgement")), F.lit("")))


def benchmark_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query_text, expected_video_ids of a query file, under any of the names in use; repeated ids are an error."""
    raw = spark.read.json(path, multiLine=True)
    col = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in raw.columns], F.lit(None))
    ids = F.col("expected_video_ids") if "expected_video_ids" in raw.columns else F.lit(None).cast("array<string>")
    d = raw.select(col("query_id", "id").alias("query_id"), col("query_text", "query", "text").alias("query_text"), ids.alias("expected_video_ids"))
    again = d.groupBy("query_id").count().filter("count > 1").count()
    if again:
        raise ValueError(f"{again} query ids occur more than once")
    return d


def checked_corpus(spark: SparkSession, path: str, required: tuple[str, ...] = ("document_id", "source_type", "video_id", "text")) -> DataFrame:
    """A JSON-lines corpus whose required fields are filled and whose ids are unique; otherwise an error that counts what is wrong."""
    d = spark.read.json(path)
    empty = [c for c in required if c not in d.columns]
    if empty:
        raise ValueError(f"fields are missing: {empty}")
    got = d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("document_id").alias("ids"), *[F.count_if(F.coalesce(F.col(c), F.lit("")) == "").alias(c) for c in required]).first()
    bad = {c: got[c] for c in required if got[c]} | ({"repeated": got["n"] - got["ids"]} if got["n"] > got["ids"] else {})
    if bad:
        raise ValueError(f"the corpus isn't valid: {bad}")
    return d


def official_rows(spark: SparkSession, path: str, task: str, events: int = 1) -> DataFrame:
    """Rows of a submission file with what is wrong with each: wrong number of columns, or frames that aren't digits."""
    want = 1 + events + (task == "QA")
    d = spark.read.text(path).filter("value <> ''").withColumn("c", F.split("value", r', (?=(?:[^"]*"[^"]*")*[^"]*$)'))
    frames = F.slice("c", 2, events)
    wrong = F.when(F.size("c") != want, "INVALID_COLUMN_COUNT").when(~F.forall(frames, lambda f: f.rlike(r"^\d+$")), "INVALID_FRAME_ID")
    answer = F.regexp_replace(F.regexp_replace(F.element_at("c", -1), '^"|"$', ""), '""', '"') if task == "QA" else F.lit(None).cast("string")
    return d.select(F.col("c")[0].alias("video_id"), F.array_join(frames, ",").alias("frames"), answer.alias("answer"), wrong.alias("issue"))
