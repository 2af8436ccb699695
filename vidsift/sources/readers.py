"""Readers of the evidence files: explicit schemas, malformed rows counted and kept apart, paths giving the ids."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidsift.functions.text import normalize, picked_confidence
from vidsift.functions.vectors import valid_box

MAPPING = "n int, pts_time double, fps double, frame_idx long"
MEDIA_INFO = "title string, author string, publish_date string, keywords array<string>, description string, watch_url string, channel_id string, length double"
OBJECTS = "detection_class_labels array<string>, detection_class_entities array<string>, detection_scores array<double>, detection_boxes array<array<double>>"
OCR_LINES = "video_id string, keyframe_id int, frame_idx long, pts_time double, detections array<struct<text string, confidence double, bbox array<array<double>>>>"
ASR_LINES = "video_id string, status string, duration double, segments array<struct<id int, start double, end double, text string, confidence double>>"


#: More than any header of a matrix takes.
HEADER_BYTES = 4_096
#: A stored polygon where none is given: the whole image.
WHOLE_IMAGE = "[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,1.0]]"
CONSOLIDATED = (
    "schema_version string, collection_id string, video_id string, keyframe_id string, timestamp_ms double, frame_number long, status string, image struct<width double, height double>, "
    "retrieval_text string, processing_config_sha256 string, "
    "retrieval_detections array<struct<text string, score double, recognizer_confidence double, detector_confidence double, bbox array<double>, polygon array<array<double>>>>"
)


def _id_of(path):
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)


def mapping_csv(spark: SparkSession, path: str) -> DataFrame:
    """video_id (from the file name), n, pts_time, fps, frame_idx; rows that don't parse have is_valid false."""
    raw = spark.read.csv(path, header=True, schema="n string, pts_time string, fps string, frame_idx string")
    typed = raw.select(_id_of(F.input_file_name()).alias("video_id"), *[F.expr(f"try_cast({c} AS {t})").alias(c) for c, t in (x.split() for x in MAPPING.split(", "))])
    return typed.withColumn("is_valid", F.col("n").isNotNull() & F.col("pts_time").isNotNull() & F.col("fps").isNotNull() & F.col("frame_idx").isNotNull())


def media_info(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file; video_id and group come from its name."""
    d = spark.read.schema(MEDIA_INFO).json(path, multiLine=True, recursiveFileLookup=True)
    d = d.withColumn("video_id", _id_of(F.input_file_name()))
    return d.withColumn("video_group", F.split_part("video_id", F.lit("_"), F.lit(1)))


def object_files(spark: SparkSession, path: str) -> DataFrame:
    """Detections of one JSON per frame (.../video_id/NNN.json): parallel arrays become rows; a file whose arrays differ in length, or with a
    value out of bounds, gives one row with object_status UNKNOWN and no detection."""
    d = spark.read.schema(OBJECTS).json(path, multiLine=True, recursiveFileLookup=True).withColumn("p", F.input_file_name())
    d = d.select(F.regexp_extract("p", r"([^/]+)/[^/]+$", 1).alias("video_id"), F.regexp_extract("p", r"(\d+)\.json$", 1).cast("int").alias("keyframe_id"), "*")
    n = F.size("detection_scores")
    names = [x.split()[0] for x in OBJECTS.split(", ")]
    even = F.coalesce((n >= 0) & (F.size(names[0]) == n) & (F.size(names[1]) == n) & (F.size(names[3]) == n), F.lit(False))
    zipped = F.arrays_zip(*names)
    inside = F.forall(zipped, lambda x: x["detection_scores"].between(0, 1) & valid_box(*[x["detection_boxes"][i] for i in range(4)]))
    d = d.withColumn("ok", even & F.coalesce(inside, F.lit(False)))
    rows = d.select("video_id", "keyframe_id", F.when(F.col("ok"), "AVAILABLE").otherwise("UNKNOWN").alias("object_status"), F.explode_outer(F.when(F.col("ok"), zipped)).alias("x"))
    return rows.select("video_id", "keyframe_id", "object_status", F.col("x.detection_class_labels").alias("label_id"), F.col("x.detection_class_entities").alias("label_raw"), F.col("x.detection_scores").alias("confidence"), *[F.col("x.detection_boxes")[i].alias(f"bbox_{c}") for i, c in enumerate(("y1", "x1", "y2", "x2"))])


def ocr_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Detections of OCR frames, and the lines that don't parse."""
    d = spark.read.schema(OCR_LINES + ", _corrupt_record string").json(path, mode="PERMISSIVE")
    bad = d.filter(F.col("_corrupt_record").isNotNull() | F.col("video_id").isNull()).select(F.col("_corrupt_record").alias("line"))
    good = d.filter(F.col("_corrupt_record").isNull() & F.col("video_id").isNotNull())
    rows = good.select("video_id", "keyframe_id", "frame_idx", "pts_time", F.explode("detections").alias("x"))
    return rows.select("video_id", "keyframe_id", "frame_idx", "pts_time", F.col("x.text").alias("text_raw"), "x.confidence", F.to_json("x.bbox").alias("bbox_json")), bad


def asr_lines(spark: SparkSession, path: str) -> DataFrame:
    """Segments of available transcripts."""
    d = spark.read.schema(ASR_LINES).json(path).filter("status = 'AVAILABLE'")
    return d.select("video_id", F.explode("segments").alias("x")).select("video_id", F.col("x.id").alias("segment_id"), F.col("x.start").alias("start_time"), F.col("x.end").alias("end_time"), F.col("x.text").alias("text_raw"), "x.confidence")


def npy_headers(spark: SparkSession, path: str) -> DataFrame:
    """video_id, rows, dims, dtype of the matrices in .npy files, from their first bytes: the values aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path).select("path")

    def head(p: str) -> bytes:
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(p) if "://" in p or p.startswith("file:") else (fs.LocalFileSystem(), p)
        with where.open_input_file(name) as f:
            return f.read(HEADER_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.column(0).to_pylist():
                f = io.BytesIO(head(p))
                version = np.lib.format.read_magic(f)
                shape, _, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
                out.append((p, shape[0] if shape else 0, shape[1] if len(shape) > 1 else 1, str(dtype)))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], ["path", "rows", "dims", "dtype"])

    return files.mapInArrow(run, "path string, rows long, dims int, dtype string").select(_id_of(F.col("path")).alias("video_id"), "rows", "dims", "dtype")


def npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """video_id, feature_row, clip_feature of matrices in .npy files; one file is one task's input at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for video, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
                for a in range(0, len(m), 10_000):
                    part = m[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([video] * len(part)), pa.array(range(a, a + len(part)), pa.int32()), pa.array(list(part), pa.list_(pa.float32()))], ["video_id", "feature_row", "clip_feature"])

    return files.select(_id_of(F.col("path")).alias("video_id"), "content").mapInArrow(run, "video_id string, feature_row int, clip_feature array<float>")


def _polygon(points, bbox, width, height):
    """Four corners by the image's size, within 0..1, six decimals, as JSON; from the box where there's no polygon, else the whole image."""
    corner = lambda i, j: F.array(bbox[i], bbox[j])
    four = F.when(F.size(points) == 4, points).when(F.size(bbox) == 4, F.array(corner(0, 1), corner(2, 1), corner(2, 3), corner(0, 3)))
    inside = lambda x, size: F.round(F.least(F.greatest(x / size, F.lit(0.0)), F.lit(1.0)), 6)
    scaled = F.transform(four, lambda p: F.array(inside(p[0], width), inside(p[1], height)))
    whole = F.forall(four, lambda p: F.size(p) == 2) & (width > 0) & (height > 0)
    return F.when(F.coalesce(whole, F.lit(False)), F.to_json(scaled)).otherwise(F.lit(WHOLE_IMAGE))


def consolidated_ocr(spark: SparkSession, path: str, group: str) -> tuple[DataFrame, DataFrame]:
    """On-screen texts of consolidated OCR lines of one group, and how many lines were left out and why.

    Texts: video_id, source_keyframe_id, source_frame_idx (stated, else from the id), source_pts_time, source_status, text,
    confidence (score, else recogniser, else detector, else 1), bbox_json, run_id, is_reviewed. A reviewed text that differs
    from the detected ones together counts as a further text over the whole image. Texts that agree in letters and place count
    once a frame. Lines that don't parse, or whose group and video don't fit, are counted (reason, lines), not fatal.
    """
    raw = spark.read.schema(CONSOLIDATED + ", _corrupt_record string").json(path, mode="PERMISSIVE")
    c = F.col
    fits = F.coalesce((c("collection_id") == group) & c("video_id").startswith(f"{group}_") & c("keyframe_id").isNotNull(), F.lit(False))
    reason = F.when(c("_corrupt_record").isNotNull(), "NOT_PARSED").when(~fits, "IDENTITY_MISMATCH")
    d = raw.withColumn("reason", reason)
    left = d.filter(c("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))
    good = d.filter(c("reason").isNull())
    width, height = F.coalesce("image.width", F.lit(1280.0)), F.coalesce("image.height", F.lit(720.0))
    text = lambda x: F.trim(F.coalesce(x, F.lit("")))
    item = lambda t, conf, box, reviewed: F.struct(t.alias("text"), conf.alias("confidence"), box.alias("bbox_json"), F.lit(reviewed).alias("is_reviewed"))
    found = F.filter(F.coalesce("retrieval_detections", F.lit(None).cast(good.schema["retrieval_detections"].dataType)), lambda x: text(x["text"]) != "")
    own = F.coalesce(F.transform(found, lambda x: item(text(x["text"]), picked_confidence(x["score"], x["recognizer_confidence"], x["detector_confidence"]), _polygon(x["polygon"], x["bbox"], width, height), False)), F.array().cast("array<struct<text string, confidence double, bbox_json string, is_reviewed boolean>>"))
    detected = normalize(F.array_join(F.transform(own, lambda x: x["text"]), " "))
    reviewed = text(c("retrieval_text"))
    extra = F.when((reviewed != "") & (normalize(reviewed) != detected), F.array(item(reviewed, F.lit(1.0), F.lit(WHOLE_IMAGE), True)))
    rows = good.select(
        "video_id", c("keyframe_id").alias("source_keyframe_id"), F.coalesce("frame_number", F.expr(r"try_cast(nullif(regexp_extract(keyframe_id, '_F(\\d+)$', 1), '') AS BIGINT)")).alias("source_frame_idx"),
        (c("timestamp_ms") / 1000.0).alias("source_pts_time"), F.coalesce("status", F.lit("unknown")).alias("source_status"),
        F.concat_ws(":", F.coalesce("schema_version", F.lit("ocr-keyframe-v2")), F.substring(F.coalesce("processing_config_sha256", F.lit("unknown")), 1, 12)).alias("run_id"),
        F.posexplode(F.concat(own, F.coalesce(extra, F.array().cast("array<struct<text string, confidence double, bbox_json string, is_reviewed boolean>>")))).alias("at", "x"),
    )
    keys = ["video_id", "source_keyframe_id", "source_frame_idx", "source_pts_time", "source_status", "run_id"]
    once = rows.groupBy(*keys, normalize(c("x.text")).alias("__n"), c("x.bbox_json").alias("__b")).agg(F.min(F.struct("at", "x")).alias("m"))
    return once.select(*keys, "m.x.text", "m.x.confidence", "m.x.bbox_json", "m.x.is_reviewed"), left
