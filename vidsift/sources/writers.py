"""Sinks: versioned publication with manifests, JSON lines, CSV lines, submissions, append-only logs."""

from __future__ import annotations

import json
import time
import uuid
import zipfile
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Queries times predictions of a submission.
MOST_SUBMISSION_LINES = 100_000


POINTER = "_CURRENT"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced as a whole: written beside it and renamed over it."""
    fs, at = _fs(spark, path)
    _, beside = _fs(spark, f"{path}.new")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    context.rename(fs.makeQualified(beside), fs.makeQualified(at), options)


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(df: DataFrame, target: str, valid: Callable[[DataFrame], bool], partition_by: list[str] | None = None, manifest: Mapping[str, object] | None = None) -> str:
    """A new version of a table: written to a folder of its own, validated, and then made current by replacing one small pointer file,
    so readers see the old version or the new one, never neither. A failed validation leaves the target as it was. With a
    `manifest`, it is written into the version's folder before that. Returns the version's folder; `published` reads the current one."""
    spark = df.sparkSession
    version = f"v-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
    folder = f"{target}/{version}"
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{folder}/data")
    if not valid(spark.read.parquet(f"{folder}/data")):
        fs, at = _fs(spark, folder)
        fs.delete(at, True)
        raise ValueError(f"what was staged for {target} isn't valid")
    if manifest is not None:
        _write_text(spark, f"{folder}/manifest.json", json.dumps(dict(manifest), sort_keys=True))
    _write_text(spark, f"{target}/{POINTER}", version)
    return folder


def published(spark: SparkSession, target: str) -> DataFrame:
    """The current version of a published table."""
    version = _read_text(spark, f"{target}/{POINTER}")
    if version is None:
        raise FileNotFoundError(f"nothing is published at {target}")
    return spark.read.parquet(f"{target}/{version}/data")


def manifest_issues(spark: SparkSession, target: str, expected: Mapping[str, object]) -> list[str]:
    """What is missing of a published table (pointer, data, manifest), and the keys of its manifest that differ from what is expected."""
    version = _read_text(spark, f"{target}/{POINTER}")
    if version is None:
        return [f"missing {POINTER}"]
    missing = []
    for name in ("data", "manifest.json"):
        fs, at = _fs(spark, f"{target}/{version}/{name}")
        if not fs.exists(at):
            missing.append(f"missing {name}")
    stated = {} if "missing manifest.json" in missing else json.loads(_read_text(spark, f"{target}/{version}/manifest.json") or "{}")
    return missing + [f"stale {k}" for k, v in sorted(expected.items()) if stated and stated.get(k) != v]


def resume(df: DataFrame, target: str, key: str) -> int:
    """Append the rows whose key the target doesn't hold yet; returns how many the target then holds."""
    spark = df.sparkSession
    fs, at = _fs(spark, target)
    if fs.exists(at):
        df = df.join(spark.read.parquet(target).select(key), key, "left_anti")
    df.write.mode("append").parquet(target)
    return spark.read.parquet(target).count()


def copied(spark: SparkSession, source: str, target: str, prefix: str, column: str = "video_id") -> None:
    """Rows of one store whose id begins with a prefix, into another; the filter reaches the scan."""
    spark.read.parquet(source).filter(F.col(column).startswith(prefix)).write.mode("append").parquet(target)


def zipped(lines: DataFrame, path: str) -> list[str]:
    """One entry `<query_id>.csv` for each query's lines (query_id, row_no, line) in a ZIP file; the entries' names. A submission:
    some hundred queries of a hundred lines at most, which is checked, so the driver writes it."""
    most = MOST_SUBMISSION_LINES
    rows = lines.orderBy("query_id", "row_no").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a submission has at most {most} lines")
    entries: dict[str, list[str]] = {}
    for r in rows:
        entries.setdefault(f"{r['query_id']}.csv", []).append(r["line"])
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, own in sorted(entries.items()):
            z.writestr(name, "\n".join(own) + "\n")
    return sorted(entries)


def zip_layout(path: str, expected: Iterable[str]) -> dict[str, list[str]]:
    """Entries that are missing from a ZIP file, and those that shouldn't be there."""
    with zipfile.ZipFile(path) as z:
        names, want = set(z.namelist()), set(expected)
    return {"missing": sorted(want - names), "unexpected": sorted(names - want)}


def json_lines(df: DataFrame, path: str, order: list | None = None) -> None:
    """One JSON object a line; with an order, globally sorted over the files."""
    d = df.orderBy(*order) if order else df
    d.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value")).write.mode("overwrite").text(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Only the partitions that df holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
