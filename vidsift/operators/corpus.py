"""Text corpus construction: ids, grouped frame texts, statistics and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys; nulls are written as null, strings escaped."""
    parts = []
    for name in sorted(fields):
        v = F.regexp_replace(F.regexp_replace(fields[name].cast("string"), r"\\", r"\\\\"), '"', r'\\"')
        parts.append(F.concat(F.lit(f'"{name}":'), F.when(fields[name].isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), v, F.lit('"')))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def document_id(source_type: Column, identity: dict[str, Column]) -> Column:
    return F.concat(source_type, F.lit(":"), F.substring(F.sha2(canonical_json(identity), 256), 1, 24))


def joined_texts(rows: DataFrame, keys: list[str], text: str, order: str, separator: str = " ") -> DataFrame:
    """Per key the distinct texts in order of first occurrence, joined; blank and null ones are left out."""
    d = rows.filter(F.coalesce(F.trim(F.col(text)), F.lit("")) != "")
    once = d.groupBy(*keys, text).agg(F.min(order).alias("__o"))
    one = F.transform(F.array_sort(F.collect_list(F.struct("__o", text))), lambda x: x[text])
    return once.groupBy(*keys).agg(F.array_join(one, separator).alias("text"), F.count(F.lit(1)).alias("texts"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("documents"), F.countDistinct("video_id").alias("videos"), F.count("keyframe_id").alias("mapped"), F.sum(F.length("text")).alias("chars")
    )


def fingerprint(rows: DataFrame, by: list[str], item: Column) -> DataFrame:
    """A digest of each group's rows that doesn't depend on their order: the exclusive or and count of row hashes."""
    h = F.sha2(item, 256)
    word = lambda i: F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("long")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[F.bit_xor(word(i)).alias(f"x{i}") for i in range(2)])


def corpus_order() -> list[Column]:
    return [F.col("source_type"), F.col("video_id"), F.coalesce("keyframe_id", F.lit(-1)), F.coalesce("pts_time", F.lit(-1.0)), F.col("doc_id")]


def length_stats(df: DataFrame, by: list[str], length: str, limit: int) -> DataFrame:
    """Per group the least, most and mean length, and how many texts are longer than `limit`; a null length doesn't count."""
    return df.filter(F.col(length).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("documents"), F.min(length).alias("least"), F.max(length).alias("most"), F.round(F.avg(length), 3).alias("mean"), F.count_if(F.col(length) > limit).alias("over_limit"))
