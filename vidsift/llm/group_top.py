"""Top N rows of every group, with a histogram threshold for each and a total tie order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidsift.session import cut

HISTOGRAM_BINS = 16
#: A group is large beyond LARGE_LEAST rows or a LARGE_SHARE-th of all rows; so at most LARGE_SHARE groups are large.
LARGE_LEAST = 4_096
LARGE_SHARE = 20_000


def _bin(score: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(F.floor((score - low) / (high - low) * HISTOGRAM_BINS), F.lit(0)), F.lit(HISTOGRAM_BINS - 1)).cast("int")


def top_n_per_group(
    df: DataFrame,
    *,
    group: Sequence[str],
    score: str,
    label: str,
    row_id: str,
    same: Sequence[str] = (),
    n: int = 5,
    low: float = 0.0,
    high: float = 1.0,
    large_least: int = LARGE_LEAST,
) -> DataFrame:
    """The n best rows of each group: columns group..., row_id, label, score, result_rank (int, from 1).

    Order: higher score, then smaller label by code point (null last), then smaller row_id.
    Rows whose score is null, NaN or outside [low, high] are left out. Of rows that agree in group, label
    (not null), score and all columns of `same`, only the smallest row_id counts; nulls in `same` agree with
    each other, rows with a null label never agree. Null group values form a group of their own. A group with
    fewer than n rows gives all it has; an empty table gives none. Columns that aren't named are ignored.
    row_id must be unique; rows with a null row_id sort first among equals, as Spark orders nulls.

    One aggregation counts each group and fills a score histogram for it. A bin holds 64 hash buckets of the rows
    that count as one (a bit each, so `bit_or` merges them); their number never exceeds that of distinct rows, so the
    highest bin at and above which they reach n is a safe lower threshold. Every group has its threshold, rows below it
    are dropped, and what is left is ranked exactly. The thresholds of large groups (LARGE_SHARE rows at most, by how
    large is defined) go to all tasks, so that their rows are dropped before any shuffle, and what is left of a large
    group (ties may leave much) is ranked in salted parts first. All other groups may be as many as rows: their rows
    meet the thresholds by group, and the same exchange serves the removal of repeats and the ranking.
    """
    spark = df.sparkSession
    s = [f"__s{i}" for i in range(len(same))]
    # one struct is the key: its fields may be null and yet equal, in joins as in windows
    g = "__g"
    d = df.select(
        F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)]).alias(g),
        *[F.col(c).alias(a) for c, a in zip(same, s)],
        F.col(label).alias("__label"),
        F.col(score).cast("double").alias("__score"),
        F.col(row_id).alias("__id"),
    ).filter(F.col("__score").isNotNull() & ~F.isnan("__score") & F.col("__score").between(low, high))
    # 0.0 and -0.0 are one score
    d = d.withColumn("__score", F.col("__score") + F.lit(0.0))

    # An own hash for null labels keeps rows apart that never agree.
    one = F.xxhash64(*[F.col(c) for c in ("__label", "__score", *s)], F.when(F.col("__label").isNull(), F.col("__id")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(one, F.lit(64)).cast("int"))
    bins = [F.bit_or(F.when(_bin(F.col("__score"), low, high) == b, bit)).alias(f"__b{b}") for b in range(HISTOGRAM_BINS)]
    counted = d.groupBy(g).agg(F.count(F.lit(1)).alias("__rows"), *bins)
    reach, threshold = F.lit(0), F.lit(None).cast("int")
    for b in range(HISTOGRAM_BINS - 1, -1, -1):
        reach = reach + F.coalesce(F.bit_count(f"__b{b}"), F.lit(0))
        threshold = F.coalesce(threshold, F.when(reach >= n, F.lit(b)))
    thresholds = cut(counted.select(g, "__rows", F.coalesce(threshold, F.lit(0)).alias("__from")))
    total = thresholds.agg(F.sum("__rows")).first()[0] or 0
    least = max(large_least, total // LARGE_SHARE + 1)
    parts = (F.col("__rows") / least).cast("int") + 1
    found = thresholds.filter(F.col("__rows") >= least).select(g, "__from", parts.alias("__parts")).collect()

    def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
        # One exchange by keys serves both steps: the window over what counts as one row lies within a group.
        w = Window.partitionBy(*keys).orderBy(F.col("__score").desc(), F.col("__label").asc_nulls_last(), F.col("__id").asc())
        return rows.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n)

    def distinct(rows: DataFrame, keys: list[str]) -> DataFrame:
        agree = [*keys, "__score", "__label", *s]
        kept = rows.filter(F.col("__label").isNotNull()).groupBy(*agree).agg(F.min("__id").alias("__id"))
        return kept.unionByName(rows.filter(F.col("__label").isNull()).select(*agree, "__id"))

    def distinct_in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.col("__score").desc(), F.col("__label").asc_nulls_last(), *[F.col(c) for c in s], F.col("__id").asc())
        before = lambda c: F.lag(F.col(c)).over(w)
        again = F.col("__label").isNotNull() & F.coalesce(before("__label") == F.col("__label"), F.lit(False)) & F.coalesce(before("__score") == F.col("__score"), F.lit(False))
        for c in s:
            again = again & before(c).eqNullSafe(F.col(c))
        first = F.row_number().over(w) == 1
        return rows.withColumn("__again", again & ~first).filter(~F.col("__again")).drop("__again")

    above = _bin(F.col("__score"), low, high) >= F.col("__from")
    rest, hot = d, None
    if found:
        schema = f"{g} {d.schema[g].dataType.simpleString()}, __from int, __parts int"
        marks = F.broadcast(spark.createDataFrame([tuple(r) for r in found], schema))
        rest = d.join(marks, g, "left_anti")
        # repeats share their part, whatever their row_id; rows that never agree are dealt by row_id
        hot = d.join(marks, g).filter(above).withColumn("__part", F.pmod(one, F.col("__parts"))).drop("__from", "__parts")
    small = thresholds.filter(F.col("__rows") < least).select(g, "__from")
    out = ranked(distinct_in_order(rest.join(small.hint("shuffle_hash"), g).filter(above).drop("__from"), [g]), [g]).select(g, "__id", "__label", "__score", "__rank")
    if hot is not None:
        first = ranked(distinct(hot, [g, "__part"]), [g, "__part"])
        out = out.unionByName(ranked(first.select(g, "__id", "__label", "__score"), [g]))
    return out.select(
        *[F.col(f"{g}.g{i}").alias(c) for i, c in enumerate(group)],
        F.col("__id").alias(row_id),
        F.col("__label").alias(label),
        F.col("__score").alias(score),
        F.col("__rank").cast("int").alias("result_rank"),
    )
