"""Nearest record in time for the same entity: co-grouped time ranges with overlapping margins and binary search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidsift.session import parallelism

#: Seconds of a time range; rows that a range or a bundle of ranges should hold.
RANGE_SECONDS = 64.0
BUNDLE_ROWS = 100_000
#: A range is large beyond a LARGE_SHARE-th of all rows (BUNDLE_ROWS at least); so at most LARGE_SHARE ranges are large.
LARGE_SHARE = 20_000


def _nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The nearest right row of each left row within its cell (entity, range, part), by one binary search for all."""
    empty = pd.DataFrame({"__row": pd.Series(dtype="int64"), "__uid": pd.Series(dtype="int64"), "__ref": pd.Series(dtype="int64"), "__at": pd.Series(dtype="float64"), "__dist": pd.Series(dtype="float64")})
    if left.empty or right.empty:
        return empty
    m, k = len(left), len(right)
    cell = np.zeros(m + k, dtype=np.int64)
    for c in ("__e", "__range", "__part", "__grid"):
        code, values = pd.factorize(pd.concat([left[c], right[c]], ignore_index=True), use_na_sentinel=False)
        # dense again after each column, so that the product stays within 64 bits
        cell = pd.factorize(cell * len(values) + code)[0].astype(np.int64)
    times, rank = np.unique(np.concatenate([left["__t"].to_numpy(), right["__t"].to_numpy()]), return_inverse=True)
    key = cell * len(times) + rank
    order = np.lexsort((right["__ref"].to_numpy(), key[m:]))
    rkey, rt, rid = key[m:][order], right["__t"].to_numpy()[order], right["__ref"].to_numpy()[order]
    rcell, lcell, lt = cell[m:][order], cell[:m], left["__t"].to_numpy()
    after = np.searchsorted(rkey, key[:m], side="left")
    # the first of equal times before holds the smallest id
    before = np.searchsorted(rkey, rkey[np.maximum(after - 1, 0)], side="left")
    far = np.full(m, np.inf)
    at_after, at_before = np.minimum(after, k - 1), before
    d_after = np.where((after < k) & (rcell[at_after] == lcell), np.abs(rt[at_after] - lt), far)
    d_before = np.where((after > 0) & (rcell[at_before] == lcell), np.abs(rt[at_before] - lt), far)
    take_before = (d_before < d_after) | ((d_before == d_after) & (rid[at_before] < rid[at_after]))
    best = np.where(take_before, at_before, at_after)
    dist = np.where(take_before, d_before, d_after)
    ok = np.isfinite(dist)
    return pd.DataFrame({"__row": left["__row"].to_numpy()[ok], "__uid": left["__uid"].to_numpy()[ok], "__ref": rid[best][ok], "__at": rt[best][ok], "__dist": dist[ok]})


def nearest_in_time(
    records: DataFrame,
    refs: DataFrame,
    *,
    entity: str,
    record_id: str,
    record_time: str,
    ref_id: str,
    ref_time: str,
    tolerance: float = 3.0,
    range_seconds: float = RANGE_SECONDS,
    bundle_rows: int = BUNDLE_ROWS,
) -> DataFrame:
    """For each record the ref of its entity nearest in time: record_id (long), ref_id (long), ref_time, distance_seconds.

    A record without a ref within `tolerance` (inclusive, difference in double precision) gives no row. Equally
    near refs: the smaller ref_id. Records and refs with a null entity or a null or not finite time match nothing;
    refs with null ref_id don't count; repeated refs count once. A record_id that occurs several times gives a
    row for each occurrence. Empty tables give no rows. Other columns are ignored.

    Both sides are cut into ranges of entity and time; a ref within `tolerance` of a range's border also goes to
    the neighbouring range, so each record finds its nearest ref in its own range. Ranges are co-grouped in
    bundles by hash. A range with more rows than a bundle should hold is split: records by hash over parts that
    each see the range's refs, and where the refs are many as well, refs over a grid, with one more aggregation
    that keeps each record's best.
    """
    if range_seconds < 2 * tolerance:
        raise ValueError("a time range must be at least twice the tolerance")
    spark = records.sparkSession
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(1e15))
    at = lambda t: F.floor(t / F.lit(range_seconds)).cast("long")
    left = records.select(F.col(entity).alias("__e"), F.col(record_id).cast("long").alias("__row"), F.col(record_time).cast("double").alias("__t"))
    left = left.filter(F.col("__e").isNotNull() & finite("__t")).withColumn("__range", at(F.col("__t"))).withColumn("__uid", F.lit(0).cast("long"))
    right = refs.select(F.col(entity).alias("__e"), F.col(ref_id).cast("long").alias("__ref"), F.col(ref_time).cast("double").alias("__t"))
    right = right.filter(F.col("__e").isNotNull() & F.col("__ref").isNotNull() & finite("__t"))
    spread_to = F.array_distinct(F.array(at(F.col("__t") - tolerance), at(F.col("__t")), at(F.col("__t") + tolerance)))
    right = right.withColumn("__range", F.explode(spread_to))

    counts = left.groupBy("__e", "__range").agg(F.count(F.lit(1)).alias("__n"), F.lit(0).cast("long").alias("__k")).unionByName(
        right.groupBy("__e", "__range").agg(F.lit(0).cast("long").alias("__n"), F.count(F.lit(1)).alias("__k"))
    )
    total = records.count() + refs.count()
    least = max(bundle_rows, total // LARGE_SHARE + 1)
    large = counts.filter((F.col("__n") >= least) | (F.col("__k") >= least)).groupBy("__e", "__range").agg(F.sum("__n").alias("__n"), F.sum("__k").alias("__k")).collect()
    bundles = max(total // bundle_rows + 1, parallelism(spark))

    left, right = left.withColumns({"__part": F.lit(0), "__grid": F.lit(0)}), right.withColumns({"__part": F.lit(0), "__grid": F.lit(0)})
    grids = 1
    if large:
        rows = [(r["__e"], r["__range"], int(r["__n"] // least + 1), int(r["__k"] // least + 1)) for r in large]
        grids = max(r[3] for r in rows)
        kind = left.schema["__e"].dataType.simpleString()
        marks = F.broadcast(spark.createDataFrame(rows, f"__e {kind}, __range long, __parts int, __grids int"))  # LARGE_SHARE * 2 rows at most
        split = lambda df, own, other, by, to_own, to_other: (
            df.drop("__part", "__grid")
            .join(marks, ["__e", "__range"], "left")
            .withColumn(to_own, F.coalesce(F.pmod(F.xxhash64(by), F.col(own)), F.lit(0)).cast("int"))
            .withColumn(to_other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)))
            .drop("__parts", "__grids")
        )
        if grids > 1:
            left = left.withColumn("__uid", F.monotonically_increasing_id())
        left = split(left, "__parts", "__grids", "__row", "__part", "__grid")
        right = split(right, "__grids", "__parts", "__t", "__grid", "__part")

    bundle: Column = F.pmod(F.xxhash64("__e", "__range", "__part", "__grid"), F.lit(bundles)).alias("__bundle")
    paired = (
        left.withColumn("__bundle", bundle)
        .groupBy("__bundle")
        .cogroup(right.withColumn("__bundle", bundle).groupBy("__bundle"))
        .applyInPandas(_nearest, "__row long, __uid long, __ref long, __at double, __dist double")
    )
    if grids > 1:
        best = F.min(F.struct("__dist", "__ref", "__at"))
        paired = paired.groupBy("__row", "__uid").agg(best.alias("b")).select("__row", F.col("b.__ref").alias("__ref"), F.col("b.__at").alias("__at"), F.col("b.__dist").alias("__dist"))
    return paired.filter(F.col("__dist") <= tolerance).select(
        F.col("__row").alias(record_id), F.col("__ref").alias(ref_id), F.col("__at").alias(ref_time), F.col("__dist").alias("distance_seconds")
    )
