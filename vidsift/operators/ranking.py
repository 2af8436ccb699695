"""Ranking with a total order: every rank ends with a unique key and is a BIGINT from 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidsift.session import cut

#: Digits to which scores are rounded before they order rows, so that the last bit can't swap two.
ORDER_DIGITS = 9
#: Numbers of an order that one window sees.
BUCKET_WIDTH = 10_000


def by_score(score: str | Column) -> Column:
    return F.round(F.col(score) if isinstance(score, str) else score, ORDER_DIGITS).desc_nulls_last()


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank", top: int | None = None) -> DataFrame:
    """All rows numbered in one order. With `top`, only the first ones, taken before they meet in one task.

    Else rows are sorted over range partitions and written to the checkpoint folder with their place in the partition;
    a partition's rows begin after those of the partitions before it. No task sees more than its own range.
    """
    if top:
        first = df.orderBy(*order).limit(top)
        return first.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    placed = df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("__at", F.col("__at") - F.shiftleft(F.col("__part").cast("long"), 33)))
    counts = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for part, n in counts:
        before += [F.lit(part), F.lit(total)]
        total += n
    offset = F.create_map(*before)[F.col("__part")] if before else F.lit(0)
    return placed.withColumn(name, (offset + F.col("__at") + 1).cast("long")).drop("__part", "__at")


def rank_by(df: DataFrame, partition: Sequence[str], order: Sequence[Column | str], name: str = "rank", top: int | None = None) -> DataFrame:
    """Rows numbered within each partition; with `top`, only the first ones (pruned before the exchange by Spark)."""
    if not partition:
        return global_rank(df, order, name, top)
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    out = out.filter(F.col(name) <= top) if top else out
    return out.withColumn(name, F.col(name).cast("long"))


def diversify(hits: DataFrame, per_video: int, query: str = "query_id", video: str = "video_id", rank: str = "rank", top: int | None = None) -> DataFrame:
    """The first `per_video` hits of each video in rank order, ranked anew without gaps."""
    few = rank_by(hits, [query, video], [F.col(rank)], "__in_video", per_video).drop("__in_video")
    return rank_by(few.withColumnRenamed(rank, "__old"), [query], [F.col("__old")], rank, top).drop("__old")


def first_per_video(hits: DataFrame, query: str = "query_id", video: str = "video_id", order: Sequence[str] = ("rank",), rank: str = "rank") -> DataFrame:
    """One hit per video, its first in order, ranked anew: entity ranks for fusion."""
    one = rank_by(hits, [query, video], [F.col(c) for c in order], "__n", 1).drop("__n")
    names = [c for c in order if c != rank]
    return rank_by(one.withColumnRenamed(rank, "__old"), [query], [F.col("__old"), *[F.col(c) for c in (video, *names)]], rank).drop("__old")


def suppress_texts(hits: DataFrame, text: str, per_text: int = 1, per_video: int = 4, limit: int | None = None, query: str = "query_id", video: str = "video_id", rank: str = "rank") -> DataFrame:
    """In rank order, at most per_text hits with the same text of a video and per_video hits of a video.

    Hits dropped as repeats don't count for the video; empty and null texts are no repeats.
    """
    blank = F.coalesce(F.col(text), F.lit("")) == ""
    own = F.when(blank, F.concat(F.lit("\u0000"), F.col(rank).cast("string"))).otherwise(F.col(text))
    once = rank_by(hits.withColumn("__text", own), [query, video, "__text"], [F.col(rank)], "__t", per_text)
    few = rank_by(once, [query, video], [F.col(rank)], "__v", per_video).drop("__text", "__t", "__v")
    return rank_by(few.withColumnRenamed(rank, "__old"), [query], [F.col("__old")], rank, limit).drop("__old")


def rank_score(df: DataFrame, partition: Sequence[str], rank: str = "rank", name: str = "local_score") -> DataFrame:
    """1 for the first, 0 for the last, even steps between; 1 where there is one row."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*partition))
    return df.withColumn(name, F.when(n == 1, F.lit(1.0)).otherwise(1 - (F.col(rank) - 1) / (n - 1)))


def margins(df: DataFrame, partition: Sequence[str], score: str, rank: str = "rank") -> DataFrame:
    """Per partition the gap of the two best scores by the best, and the share of the most frequent video."""
    first = F.max(F.when(F.col(rank) == 1, F.col(score)))
    second = F.max(F.when(F.col(rank) == 2, F.col(score)))
    videos = df.groupBy(*partition, "video_id").agg(F.count(F.lit(1)).alias("n")).groupBy(*partition).agg((F.max("n") / F.sum("n")).alias("concentration"))
    gap = df.groupBy(*partition).agg(((first - second) / F.greatest(F.abs(first), F.lit(1e-9))).alias("margin"))
    return gap.join(videos, list(partition))


def rerank_first(df: DataFrame, n: int, score: Column, query: str = "query_id", rank: str = "rank") -> DataFrame:
    """The first n rows ordered anew by score; the tail keeps its order."""
    key = F.when(F.col(rank) <= n, F.round(score, ORDER_DIGITS))
    return rank_by(df.withColumn("__key", key), [query], [F.col("__key").desc_nulls_last(), F.col(rank)], "new_rank").drop("__key")


def neighbours(df: DataFrame, partition: Sequence[str], order: Sequence[str], key: str, radius: int, name: str = "neighbours") -> DataFrame:
    """The keys of up to `radius` rows before and after each row, itself among them, in order."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-radius, radius)
    return df.withColumn(name, F.collect_list(key).over(w))


def following(df: DataFrame, partition: Sequence[str], order: str, tie: str, values: Sequence[str], width: int = BUCKET_WIDTH, name: str = "next") -> DataFrame:
    """Each row with the values (a struct) of the row after it in its partition, by a whole-number `order`, then `tie`; null for the last.

    Partitions are cut into buckets of `width` numbers; a window sees one bucket, and the last row of a bucket gets the first of
    the next one that isn't empty. So a partition that holds a large share of all rows spreads over tasks. Null
    partition values are one partition; rows with a null `order` come first.
    """
    d = df.withColumns({"__p": F.struct(*partition), "__b": F.floor(F.col(order) / width).cast("long"), "__v": F.struct(*values)})
    inner = Window.partitionBy("__p", "__b").orderBy(order, tie)
    d = d.withColumns({"__n": F.lead("__v").over(inner), "__last": F.lead(F.lit(1)).over(inner).isNull(), "__bb": F.coalesce("__b", F.lit(-(2**62)))})
    heads = d.groupBy("__p", "__bb").agg(F.min(F.struct(F.col(order).alias("o"), F.col(tie).alias("t"), F.col("__v").alias("v"))).alias("h"))
    heads = heads.select("__p", "__bb", F.lead("h.v").over(Window.partitionBy("__p").orderBy("__bb")).alias("__h"))
    return d.join(heads, ["__p", "__bb"], "left").withColumn(name, F.when(F.col("__last"), F.col("__h")).otherwise(F.col("__n"))).drop("__p", "__b", "__bb", "__v", "__n", "__last", "__h")


def spaced(df: DataFrame, partition: Sequence[str], time: str, rank: str, gap: float, keep: int) -> DataFrame:
    """Greedy choice in rank order: a row is taken if it lies `gap` or more from all taken; then rejected rows fill up to `keep`.

    The columns of df, is_spaced, spaced_rank (long). Every row is looked at, in a fold over each partition's (rank, time)
    pairs that keeps `keep` of them; the rows are fetched by their rank, which must be unique in its partition. A row
    without a time is never taken, but may fill up.
    """
    pair = F.struct(F.col(rank).alias("r"), F.col(time).cast("double").alias("t"))
    listed = df.groupBy(*partition).agg(F.array_sort(F.collect_list(pair)).alias("all"))
    none = F.slice("all", 1, 0)

    def step(s: Column, x: Column) -> Column:
        far = F.coalesce(F.forall(s["taken"], lambda k: F.abs(k["t"] - x["t"]) >= gap) & x["t"].isNotNull(), F.lit(False))
        takes = (F.size(s["taken"]) < keep) & far
        return F.struct(F.when(takes, F.array_append(s["taken"], x)).otherwise(s["taken"]).alias("taken"), F.when(takes | (F.size(s["rest"]) >= keep), s["rest"]).otherwise(F.array_append(s["rest"], x)).alias("rest"))

    state = F.aggregate("all", F.struct(none.alias("taken"), none.alias("rest")), step)
    chosen = listed.select(*partition, state.alias("s"))
    fill = F.slice("s.rest", F.lit(1), F.greatest(F.lit(keep) - F.size("s.taken"), F.lit(0)))
    marked = lambda c, flag: F.transform(c, lambda x: F.struct(x["r"].alias("r"), F.lit(flag).alias("is_spaced")))
    rows = chosen.select(*partition, F.posexplode(F.concat(marked("s.taken", True), marked(fill, False))).alias("__at", "x"))
    rows = rows.select(*partition, F.col("x.r").alias(rank), "x.is_spaced", (F.col("__at") + 1).cast("long").alias("spaced_rank"))
    return df.join(rows, [*partition, rank])


def rescue(fused: DataFrame, lanes: DataFrame, sequence: DataFrame, window: int, head: int = 3, lane_depth: int = 8) -> DataFrame:
    """Fused videos with rescued ones lifted: the head stays, then the first two sequence videos, then each lane's first, then each lane's second.

    fused: query_id, video_id, rank. lanes: query_id, lane, video_id, rank. sequence: query_id, video_id, rank.
    The window limits what is lifted; everything else follows in fused order. Columns: query_id, video_id, rank, stage.
    """
    head = min(head, window)
    lane_rank = rank_by(rank_by(lanes, ["query_id", "lane", "video_id"], [F.col("rank")], "__n", 1), ["query_id", "lane"], [F.col("rank"), F.col("video_id")], "depth", lane_depth).filter("depth <= 2")
    order = lambda stage, depth, lane: F.struct(F.lit(stage).alias("stage"), depth.alias("depth"), lane.alias("lane"))
    zero = F.lit(0).cast("long")
    heads = fused.filter(F.col("rank") <= head).select("query_id", "video_id", order(0, F.col("rank"), zero).alias("o"))
    seq = rank_by(sequence, ["query_id"], [F.col("rank"), F.col("video_id")], "s", 2).select("query_id", "video_id", order(1, F.col("s"), zero).alias("o"))
    lane = lane_rank.select("query_id", "video_id", order(2, F.col("depth"), F.col("lane").cast("long")).alias("o"))
    rest = fused.select("query_id", "video_id", order(3, F.col("rank"), zero).alias("o"))
    first = heads.unionByName(seq).unionByName(lane).unionByName(rest).groupBy("query_id", "video_id").agg(F.min("o").alias("o"))
    known = first.join(fused.select("query_id", "video_id", F.col("rank").alias("fused_rank")), ["query_id", "video_id"])
    placed = rank_by(known, ["query_id"], [F.col("o"), F.col("video_id")], "place")
    # what the window cuts off goes back to its fused place
    stage = F.when(F.col("place") <= window, F.col("o.stage")).otherwise(F.lit(3))
    back = placed.withColumn("stage", stage).withColumn("__k", F.when(F.col("stage") < 3, F.col("place")).otherwise(F.col("fused_rank")))
    return rank_by(back, ["query_id"], [F.col("stage") == 3, F.col("__k"), F.col("video_id")], "rank").select("query_id", "video_id", "rank", F.col("stage").cast("int").alias("stage"))
