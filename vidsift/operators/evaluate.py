"""Rank quality, percentiles and judgement summaries. A metric without labels is null, never 0."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ideal_dcg(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, r: s + F.lit(1.0) / F.log2(r + 1))


def rank_metrics(hits: DataFrame, qrels: DataFrame, queries: DataFrame, cuts: Sequence[int] = (1, 5, 10), depth: int = 10) -> DataFrame:
    """Per query: judged, first_rank, rr, hit@k, ndcg. hits: query_id, video_id, rank (one row per video); qrels: query_id, video_id."""
    rel = qrels.select("query_id", "video_id").distinct()
    size = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    found = hits.join(rel, ["query_id", "video_id"], "left_semi").groupBy("query_id").agg(
        F.min("rank").alias("first_rank"), F.sum(F.when(F.col("rank") <= depth, F.lit(1.0) / F.log2(F.col("rank") + 1)).otherwise(F.lit(0.0))).alias("dcg")
    )
    q = queries.select("query_id").distinct().join(size, "query_id", "left").join(found, "query_id", "left")
    judged = F.col("relevant").isNotNull()
    null = lambda c: F.when(judged, c)
    return q.select(
        "query_id", judged.alias("judged"), "first_rank",
        null(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("rr"),
        *[null(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in cuts],
        null(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal_dcg(F.least("relevant", F.lit(depth)))).alias("ndcg"),
    )


def mean_metrics(per_query: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    names = [c for c in per_query.columns if c in ("rr", "ndcg") or c.startswith("hit_")]
    return per_query.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), F.count_if("judged").alias("judged"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in names])


def graded_ndcg(rows: DataFrame, key: str, rank: str, gain: Column, depth: int = 10) -> DataFrame:
    """nDCG with graded gains; the ideal order is by gain over all judged rows of the query."""
    d = rows.withColumn("__g", gain)
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.col("__g").desc_nulls_last(), F.col(rank)))
    d = d.withColumn("__b", best)
    part = lambda r: F.when(F.col(r) <= depth, F.coalesce("__g", F.lit(0.0)) / F.log2(F.col(r) + 1)).otherwise(F.lit(0.0))
    agg = d.groupBy(key).agg(F.sum(part(rank)).alias("dcg"), F.sum(part("__b")).alias("ideal"))
    return agg.select(key, F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).alias("ndcg"))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float], rule: str = "half_even") -> DataFrame:
    """Percentiles that are values of the data: the sorted value at (n - 1) * share, rounded half to even or, with rule ceil, at ceil(n * share).

    Equal values are counted before they meet, and only distinct values are put in order; nulls don't count.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*by)
    upto = F.sum("__c").over(w.orderBy(value))
    d = counted.select(*by, value, upto.alias("__hi"), (upto - F.col("__c") + 1).alias("__lo"), F.sum("__c").over(w).alias("__n"))
    at = (lambda p: F.bround((F.col("__n") - 1) * F.lit(p), 0).cast("long") + 1) if rule == "half_even" else (lambda p: F.greatest((F.col("__n") * F.lit(p) + 0.999999).cast("long"), F.lit(1)))
    return d.groupBy(*by).agg(F.max("__n").alias("n"), *[F.max(F.when(at(p).between(F.col("__lo"), F.col("__hi")), F.col(value))).alias(name) for name, p in shares.items()])


def diversity(hits: DataFrame, k: int) -> DataFrame:
    """Per query among the first k: distinct videos by k, repeats, the most hits of one video."""
    n = hits.filter(F.col("rank") <= k).groupBy("query_id", "video_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("query_id").agg((F.count(F.lit(1)) / F.lit(float(k))).alias("unique_share"), (F.sum("n") - F.count(F.lit(1))).alias("repeats"), F.max("n").alias("most"))


def weighted_quality(rows: DataFrame, by: Sequence[str], gain: Column) -> DataFrame:
    """Mean gain per group and over groups, each weighted by its judged rows."""
    g = rows.withColumn("__g", gain).groupBy(*by).agg(F.count("__g").alias("judged"), F.avg("__g").alias("quality"))
    return g.agg(F.sum("judged").alias("judged"), (F.sum(F.col("quality") * F.col("judged")) / F.sum("judged")).alias("weighted_quality"))


def channel_counts(hits: DataFrame) -> DataFrame:
    """Per channel its hits and queries, with its health: READY, DEGRADED where it misses queries, UNAVAILABLE where it has none."""
    total = hits.agg(F.count_distinct("query_id").alias("__q"))
    n = hits.groupBy("channel").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("query_id").alias("queries"))
    return n.crossJoin(F.broadcast(total)).select("channel", "hits", "queries", F.when(F.col("queries") == F.col("__q"), "READY").when(F.col("queries") > 0, "DEGRADED").otherwise("UNAVAILABLE").alias("health"))  # total is one row


def latency_profile(runs: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Mean, median and 95th percentile of all runs, and of the warm ones (all but the first of each group)."""
    w = Window.partitionBy(*by).orderBy(order)
    d = runs.withColumn("__warm", F.row_number().over(w) > 1)
    both = d.select(*by, value, F.lit("all").alias("runs")).unionByName(d.filter("__warm").select(*by, value, F.lit("warm").alias("runs")))
    return nearest_rank(both, [*by, "runs"], value, {"p50": 0.5, "p95": 0.95}).join(both.groupBy(*by, "runs").agg(F.avg(value).alias("mean")), [*by, "runs"])


def derived_qrels(judged: DataFrame, good: Column, bad: Column) -> DataFrame:
    """Per query the videos judged good, and those judged bad that were never judged good."""
    g = judged.groupBy("query_id", "video_id").agg(F.bool_or(F.coalesce(good, F.lit(False))).alias("good"), F.bool_or(F.coalesce(bad, F.lit(False))).alias("bad"))
    return g.select("query_id", "video_id", F.when(F.col("good"), "positive").when(F.col("bad"), "negative").otherwise("unjudged").alias("label"))


def tuned(scored: DataFrame, config: Sequence[str], metric: str, tie: Sequence[Column]) -> DataFrame:
    """The configuration with the best mean metric; ties by the given order."""
    m = scored.groupBy(*config).agg(F.avg(metric).alias(metric))
    return m.orderBy(F.round(metric, 9).desc(), *tie).limit(1)


def interval_hits(found: DataFrame, tolerances: Sequence[float]) -> DataFrame:
    """Per request how far each aligned event lies from its labelled interval (0 inside), and the share within each tolerance."""
    d = found.withColumn("__d", F.greatest(F.col("start") - F.col("t"), F.col("t") - F.col("end"), F.lit(0.0)))
    return d.groupBy("request_id").agg(F.avg("__d").alias("mean_error"), *[F.avg((F.col("__d") <= x).cast("double")).alias(f"within_{x:g}") for x in tolerances])


def same_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two runs has: none where a query is deterministic."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def review_metrics(reviews: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rates of reviewed answers (decision, confirmed, evidence_ids, frame, frame_from, frame_to): edited and rejected of those with a
    decision, with evidence of those confirmed, frames within the accepted range of those that have one. Null where nothing is known."""
    c = F.col
    share = lambda hit, known: F.round(F.avg(F.when(known, F.coalesce(hit, F.lit(False)).cast("double"))), 6)
    decided, ranged = c("decision").isNotNull(), c("frame_from").isNotNull() & c("frame_to").isNotNull()
    backed = F.coalesce(F.size("evidence_ids"), F.lit(0)) > 0
    return reviews.groupBy(*by).agg(
        F.count(F.lit(1)).alias("answers"), share(c("decision") == "EDITED", decided).alias("edit_rate"), share(c("decision") == "REJECTED", decided).alias("reject_rate"),
        share(backed, c("confirmed")).alias("evidence_coverage"), share(~backed, c("confirmed")).alias("unsupported_rate"), share(c("frame").between(c("frame_from"), c("frame_to")), ranged).alias("frame_accuracy"),
    )


def failure_stage(session: Column, event_recall: Column, video_in_top: Column, has_chain: Column, right_video: Column, required_share: Column, worst_error: Column, most_error: float = 5.0) -> Column:
    """Where a request was lost, the first that holds; null where it wasn't: no session, an event lost among the first hundred, the
    video not among the first twenty, no chain, a chain of another video, a required event missing, a moment too far off."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(~ok(session), "SESSION_NOT_PERSISTED").when(ok(event_recall < 1.0), "EVENT_RECALL_FAILURE").when(~ok(video_in_top), "VIDEO_RECALL_FAILURE").when(~ok(has_chain), "TEMPORAL_FEASIBILITY_FAILURE")
        .when(~ok(right_video), "WRONG_VIDEO").when(ok(required_share < 1.0), "REQUIRED_EVENT_MISSING").when(ok(worst_error > most_error), "FRAME_GRANULARITY_FAILURE")
    )


def alignment_metrics(requests: DataFrame, by: Sequence[str]) -> DataFrame:
    """Requests (event_recall, right_video, has_chain, required_share, worst_error, stage): recalls, the share of complete chains of the
    right video, the mean of the worst errors, and how many got through."""
    c = F.col
    good = c("has_chain") & c("right_video") & (c("required_share") >= 1.0)
    mean = lambda x: F.round(F.avg(x), 6)
    return requests.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), mean("event_recall").alias("event_recall"), mean(F.coalesce(c("right_video"), F.lit(False)).cast("double")).alias("video_recall"), mean(F.coalesce(good, F.lit(False)).cast("double")).alias("chain_success"), mean("worst_error").alias("timestamp_error"), F.count_if(c("stage").isNull()).alias("passed"))


def ablations(hits: DataFrame, configurations: Mapping[str, Mapping[str, float]], relevant: DataFrame, k: int = 60) -> DataFrame:
    """Each configuration of channel weights on the same hits, in one pass: configuration, queries, mrr, hit_1, top_video_rank.

    hits: query_id, channel, rank, video_id; relevant: query_id, video_id. A configuration is one more key of the fusion, so
    its number adds rows, not jobs; channels it doesn't name don't count.
    """
    rows = [(name, channel, float(w)) for name, weights in configurations.items() for channel, w in weights.items() if w > 0]
    table = F.broadcast(hits.sparkSession.createDataFrame(rows, "configuration string, channel string, weight double"))  # as many rows as are written in the code
    one = hits.groupBy("query_id", "channel", "video_id").agg(F.min("rank").alias("rank"))
    ranked = one.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "channel").orderBy("rank", "video_id")))
    scored = ranked.join(table, "channel").groupBy("configuration", "query_id", "video_id").agg(F.round(F.sum(F.col("weight") / (k + F.col("r"))), 9).alias("s"))
    placed = scored.withColumn("p", F.row_number().over(Window.partitionBy("configuration", "query_id").orderBy(F.col("s").desc(), "video_id")))
    asked = relevant.select("query_id").distinct().crossJoin(F.broadcast(table.select("configuration").distinct()))
    first = placed.join(relevant, ["query_id", "video_id"]).groupBy("configuration", "query_id").agg(F.min("p").alias("first"))
    rr = asked.join(first, ["configuration", "query_id"], "left")
    return rr.groupBy("configuration").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg((F.coalesce("first", F.lit(0)) == 1).cast("double")), 6).alias("hit_1"))
