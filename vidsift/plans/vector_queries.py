"""Vector search and what follows from ranked frame hits. Queries of a set: every vector whose id is divisible by 50, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidsift.functions import vectors as V
from vidsift.operators import evaluate, ranking, vector
from vidsift.operators.fusion import rrf_entities, rrf_videos
from vidsift.registry import Registry
from vidsift.sources.tables import table

registry = Registry()
DIMS = 64
EVERY = 50

_HITS = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
s AS (SELECT q.vec_id AS query_id, q.label AS query_label, v.vec_id, v.label, 'V' || lpad(v.label::VARCHAR, 3, '0') AS video_id,
             list_inner_product(v.e, q.e) / (v.n * q.n) AS score
      FROM v, (SELECT * FROM v WHERE vec_id % 50 = 0) q),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
"""


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").withColumn("video_id", F.concat(F.lit("V"), F.lpad(F.col("label").cast("string"), 3, "0")))


def _hits(spark: SparkSession, sf: str, k: int, index: DataFrame | None = None) -> DataFrame:
    index = _index(spark, sf) if index is None else index
    queries = table(spark, sf, "embeddings").filter(F.col("vec_id") % EVERY == 0)
    return vector.cosine_topk(index, queries, key="vec_id", vector="embedding", query_key="vec_id", query_vector="embedding", k=k, dims=DIMS, carry=["video_id", "label"])


def _framed(hits: DataFrame) -> DataFrame:
    return hits.withColumn("frame_key", F.col("vec_id").cast("string"))


@registry(_HITS + "SELECT query_id, vec_id, round(score, 6) AS score, rank FROM hits WHERE rank <= 10")
def vec_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@registry(_HITS + "SELECT query_id, vec_id, round(score, 6) AS score, rank FROM hits WHERE rank <= 12 AND query_id = 0")
def vec_topk_single(spark: SparkSession, sf: str) -> DataFrame:
    """Query by example: one stored vector asks."""
    q = table(spark, sf, "embeddings").filter("vec_id = 0")
    hits = vector.cosine_topk(_index(spark, sf), q, key="vec_id", vector="embedding", query_key="vec_id", query_vector="embedding", k=12, dims=DIMS)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@registry(_HITS.replace("FROM s)", "FROM s WHERE label IN (1, 3, 5))") + "SELECT query_id, vec_id, round(score, 6) AS score, rank FROM hits WHERE rank <= 10")
def vec_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The filter lies below the search, so no pool has to grow."""
    hits = _hits(spark, sf, 10, _index(spark, sf).filter(F.col("label").isin(1, 3, 5)))
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


_USABLE = """len(clip_feature) = 128 AND list_bool_and(list_transform(clip_feature, lambda x: x IS NOT NULL AND isfinite(x)))
  AND list_bool_or(list_transform(clip_feature, lambda x: x <> 0))"""
_FRAMES = f"""
WITH v AS (SELECT vec_id, video_id, keyframe_id, clip_feature::DOUBLE[] AS e, sqrt(list_inner_product(clip_feature::DOUBLE[], clip_feature::DOUBLE[])) AS n
           FROM clip_features WHERE {_USABLE}),
s AS (SELECT q.vec_id AS query_id, v.vec_id, v.video_id, v.keyframe_id, list_inner_product(v.e, q.e) / (v.n * q.n) AS score
      FROM v, (SELECT * FROM v WHERE vec_id % 50 = 0) q),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
"""


def frame_hits(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """The k nearest frames (rows of the feature files) of every frame whose vec_id is divisible by 50, itself included."""
    rows = table(spark, sf, "clip_features")
    return vector.cosine_topk(rows, rows.filter(F.col("vec_id") % EVERY == 0), key="vec_id", vector="clip_feature", query_key="vec_id", query_vector="clip_feature", k=k, dims=128, carry=["video_id", "keyframe_id"])


@registry(_FRAMES + "SELECT query_id, vec_id, video_id, keyframe_id, round(score, 6) AS score, rank FROM hits WHERE rank <= 12")
def frame_topk(spark: SparkSession, sf: str) -> DataFrame:
    return frame_hits(spark, sf, 12).select("query_id", "vec_id", "video_id", "keyframe_id", F.round("score", 6).alias("score"), "rank")


@registry(
    _FRAMES
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY rank) AS n FROM hits WHERE rank <= 40),
a AS (SELECT query_id, video_id, max(score) AS score, min(rank) AS best_rank, count(*) AS frame_count,
             string_agg(keyframe_id::VARCHAR, '>' ORDER BY n) FILTER (WHERE n <= 3) AS frames FROM r GROUP BY 1, 2)
SELECT query_id, video_id, round(score, 6) AS score, best_rank, frame_count, frames,
       row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, best_rank, video_id) AS rank FROM a"""
)
def video_agg_max(spark: SparkSession, sf: str) -> DataFrame:
    """Visual search: frames nearest to each query frame, then videos by their best frame."""
    hits = frame_hits(spark, sf, 40).withColumn("frame_key", F.col("keyframe_id").cast("string"))
    v = vector.video_scores(hits)
    return v.select("query_id", "video_id", F.round("score", 6).alias("score"), "best_rank", "frame_count", F.array_join("frames", ">").alias("frames"), "rank")


@registry(
    _HITS
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY rank) AS n FROM hits WHERE rank <= 40),
a AS (SELECT query_id, video_id, avg(score) FILTER (WHERE n <= 3) AS score, min(rank) AS best_rank, count(*) AS frame_count FROM r GROUP BY 1, 2)
SELECT query_id, video_id, round(score, 6) AS score, frame_count,
       row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, best_rank, video_id) AS rank FROM a"""
)
def video_agg_mean_top3(spark: SparkSession, sf: str) -> DataFrame:
    v = vector.video_scores(_framed(_hits(spark, sf, 40)), mode="mean_top_n", best=3)
    return v.select("query_id", "video_id", F.round("score", 6).alias("score"), "frame_count", "rank")


@registry(
    _HITS
    + """, d AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY rank) AS n FROM hits WHERE rank <= 40)
SELECT * FROM (SELECT query_id, vec_id, video_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM d WHERE n <= 2) WHERE rank <= 12"""
)
def diversify_per_video(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.diversify(_hits(spark, sf, 40), 2, top=12).select("query_id", "vec_id", "video_id", "rank")


@registry(_HITS + ", b AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY rank) AS n FROM hits) SELECT query_id, video_id, vec_id, round(score, 6) AS score FROM b WHERE n = 1")
def best_frame_per_video(spark: SparkSession, sf: str) -> DataFrame:
    """The best frame within each video, over all rows: each batch sends its best per video, maxima merge map-side."""
    index = _index(spark, sf)
    queries = index.filter(F.col("vec_id") % EVERY == 0)
    best = vector.best_per_video(index, queries, key="vec_id", vector="embedding", video="video_id", query_key="vec_id", query_vector="embedding", dims=DIMS)
    return best.select("query_id", "video_id", "vec_id", F.round("score", 6).alias("score"))


@registry(f"""SELECT count(*) AS rows, count(*) FILTER (WHERE f) AS finite_rows, count(*) FILTER (WHERE n = 0) AS zero_rows,
  round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm, round(avg(n), 6) AS mean_norm
FROM (SELECT sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n,
             list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AS f FROM embeddings)""")
def norm_stats(spark: SparkSession, sf: str) -> DataFrame:
    return vector.norm_stats(table(spark, sf, "embeddings"), "embedding")


@registry("""SELECT label, pos, round(avg(x / n), 6) AS mean, count(*) AS rows FROM (
  SELECT label, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
GROUP BY ALL""")
def centroid_per_label(spark: SparkSession, sf: str) -> DataFrame:
    """Mean unit vector per label, value by value."""
    u = table(spark, sf, "embeddings").select("label", F.posexplode(V.unit(F.col("embedding"))).alias("pos", "x"))
    return u.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg("x"), 6).alias("mean"), F.count(F.lit(1)).alias("rows"))


@registry(f"SELECT count(*) AS rows, count(*) FILTER (WHERE {_USABLE}) AS usable, count(*) FILTER (WHERE clip_feature IS NULL) AS missing, count(*) FILTER (WHERE len(clip_feature) <> 128) AS odd_length FROM clip_features")
def feature_sanity(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("clip_feature")
    return table(spark, sf, "clip_features").agg(F.count(F.lit(1)).alias("rows"), F.count_if(V.usable(v, 128)).alias("usable"), F.count_if(v.isNull()).alias("missing"), F.count_if(F.size(v) != 128).alias("odd_length"))


_TWO = _HITS + """, near AS (SELECT query_id, 'clip' AS channel, video_id, vec_id, rank FROM hits WHERE rank <= 40),
far AS (SELECT query_id, 'bge' AS channel, video_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY abs(vec_id - query_id), vec_id) AS rank FROM s QUALIFY rank <= 40),
u AS (SELECT * FROM near UNION ALL SELECT * FROM far)
"""


def _two_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Frames by similarity, and frames by the distance of their ids (a stand-in for a second retriever)."""
    near = _hits(spark, sf, 40).select("query_id", F.lit("clip").alias("channel"), "video_id", "vec_id", "rank")
    index = _index(spark, sf).select("vec_id", "video_id")
    # only ids within 45 of the query's can be among the 40 closest, apart from gaps at the table's ends
    q = index.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.col("vec_id") - 90, F.col("vec_id") + 90)).alias("vec_id"))
    far = ranking.rank_by(q.join(index, "vec_id"), ["query_id"], [F.abs(F.col("vec_id") - F.col("query_id")), F.col("vec_id")], "rank", 40)
    return near.unionByName(far.select("query_id", F.lit("bge").alias("channel"), "video_id", "vec_id", "rank"))


_RRF = _TWO + """, one AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel, video_id ORDER BY rank, vec_id::VARCHAR) AS n FROM u),
r AS (SELECT query_id, channel, video_id, row_number() OVER (PARTITION BY query_id, channel ORDER BY rank, video_id) AS r FROM one WHERE n = 1),
c AS (SELECT *, {w} / (60.0 + r) AS c FROM r),
a AS (SELECT query_id, video_id, sum(c) AS score, min(r) AS best_rank, arg_min(channel, (-c, r, channel)) AS best_channel, string_agg(channel, ',' ORDER BY channel) AS channels FROM c GROUP BY 1, 2)
SELECT query_id, video_id, round(score, 6) AS score, best_rank, best_channel, channels,
       row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, best_rank, video_id) AS rank FROM a"""


@registry(_RRF.replace("{w}", "1.0"))
def rrf_two_channels(spark: SparkSession, sf: str) -> DataFrame:
    return rrf_videos(_two_channels(spark, sf), tie="vec_id").withColumn("score", F.round("score", 6))


@registry(_RRF.replace("{w}", "CASE channel WHEN 'clip' THEN 1.0 ELSE 0.5 END"))
def rrf_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return rrf_videos(_two_channels(spark, sf), {"clip": 1.0, "bge": 0.5}, tie="vec_id").withColumn("score", F.round("score", 6))


@registry(
    _TWO
    + """, a AS (SELECT query_id, video_id, vec_id, sum(1.0 / (60 + rank)) AS score, min(rank) AS best_rank, count(*) AS hits FROM u GROUP BY ALL)
SELECT query_id, video_id, vec_id, round(score, 6) AS score, best_rank, hits,
       row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, best_rank, video_id, vec_id) AS rank FROM a"""
)
def rrf_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Event fusion on frames: every hit adds its share."""
    return rrf_entities(_two_channels(spark, sf), ["video_id", "vec_id"]).withColumn("score", F.round("score", 6))


@registry(
    _HITS
    + """, x AS (SELECT query_id, vec_id, rank, score, label, query_label, max(abs(score)) OVER (PARTITION BY query_id) AS best FROM hits WHERE rank <= 20),
k AS (SELECT *, CASE WHEN rank <= 12 THEN round(score / greatest(best, 1e-9) + 0.08 * (label = query_label)::INT + 0.12 * (vec_id % 7 = 0)::INT, 9) END AS k FROM x)
SELECT query_id, vec_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY k DESC NULLS LAST, rank) AS new_rank FROM k"""
)
def rerank_topn(spark: SparkSession, sf: str) -> DataFrame:
    """The first twelve ordered anew by score and matches; the rest keep their places."""
    from vidsift.operators.fusion import light_score

    hits = _hits(spark, sf, 20)
    labels = _index(spark, sf).filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    best = hits.groupBy("query_id").agg(F.max(F.abs("score")).alias("best"))
    x = hits.join(labels, "query_id").join(best, "query_id")
    word = F.array(F.lit("seventh"))
    none = F.array().cast("array<string>")
    score = light_score(F.col("score"), F.col("best"), (F.col("label") == F.col("query_label")).cast("int"), word, F.when(F.col("vec_id") % 7 == 0, word).otherwise(none), none, none)
    return ranking.rerank_first(x, 12, score).select("query_id", "vec_id", "rank", "new_rank")


@registry(
    _HITS
    + """, h AS (SELECT query_id, query_label, label, min(rank) AS r FROM hits WHERE rank <= 40 GROUP BY ALL),
vr AS (SELECT query_id, query_label, label, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM h),
q AS (SELECT query_id, min(rank) FILTER (WHERE label = query_label) AS first_rank FROM vr GROUP BY 1)
SELECT query_id, first_rank, coalesce(1.0 / first_rank, 0.0) AS rr, (coalesce(first_rank, 99) <= 1)::INT::DOUBLE AS hit_1,
       (coalesce(first_rank, 99) <= 5)::INT::DOUBLE AS hit_5, (coalesce(first_rank, 99) <= 10)::INT::DOUBLE AS hit_10,
       round(CASE WHEN first_rank <= 10 THEN 1 / log2(first_rank + 1) ELSE 0 END, 6) AS ndcg FROM q"""
)
def rank_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """MRR, recall and nDCG parts of each query; the video of the query's own label is relevant."""
    hits = ranking.first_per_video(_hits(spark, sf, 40))
    index = _index(spark, sf).filter(F.col("vec_id") % EVERY == 0)
    q = index.select(F.col("vec_id").alias("query_id"), "video_id")
    m = evaluate.rank_metrics(hits.select("query_id", "video_id", "rank"), q, q)
    return m.select("query_id", "first_rank", "rr", "hit_1", "hit_5", "hit_10", F.round("ndcg", 6).alias("ndcg"))


@registry(
    _HITS
    + """, d AS (SELECT query_id, label, count(*) AS n FROM hits WHERE rank <= 10 GROUP BY ALL)
SELECT query_id, round(count(*) / 10.0, 6) AS unique_share, (sum(n) - count(*))::BIGINT AS repeats, max(n) AS most FROM d GROUP BY 1"""
)
def diversity_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.diversity(_hits(spark, sf, 10), 10).withColumn("unique_share", F.round("unique_share", 6))


@registry(_HITS + "SELECT query_id, vec_id, rank, round(CASE WHEN count(*) OVER w = 1 THEN 1.0 ELSE 1 - (rank - 1.0) / (count(*) OVER w - 1) END, 6) AS local_score FROM hits WHERE rank <= 15 WINDOW w AS (PARTITION BY query_id)")
def rank_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.rank_score(_hits(spark, sf, 15), ["query_id"]).select("query_id", "vec_id", "rank", F.round("local_score", 6).alias("local_score"))


@registry(
    _HITS
    + """, h AS (SELECT * FROM hits WHERE rank <= 15), n AS (SELECT query_id, video_id, count(*) AS n FROM h GROUP BY ALL)
SELECT query_id, round((max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2)) / greatest(abs(max(score) FILTER (WHERE rank = 1)), 1e-9), 6) AS margin,
       round((SELECT max(n) / sum(n) FROM n WHERE n.query_id = h.query_id), 6) AS concentration FROM h GROUP BY query_id"""
)
def score_margins(spark: SparkSession, sf: str) -> DataFrame:
    m = ranking.margins(_hits(spark, sf, 15), ["query_id"], "score")
    return m.select("query_id", F.round("margin", 6).alias("margin"), F.round("concentration", 6).alias("concentration"))


@registry(
    _TWO
    + """, f AS (SELECT query_id, video_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, b, video_id) AS rank FROM (
  SELECT query_id, video_id, round(sum(1.0 / (60 + rank)), 9) AS s, min(rank) AS b FROM u GROUP BY ALL)),
l AS (SELECT query_id, lane, video_id, row_number() OVER (PARTITION BY query_id, lane ORDER BY r, video_id) AS depth FROM (
  SELECT query_id, CASE channel WHEN 'clip' THEN 1 ELSE 2 END AS lane, video_id, min(rank) AS r FROM u GROUP BY ALL) QUALIFY depth <= 2),
k AS (SELECT query_id, video_id, 0 AS stage, rank AS d, 0 AS lane FROM f WHERE rank <= 3
      UNION ALL SELECT query_id, video_id, 2, depth, lane FROM l UNION ALL SELECT query_id, video_id, 3, rank, 0 FROM f),
m AS (SELECT query_id, video_id, min((stage, d, lane)) AS o FROM k GROUP BY ALL),
p AS (SELECT m.*, f.rank AS fused, row_number() OVER (PARTITION BY m.query_id ORDER BY o, m.video_id) AS place FROM m JOIN f USING (query_id, video_id)),
g AS (SELECT *, CASE WHEN place <= 6 THEN o[1] ELSE 3 END AS stage FROM p)
SELECT query_id, video_id, row_number() OVER (PARTITION BY query_id ORDER BY stage = 3, CASE WHEN stage < 3 THEN place ELSE fused END, video_id) AS rank, stage::INTEGER AS stage FROM g"""
)
def round_robin_rescue(spark: SparkSession, sf: str) -> DataFrame:
    """The fused head stays, then each channel's first and second video, then the rest."""
    u = _two_channels(spark, sf)
    fused = u.withColumn("c", 1.0 / (60 + F.col("rank"))).groupBy("query_id", "video_id").agg(F.sum("c").alias("s"), F.min("rank").alias("b"))
    fused = ranking.rank_by(fused, ["query_id"], [ranking.by_score("s"), F.col("b"), F.col("video_id")], "rank").select("query_id", "video_id", "rank")
    lanes = u.select("query_id", F.when(F.col("channel") == "clip", 1).otherwise(2).alias("lane"), "video_id", "rank")
    none = fused.filter("rank < 0")
    return ranking.rescue(fused, lanes, none, window=6)


@registry(
    _HITS.replace("WITH v AS", "WITH RECURSIVE v AS", 1)
    + """, h AS (SELECT query_id, vec_id, rank FROM hits WHERE rank <= 40),
r AS (SELECT DISTINCT query_id, 0::BIGINT AS rank, []::BIGINT[] AS taken FROM h
      UNION ALL SELECT r.query_id, h.rank, CASE WHEN len(taken) < 8 AND len(list_filter(taken, lambda x: abs(x - vec_id) < 30)) = 0 THEN list_append(taken, vec_id) ELSE taken END FROM r JOIN h ON h.query_id = r.query_id AND h.rank = r.rank + 1),
t AS (SELECT query_id, arg_max(taken, rank) AS taken FROM r GROUP BY 1), m AS (SELECT query_id, vec_id, rank, list_contains(taken, vec_id) AS is_spaced FROM h JOIN t USING (query_id))
SELECT query_id, vec_id, rank, is_spaced, row_number() OVER (PARTITION BY query_id ORDER BY is_spaced DESC, rank) AS spaced_rank FROM m QUALIFY spaced_rank <= 8"""
)
def temporal_diversity(spark: SparkSession, sf: str) -> DataFrame:
    """Per query frames at least 30 ids apart, greedily in rank order, filled up to eight."""
    hits = _hits(spark, sf, 40).withColumn("t", F.col("vec_id").cast("double"))
    return ranking.spaced(hits, ["query_id"], "t", "rank", 30.0, 8).select("query_id", "vec_id", "rank", "is_spaced", "spaced_rank")
