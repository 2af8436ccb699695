"""Event pools, gates, windows, chains and answers over events, asr, documents and stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidsift.functions import text as T
from vidsift.operators import answers, evaluate, ranking, sequences, temporal
from vidsift.plans import planner
from vidsift.plans.evidence_queries import _ALL, _CAND, _JUDGE, _event_candidates, _judged
from vidsift.registry import Registry
from vidsift.sources.tables import table

registry = Registry()
EVENTS = ["view", "click", "purchase"]


@registry(
    _CAND
    + """, b AS (SELECT video_id, event_id, max(s) AS s FROM c GROUP BY ALL),
cov AS (SELECT video_id, count(*) FILTER (WHERE event_id IN ('view', 'click')) AS required_found, count(*) FILTER (WHERE event_id = 'purchase') AS optional_found,
  coalesce(max(s) FILTER (WHERE event_id = 'click'), 0) AS a, sum(s) AS t FROM b GROUP BY 1)
SELECT video_id, required_found, optional_found, required_found = 2 AS complete, row_number() OVER (ORDER BY (required_found = 2) DESC, required_found DESC, optional_found DESC, round(a, 9) DESC, round(t, 9) DESC, video_id) AS rank FROM cov"""
)
def grouped_videos(spark: SparkSession, sf: str) -> DataFrame:
    v = sequences.video_coverage(_event_candidates(spark, sf), ["view", "click"], ["purchase"], "click")
    return v.select("video_id", "required_found", "optional_found", "complete", "rank")


@registry(_CAND + ", m AS (SELECT event_id, max(s) AS b FROM c GROUP BY 1) SELECT video_id, event_id, candidate_id FROM c JOIN m USING (event_id) WHERE s >= 0.85 * b - 1e-12")
def seed_gate(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.seed_gate(_event_candidates(spark, sf)).select("video_id", "event_id", "candidate_id")


@registry(
    _ALL
    + """, x AS (SELECT a.video_id, a.candidate_id AS aid, a.t AS at, a.s AS s0, b.t AS bt, b.s AS s1, row_number() OVER (PARTITION BY a.video_id, a.candidate_id ORDER BY round(b.s, 9) DESC, b.t DESC, b.candidate_id) AS n
  FROM c a JOIN c b ON a.video_id = b.video_id AND a.event_id = 'click' AND b.event_id = 'view' AND b.t < a.t QUALIFY n = 1),
y AS (SELECT x.video_id, x.bt AS lo, d.t AS hi, x.s0 + x.s1 + d.s AS total, row_number() OVER (PARTITION BY x.video_id, x.aid ORDER BY round(d.s, 9) DESC, d.t, d.candidate_id) AS n2
  FROM x JOIN c d ON x.video_id = d.video_id AND d.event_id = 'purchase' AND d.t > x.at QUALIFY n2 = 1)
SELECT video_id, round(greatest(lo - 2, 0), 6) AS start, round(hi + 2, 6) AS "end", round(max(total / 3), 6) AS score FROM y GROUP BY video_id, greatest(lo - 2, 0), hi + 2"""
)
def event_windows_around_anchor(spark: SparkSession, sf: str) -> DataFrame:
    """Windows around each click: the best view before it and the best purchase after it."""
    w = sequences.windows(_event_candidates(spark, sf, None), EVENTS, "click")
    return w.select("video_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), F.round("score", 6).alias("score"))


@registry(
    _CAND
    + """, h AS (SELECT video_id, candidate_id::VARCHAR AS k, t, 1.0 / (60 + rank) AS s, CASE event_id WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS lane FROM c WHERE event_id IN ('view', 'click', 'purchase') AND t IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY event_id, video_id ORDER BY rank, candidate_id) <= 6),
w AS (SELECT a.video_id, 2 AS frames, a.s + b.s AS s, least(a.t, b.t) AS t0, b.t AS t1, a.k || '>' || b.k AS path FROM h a JOIN h b ON a.video_id = b.video_id AND a.lane < b.lane AND a.t <= b.t + 0.5
  UNION ALL SELECT a.video_id, 3, a.s + b.s + d.s, least(a.t, b.t, d.t), d.t, a.k || '>' || b.k || '>' || d.k FROM h a JOIN h b ON a.video_id = b.video_id AND a.lane = 1 AND b.lane = 2 AND a.t <= b.t + 0.5 JOIN h d ON d.video_id = b.video_id AND d.lane = 3 AND b.t <= d.t + 0.5),
z AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY frames DESC, round(s, 9) DESC, round(t1 - t0, 9), t1, path) = 1),
y AS (SELECT video_id, path, frames::INTEGER AS frames, frames / 3.0 + s + 0.05 / (1 + (t1 - t0) / 60.0) AS score, t1 - t0 AS span FROM z)
SELECT video_id, path, frames, round(score, 6) AS score, round(span, 6) AS span, row_number() OVER (ORDER BY frames DESC, round(score, 9) DESC, round(span, 9), video_id) AS rank FROM y QUALIFY rank <= 16"""
)
def compact_event_chains(spark: SparkSession, sf: str) -> DataFrame:
    """The sixteen best monotone chains (a top-k report); states are kept per hit."""
    c = _event_candidates(spark, sf).withColumnRenamed("event_id", "lane")
    out = sequences.compact_chains(c, EVENTS)
    return out.select("video_id", "path", "frames", F.round("score", 6).alias("score"), F.round("span", 6).alias("span"), "rank")


_TOK = "list_distinct(list_filter(regexp_extract_all(lower(text_raw), '[\\p{L}\\p{N}]+'), lambda x: length(x) >= 2))"


@registry(f"""WITH s AS (SELECT video_id, segment_id, asr_id, start_time AS t, run_id AS scene, coalesce({_TOK}, []) AS k FROM asr WHERE start_time IS NOT NULL),
n AS (SELECT *, lead(t) OVER w AS nt, lead(scene) OVER w AS ns, lead(k) OVER w AS nk FROM s WINDOW w AS (PARTITION BY video_id ORDER BY asr_id)),
p AS (SELECT video_id, exp(-greatest(nt - t, 0) / 60) AS decay, CASE WHEN scene IS NOT NULL AND ns IS NOT NULL THEN (scene = ns)::INT END AS same,
  CASE WHEN len(list_distinct(k || nk)) > 0 THEN len(list_intersect(k, nk)) / len(list_distinct(k || nk)) END AS o FROM n WHERE nt IS NOT NULL),
q AS (SELECT video_id, (decay + coalesce(same, 0) + coalesce(2 * o, 0)) / (1 + (same IS NOT NULL)::INT + 2 * (o IS NOT NULL)::INT) AS pair FROM p)
SELECT video_id, round(avg(pair), 6) AS linkage, round(min(pair), 6) AS least FROM q GROUP BY 1""")
def speech_linkage(spark: SparkSession, sf: str) -> DataFrame:
    """How well the segments of a video hang together: time, recogniser run, shared words."""
    none = F.array().cast("array<string>")
    s = table(spark, sf, "asr").filter("start_time IS NOT NULL").select("video_id", "asr_id", F.col("start_time").alias("t"), F.col("run_id").alias("scene"), F.coalesce(T.scoring_tokens(F.col("text_raw")), none).alias("tokens"))
    out = sequences.linkage(s, ["video_id"], "asr_id")
    return out.select("video_id", F.round("linkage", 6).alias("linkage"), F.round("least", 6).alias("least"))


@registry(
    """WITH x AS (SELECT query_vec_id, video_id, keyframe_id, result_rank, clip_score, nullif(object_score, 0) AS object_score, interaction_score FROM fused_results WHERE query_vec_id IS NOT NULL),
y AS (SELECT *, round(coalesce(least(greatest((CASE WHEN clip_score IS NOT NULL THEN 1.0 / result_rank ELSE 0 END + CASE WHEN object_score IS NOT NULL THEN 2.0 / result_rank ELSE 0 END)
   / nullif((clip_score IS NOT NULL)::INT + 2 * (object_score IS NOT NULL)::INT, 0), 0), 1), 0), 6) AS multimodal FROM x)
SELECT query_vec_id, video_id, keyframe_id, multimodal, round((0.35 * coalesce(clip_score, 0) + 0.05 * multimodal + 0.25 * interaction_score) / (0.3 + CASE WHEN clip_score IS NULL THEN 0 ELSE 0.35 END), 6) AS final_score FROM y"""
)
def multimodal_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Reciprocal ranks of the modalities that have a score, then the weighted mean of what is known."""
    f = table(spark, sf, "fused_results").filter("query_vec_id IS NOT NULL").withColumn("object_score", F.nullif("object_score", F.lit(0.0)))
    m = sequences.event_score({"clip": F.col("result_rank"), "object": F.col("result_rank")}, {"clip": F.col("clip_score").isNotNull(), "object": F.col("object_score").isNotNull()}, F.lit(0.0))
    d = f.withColumn("multimodal", m)
    final = sequences.weighted_mean({"semantic": F.col("clip_score"), "multimodal": F.col("multimodal"), "temporal": F.col("interaction_score")}, sequences.RERANK_WEIGHTS)
    return d.select("query_vec_id", "video_id", "keyframe_id", "multimodal", F.round(final, 6).alias("final_score"))


@registry(
    _CAND
    + """, m AS (SELECT event_id, video_id, max(v) FILTER (WHERE rank = 1) AS v1, max(v) FILTER (WHERE rank = 2) AS v2, count(*) AS n FROM c GROUP BY ALL),
g AS (SELECT *, (v1 - v2) / greatest(abs(v1), 1e-9) AS margin FROM m)
SELECT event_id, video_id, CASE WHEN n < 2 OR margin < 0.05 THEN 40 WHEN margin >= 0.2 THEN 10 ELSE 20 END AS pool, round(0.35 * least(greatest(coalesce(margin, 0), 0), 1) + 0.25 + 0.25 * 0.25 + 0.15 * 0.4, 6) AS distinctiveness FROM g"""
)
def adaptive_pools(spark: SparkSession, sf: str) -> DataFrame:
    """Pool sizes by how clear the best candidate is; a query of four words with one constraint, all hits in one video."""
    c = _event_candidates(spark, sf)
    best = lambda r: F.max(F.when(F.col("rank") == r, F.col("v")))
    m = c.groupBy("event_id", "video_id").agg(best(1).alias("v1"), best(2).alias("v2"), F.count(F.lit(1)).alias("n"))
    m = m.withColumn("margin", (F.col("v1") - F.col("v2")) / F.greatest(F.abs("v1"), F.lit(1e-9)))
    size = sequences.pool_size(F.lit(4), F.lit(0.9), F.col("n"), F.col("margin"), F.lit(True), 10, 20, 40)
    d = sequences.distinctiveness(F.coalesce("margin", F.lit(0.0)), F.lit(1.0), F.lit(1.0), F.lit(4.0))
    return m.select("event_id", "video_id", size.alias("pool"), F.round(d, 6).alias("distinctiveness"))


@registry("""WITH d AS (SELECT DISTINCT video_id FROM documents WHERE video_id IS NOT NULL), q AS (SELECT video_id, unnest(['asr', 'ocr', 'object']) AS question_type FROM d),
e AS (SELECT video_id, source_type, doc_id, text, row_number() OVER (PARTITION BY video_id, source_type ORDER BY doc_id) AS n FROM documents WHERE regexp_matches(text, '\\S'))
SELECT q.video_id, q.question_type, trim(e.text, ' ') AS answer, e.doc_id FROM q LEFT JOIN e ON q.video_id = e.video_id AND q.question_type = e.source_type AND e.n = 1""")
def evidence_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Per video and kind of question the first evidence that has text."""
    d = table(spark, sf, "documents")
    kinds = F.explode(F.array(*[F.lit(x) for x in ("asr", "ocr", "object")])).alias("question_type")
    q = d.filter("video_id IS NOT NULL").select("video_id").distinct().select("video_id", kinds).withColumn("key", F.concat_ws(":", "video_id", "question_type"))
    e = d.select(F.concat_ws(":", "video_id", "source_type").alias("key"), F.col("source_type").alias("modality"), "text", F.col("doc_id").alias("evidence_order"), F.col("doc_id").alias("evidence_id"))
    a = answers.first_answer(q, e, ["key"])
    return a.select("video_id", "question_type", "answer", F.col("evidence_id").alias("doc_id"))


@registry(
    """WITH a AS (SELECT item_id, suite, expected_answer, expected_video_id, CASE WHEN item_id % 3 <> 0 THEN coalesce(expected_answer, 'x') END AS answer, CASE WHEN item_id % 2 = 0 THEN expected_video_id END AS video_id FROM eval_items)
SELECT suite, count(*) AS questions, round(avg((answer IS NOT NULL)::INT), 6) AS answered, round(avg(coalesce(video_id = expected_video_id, false)::INT) FILTER (WHERE expected_video_id IS NOT NULL), 6) AS video_accuracy,
  round(avg(coalesce(answer = expected_answer, false)::INT) FILTER (WHERE expected_answer IS NOT NULL), 6) AS answer_accuracy FROM a GROUP BY 1"""
)
def answer_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracies of a made-up answerer that leaves every third question open."""
    e = table(spark, sf, "eval_items").withColumns({
        "answer": F.when(F.col("item_id") % 3 != 0, F.coalesce("expected_answer", F.lit("x"))),
        "video_id": F.when(F.col("item_id") % 2 == 0, F.col("expected_video_id")),
    })
    return answers.answer_metrics(e, ["suite"])


@registry(_JUDGE + ", v AS (SELECT query_id, video_id, coalesce(bool_or(g = 1), false) AS good, coalesce(bool_or(g = 0), false) AS bad FROM j GROUP BY ALL) SELECT query_id, video_id, CASE WHEN good THEN 'positive' WHEN bad THEN 'negative' ELSE 'unjudged' END AS label FROM v")
def derived_qrels(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.derived_qrels(_judged(spark, sf), F.col("g") == 1, F.col("g") == 0)


@registry(_JUDGE + ", q AS (SELECT query_id, count(g) AS judged, avg(g) AS quality FROM j GROUP BY 1) SELECT sum(judged)::BIGINT AS judged, round(sum(quality * judged) / sum(judged), 6) AS weighted_quality FROM q")
def weighted_quality(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.weighted_quality(_judged(spark, sf), ["query_id"], F.col("g")).withColumn("weighted_quality", F.round("weighted_quality", 6))


@registry("""WITH h AS (SELECT source_type AS channel, video_id AS query_id FROM documents WHERE video_id IS NOT NULL), t AS (SELECT count(DISTINCT query_id) AS q FROM h)
SELECT channel, count(*) AS hits, count(DISTINCT query_id) AS queries, CASE WHEN count(DISTINCT query_id) = any_value(q) THEN 'READY' ELSE 'DEGRADED' END AS health FROM h, t GROUP BY 1""")
def channel_health(spark: SparkSession, sf: str) -> DataFrame:
    """Each kind of text as a channel over all videos."""
    h = table(spark, sf, "documents").filter("video_id IS NOT NULL").select(F.col("source_type").alias("channel"), F.col("video_id").alias("query_id"))
    return evaluate.channel_counts(h)


@registry("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
b AS (SELECT event_type, 'all' AS runs, value FROM r UNION ALL SELECT event_type, 'warm', value FROM r WHERE n > 1),
l AS (SELECT event_type, runs, count(*) AS n, list_sort(list(value)) AS v, avg(value) AS m FROM b GROUP BY ALL)
SELECT event_type, runs, n, v[round_even((n - 1) * 0.5, 0)::BIGINT + 1] AS p50, v[round_even((n - 1) * 0.95, 0)::BIGINT + 1] AS p95, round(m, 6) AS mean FROM l""")
def latency_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Values of the event log as run times, with and without each type's first."""
    return evaluate.latency_profile(table(spark, sf, "events").select("event_type", "event_id", "value"), ["event_type"], "event_id", "value").withColumn("mean", F.round("mean", 6))


@registry("""WITH p AS (SELECT unnest([0.0, 0.02, 0.05, 0.1]) AS w), s AS (SELECT w, query_vec_id, row_number() OVER (PARTITION BY w, query_vec_id ORDER BY round(clip_score + w * object_score, 9) DESC NULLS LAST, baseline_rank, video_id, keyframe_id) AS r,
  baseline_rank FROM fused_results, p),
f AS (SELECT w, query_vec_id, 1.0 / min(r) FILTER (WHERE baseline_rank <= 3) AS rr FROM s GROUP BY ALL)
SELECT w AS weight, round(avg(coalesce(rr, 0)), 6) AS mrr FROM f GROUP BY 1 ORDER BY round(avg(coalesce(rr, 0)), 9) DESC, weight LIMIT 1""")
def tuned_weight(spark: SparkSession, sf: str) -> DataFrame:
    """Grid search over the object weight; the first three of the baseline are relevant. The grid is four values."""
    f = table(spark, sf, "fused_results").withColumn("weight", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.02, 0.05, 0.1)])))
    order = [ranking.by_score(F.col("clip_score") + F.col("weight") * F.col("object_score")), F.col("baseline_rank"), F.col("video_id"), F.col("keyframe_id")]
    r = ranking.rank_by(f, ["weight", "query_vec_id"], order, "r")
    rr = r.groupBy("weight", "query_vec_id").agg(F.coalesce(1.0 / F.min(F.when(F.col("baseline_rank") <= 3, F.col("r"))), F.lit(0.0)).alias("mrr"))
    return evaluate.tuned(rr, ["weight"], "mrr", [F.col("weight")]).withColumn("mrr", F.round("mrr", 6))


@registry("""WITH s AS (SELECT video_id, asr_id, segment_id, start_time AS t FROM asr WHERE start_time IS NOT NULL), g AS (SELECT video_id, asr_id, segment_id, coalesce(t - lag(t) OVER (PARTITION BY video_id ORDER BY segment_id, asr_id) <= 0, false) AS back FROM s)
SELECT video_id, NOT bool_or(back) AS forward, bool_or(segment_id = 0) AS has_first FROM g GROUP BY 1""")
def speech_order(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each video's segments move forward in time, and whether the first one is there."""
    s = table(spark, sf, "asr").filter("start_time IS NOT NULL").select("video_id", F.col("start_time").alias("t"), F.struct("segment_id", "asr_id").alias("o"), F.col("segment_id").cast("string").alias("event_id"), F.col("video_id").alias("chain"))
    v = sequences.valid_paths(s, ["chain"], "o", ["0"])
    return v.select(F.col("chain").alias("video_id"), "forward", F.col("complete").alias("has_first"))


@registry("""WITH g AS (SELECT video_id, start_time - lag(start_time) OVER (PARTITION BY video_id ORDER BY start_time, asr_id) AS gap FROM asr WHERE start_time IS NOT NULL)
SELECT video_id, CASE WHEN max(gap) <= 60 THEN 'short' WHEN max(gap) <= 300 THEN 'medium' WHEN max(gap) IS NOT NULL THEN 'long' END AS widest FROM g GROUP BY 1""")
def speech_gap_classes(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("start_time", "asr_id")
    g = table(spark, sf, "asr").filter("start_time IS NOT NULL").withColumn("gap", F.col("start_time") - F.lag("start_time").over(w))
    return g.groupBy("video_id").agg(planner.gap_class(F.max("gap")).alias("widest"))


_PATHS = _ALL + """, w AS (SELECT a.video_id, a.candidate_id::VARCHAR AS x, b.candidate_id::VARCHAR AS y, d.candidate_id::VARCHAR AS z, -a.s - b.s - d.s AS neg, a.t AS first_t, d.t AS last_t
  FROM c a JOIN c b ON a.video_id = b.video_id AND a.event_id = 'view' AND b.event_id = 'click' AND {0} JOIN c d ON a.video_id = d.video_id AND d.event_id = 'purchase' AND {1})
SELECT video_id, x || '>' || y || '>' || z AS path, round(-neg, 6) AS total, round(first_t, 6) AS first_t, round(last_t, 6) AS last_t FROM w QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY {2}, x, y, z) = 1"""


@registry(_PATHS.format("b.t > a.t AND b.t - a.t BETWEEN 60 AND 86400", "d.t > b.t AND d.t - b.t BETWEEN 60 AND 86400", "round(neg, 12)"))
def feasible_witnesses(spark: SparkSession, sf: str) -> DataFrame:
    """The best path view, click, purchase of each user, each step between a minute and a day after the one before."""
    w = temporal.witnesses(_event_candidates(spark, sf, None).withColumn("local_score", F.round("local_score", 12)), EVENTS, 60.0, 86400.0)
    return w.select("video_id", "path", F.round("total", 6).alias("total"), F.round("first_t", 6).alias("first_t"), F.round("last_t", 6).alias("last_t"))


@registry(
    _CAND
    + """, p AS (SELECT a.video_id, a.candidate_id::VARCHAR AS x, b.candidate_id::VARCHAR AS y, (b.t - a.t > 86400)::INT AS g, a.candidate_id % 30 = b.candidate_id % 30 AS same, abs(a.candidate_id % 3 + b.candidate_id % 3) AS pr, a.s + b.s AS s, (a.candidate_id % 50 = 0 OR b.candidate_id % 50 = 0) AS off
  FROM c a JOIN c b ON a.video_id = b.video_id AND a.event_id = 'view' AND b.event_id = 'click' AND b.t > a.t),
z AS (SELECT video_id, x || '>' || y AS path, 4.0 + s + 0.03 * pr - 0.25 * g - same::INT AS score, g, off, x, y FROM p)
SELECT video_id, path, round(score, 6) AS score, g AS gap_violations, off AS mapping_mismatch, row_number() OVER (PARTITION BY video_id ORDER BY round(score, 9) DESC, x, y) AS rank FROM z QUALIFY rank <= 5"""
)
def legacy_chains(spark: SparkSession, sf: str) -> DataFrame:
    """View, then click within a day, of the best eight of each user (so that the beam of a hundred holds all pairs); ids stand for frames and provenance."""
    i = F.col("candidate_id")
    c = _event_candidates(spark, sf).withColumns({"keyframe_id": i % 30, "provenance": (i % 3).cast("int"), "frame_seconds": F.when(i % 50 == 0, F.col("t") + 2.0).otherwise(F.col("t"))})
    return sequences.legacy_chains(c, ["view", "click"], most_gap=86400.0).withColumn("score", F.round("score", 6))


@registry(
    _CAND
    + """, b AS (SELECT video_id, event_id, max(s) AS s FROM c GROUP BY ALL),
cov AS (SELECT video_id, count(*) FILTER (WHERE event_id IN ('view', 'click')) AS rf, count(*) FILTER (WHERE event_id = 'purchase') AS opt, coalesce(max(s) FILTER (WHERE event_id = 'click'), 0) AS a, sum(s) AS t FROM b GROUP BY 1),
p AS (SELECT a.video_id, a.candidate_id::VARCHAR AS x, d.candidate_id::VARCHAR AS y, 4.0 + a.s + d.s AS score FROM c a JOIN c d ON a.video_id = d.video_id AND a.event_id = 'view' AND d.event_id = 'click' AND d.t > a.t),
o AS (SELECT video_id FROM cov WHERE rf = 2 AND video_id IN (SELECT video_id FROM p) ORDER BY opt DESC, round(a, 9) DESC, round(t, 9) DESC, video_id LIMIT 1)
SELECT video_id, x || '>' || y AS path, round(score, 6) AS score FROM p JOIN o USING (video_id) QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, x, y) = 1"""
)
def chosen_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The first complete and feasible user, and the best chain of theirs: the contract of one video."""
    c = _event_candidates(spark, sf)
    full = c.withColumns({"keyframe_id": F.col("candidate_id"), "provenance": F.lit(0), "frame_seconds": F.lit(None).cast("double")})
    chains = sequences.legacy_chains(full, ["view", "click"])
    out = sequences.chosen_chain(sequences.video_coverage(c, ["view", "click"], ["purchase"], "click"), temporal.feasible(c, ["view", "click"]), chains)
    return out.select("video_id", "path", F.round("score", 6).alias("score"))


@registry(_CAND + """, p AS (SELECT a.video_id, a.candidate_id::VARCHAR AS x, d.candidate_id::VARCHAR AS y, 4.0 + a.s + d.s AS score FROM c a JOIN c d ON a.video_id = d.video_id AND a.event_id = 'view' AND d.event_id = 'click' AND d.t > a.t),
m AS (SELECT video_id, x || '>' || y AS path, score FROM p QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY round(score, 9) DESC, x, y) = 1)
SELECT video_id, path, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, video_id) AS video_rank FROM m QUALIFY video_rank <= 20""")
def best_chain_videos(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty users with the best chains (a top-k report)."""
    c = _event_candidates(spark, sf).withColumns({"keyframe_id": F.col("candidate_id"), "provenance": F.lit(0), "frame_seconds": F.lit(None).cast("double")})
    return sequences.best_videos(sequences.legacy_chains(c, ["view", "click"])).withColumn("score", F.round("score", 6))
