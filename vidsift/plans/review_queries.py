"""Chosen and judged frames, chains, answers, ablations, audits, label and text forms over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidsift.functions import text as T
from vidsift.functions.vectors import usable
from vidsift.operators import answers, audit, candidates, colors, corpus, evaluate, fusion, localise, ranking, review, sequences, temporal, vector
from vidsift.plans import payloads
from vidsift.plans.evidence_queries import _ALL, _CHANNELS, _OK, _candidates, _event_candidates
from vidsift.plans.vector_queries import _FRAMES, _TWO, _USABLE, _two_channels, frame_hits
from vidsift.registry import Registry
from vidsift.sources.tables import table

registry = Registry()
r6 = lambda c: F.round(c, 6)


@registry("""WITH l AS (SELECT DISTINCT label_raw FROM detections WHERE label_raw IS NOT NULL), f AS (SELECT label_raw, trim(regexp_replace(lower(strip_accents(label_raw)), '[^a-z0-9]+', ' ', 'g')) AS folded FROM l)
SELECT label_raw, folded, CASE WHEN folded IN ('mobile phone', 'telephone', 'phone', 'cell phone', 'ien thoai', 'dien thoai') THEN 'phone' WHEN folded IN ('car', 'automobile', 'o to', 'xe hoi') THEN 'car'
  WHEN folded IN ('vehicle', 'land vehicle', 'xe') THEN 'vehicle' WHEN folded IN ('motorcycle', 'motorbike', 'xe may') THEN 'motorcycle'
  WHEN folded IN ('computer monitor', 'television', 'tv', 'screen', 'man hinh') THEN 'screen' WHEN folded IN ('human hand', 'human arm', 'hand', 'ban tay') THEN 'hand'
  WHEN folded IN ('person', 'man', 'woman', 'boy', 'girl', 'nguoi') THEN 'person' ELSE replace(folded, ' ', '_') END AS alias FROM f""")
def label_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every label as it is folded, and its common name."""
    d = table(spark, sf, "detections").select("label_raw").filter("label_raw IS NOT NULL").distinct()
    return d.withColumn("folded", T.label_fold(F.col("label_raw"))).withColumn("alias", T.object_alias(F.col("folded")))


@registry("""SELECT item_id, strip_accents(replace(trim(regexp_replace(regexp_replace(lower(nfc_normalize(query_text)), '[ \\t]+', ' ', 'g'), '\\n{3,}', E'\\n\\n', 'g')), 'đ', 'd')) AS search_form,
  trim(regexp_replace(strip_accents(lower(query_text)), '\\s+', ' ', 'g')) AS event_form FROM eval_items""")
def query_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Queries as metadata search and as the moments' rules see them: the first takes đ for d, the second doesn't."""
    q = F.col("query_text")
    return table(spark, sf, "eval_items").select("item_id", T.search_fold(q).alias("search_form"), T.event_fold(q).alias("event_form"))


@registry("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def parsed_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's day, written in one of the five formats and read back."""
    o = table(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.date_format("d", "d/M/yyyy")).when(k == 1, F.date_format("d", "yyyy-MM-dd")).when(k == 2, F.date_format("d", "dd-MM-yyyy")).when(k == 3, F.date_format("d", "yyyyMMdd")).otherwise(F.date_format("d", "dd/MM/yyyy"))
    return o.select("o_orderkey", T.parse_date(text).alias("day"))


@registry("""WITH r AS (SELECT video_id, pts_time, min(keyframe_id) AS keyframe_id FROM keyframes WHERE pts_time IS NOT NULL AND keyframe_id IS NOT NULL GROUP BY ALL),
i AS (SELECT video_id, pts_time, keyframe_id, min(frame_idx) AS frame_idx FROM keyframes WHERE pts_time IS NOT NULL GROUP BY ALL), v AS (SELECT video_id, max(fps) AS fps FROM keyframes GROUP BY 1),
n AS (SELECT asr_id, r.keyframe_id, i.frame_idx + (start_time - r.pts_time) * fps AS f FROM asr JOIN r USING (video_id) JOIN i ON i.video_id = r.video_id AND i.pts_time = r.pts_time AND i.keyframe_id = r.keyframe_id JOIN v ON v.video_id = r.video_id WHERE abs(r.pts_time - start_time) <= 5
  QUALIFY row_number() OVER (PARTITION BY asr_id ORDER BY abs(r.pts_time - start_time), r.keyframe_id) = 1)
SELECT asr_id, keyframe_id AS keyframe, greatest(round_even(f, 0), 0)::BIGINT AS frame FROM n WHERE f IS NOT NULL""")
def speech_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The frame number of each segment's start: the nearest keyframe's, and the rest of the time at the video's rate."""
    k = table(spark, sf, "keyframes")
    once = k.filter("pts_time IS NOT NULL AND keyframe_id IS NOT NULL").groupBy(F.col("video_id").alias("entity"), F.col("pts_time").alias("t")).agg(F.min(F.struct("keyframe_id", "frame_idx")).alias("m"))
    rate = k.groupBy(F.col("video_id").alias("entity")).agg(F.max("fps").alias("fps"))
    refs = once.select("entity", "t", F.col("m.keyframe_id").cast("long").alias("ref"), F.col("m.frame_idx").alias("frame_idx")).join(rate, "entity")
    points = table(spark, sf, "asr").select(F.col("video_id").alias("entity"), F.col("asr_id").alias("id"), F.col("start_time").alias("t"))
    near = temporal.asof_nearest(points, refs.select("entity", "t", "ref"), 5.0).join(points.select("id", "t"), "id")
    j = near.join(refs.withColumnRenamed("t", "rt"), ["entity", "ref"]).filter("abs(t - rt) <= distance + 1e-9")
    at = F.col("frame_idx") + (F.col("t") - F.col("rt")) * F.col("fps")
    return j.filter(at.isNotNull()).select(F.col("id").alias("asr_id"), F.col("ref").cast("int").alias("keyframe"), F.greatest(F.bround(at, 0), F.lit(0.0)).cast("long").alias("frame"))


@registry("""WITH a AS (SELECT item_id, trim(lower(nfc_normalize(expected_answer)), ' .,:;!?…') AS c FROM eval_items WHERE expected_answer IS NOT NULL)
SELECT item_id, array_to_string(list_filter([CASE WHEN replace(strip_accents(c), 'đ', 'd') <> c THEN replace(strip_accents(c), 'đ', 'd') END,
  CASE c WHEN 'đỏ' THEN 'red' WHEN 'xanh' THEN 'blue|green' WHEN 'trắng' THEN 'white' WHEN 'đen' THEN 'black' WHEN 'vàng' THEN 'yellow' WHEN 'hồng' THEN 'pink' WHEN 'red' THEN 'đỏ' WHEN 'blue' THEN 'xanh' WHEN 'green' THEN 'xanh'
    WHEN 'white' THEN 'trắng' WHEN 'black' THEN 'đen' WHEN 'yellow' THEN 'vàng' WHEN 'pink' THEN 'hồng' END], lambda x: x IS NOT NULL), '|') AS alternatives FROM a""")
def answer_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Other accepted spellings of each expected answer."""
    a = table(spark, sf, "eval_items").filter("expected_answer IS NOT NULL")
    return a.select("item_id", F.array_join(T.answer_alternatives(T.answer_canonical(F.col("expected_answer"))), "|").alias("alternatives"))


@registry("""WITH x AS (SELECT item_id, CASE item_id % 7 WHEN 0 THEN 'NEEDS_EVIDENCE' ELSE 'READY' END AS state, CASE WHEN item_id % 5 <> 0 THEN coalesce(expected_answer, 'x') END AS answer, item_id % 3 AS n, item_id % 4 AS k FROM eval_items)
SELECT item_id, CASE WHEN state = 'NEEDS_EVIDENCE' THEN 'state' WHEN answer IS NULL OR answer = '' THEN 'no_answer' WHEN n = 0 THEN 'nothing_selected' WHEN k = 0 THEN 'evidence_not_selected' WHEN k = 1 THEN 'speech_needs_asr' ELSE 'ok' END AS verdict FROM x""")
def confirmation_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up reviews of the evaluation items through the guard before confirmation."""
    i = F.col("item_id")
    one, none = F.array(F.lit("e1")), F.array().cast("array<string>")
    verdict = answers.guard(F.when(i % 7 == 0, "NEEDS_EVIDENCE").otherwise("READY"), F.when(i % 5 != 0, F.coalesce("expected_answer", F.lit("x"))), F.when(i % 3 == 0, none).otherwise(one), F.when(i % 4 == 0, F.array(F.lit("e9"))).otherwise(one), F.when(i % 4 == 1, "asr").otherwise("ocr"), F.array(F.lit("ocr")))
    return table(spark, sf, "eval_items").select("item_id", verdict.alias("verdict"))


@registry("SELECT query_vec_id, count(DISTINCT video_id) = 1 AND count(*) FILTER (WHERE video_id IS NULL) = 0 AS one_video FROM fused_results GROUP BY 1")
def selection_videos(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each query's stored results lie in one video."""
    return answers.one_video(table(spark, sf, "fused_results"), ["query_vec_id"])


@registry(
    _ALL
    + """, ev AS (SELECT video_id, event_id, max(s) AS s, count(*) AS n FROM c GROUP BY ALL),
dv AS (SELECT *, CASE event_id WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS o, round(0.35 * least(n / 20.0, 1) + 0.25 * 1 + 0.25 * 0.25 + 0.15 * 0.4, 9) AS q FROM ev WHERE event_id IN ('view', 'click', 'purchase'))
SELECT video_id, event_id FROM dv WHERE event_id <> 'purchase' QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY q DESC, round(s, 9) DESC, o, event_id) = 1"""
)
def event_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """The event each user's sequence is built around: required, most distinct, best, first."""
    c = _event_candidates(spark, sf, None).filter(F.col("event_id").isin("view", "click", "purchase"))
    e = c.groupBy(F.col("video_id").alias("request_id"), "event_id").agg(F.max("local_score").alias("local_score"), F.count(F.lit(1)).alias("n"))
    order = F.when(F.col("event_id") == "view", 1).when(F.col("event_id") == "click", 2).otherwise(3)
    d = e.withColumns({"event_order": order, "required": F.col("event_id") != "purchase", "distinctiveness": sequences.distinctiveness(F.col("n") / 20.0, F.lit(1.0), F.lit(1.0), F.lit(4.0))})
    return sequences.anchor(d).select(F.col("request_id").alias("video_id"), "event_id")


@registry("""WITH c AS (SELECT query_vec_id, video_id, count(*) AS n, sum(clip_score) AS s, sum(len(matched_rules)) AS p, count(*) FILTER (WHERE object_score = 0) AS g, count(*) - count(DISTINCT keyframe_id) AS d FROM fused_results WHERE query_vec_id IS NOT NULL GROUP BY ALL)
SELECT query_vec_id, video_id, round(2.0 * least(n, 2) + 0.5 * greatest(n - 2, 0) + coalesce(s, 0) + 0.03 * coalesce(p, 0) - 0.25 * g - 0.15 * (n < 2)::INT - 1.0 * d, 6) AS score FROM c""")
def chain_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Each query's results of a video as a chain: two required events, the others optional."""
    f = table(spark, sf, "fused_results").filter("query_vec_id IS NOT NULL").groupBy("query_vec_id", "video_id")
    c = f.agg(F.count(F.lit(1)).alias("n"), F.sum("clip_score").alias("s"), F.sum(F.size("matched_rules")).alias("p"), F.count_if(F.col("object_score") == 0).alias("g"), (F.count(F.lit(1)) - F.count_distinct("keyframe_id")).alias("d"))
    n = F.col("n")
    score = sequences.chain_score(F.least(n, F.lit(2)), F.greatest(n - 2, F.lit(0)), F.coalesce("s", F.lit(0.0)), F.coalesce("p", F.lit(0)), F.col("g"), (n < 2).cast("int"), F.col("d"))
    return c.select("query_vec_id", "video_id", r6(score).alias("score"))


@registry("""WITH x AS (SELECT query_vec_id, video_id, keyframe_id, clip_score AS a, interaction_score AS b, CASE WHEN len(matched_rules) > 0 THEN least(object_score, 1) END AS c FROM fused_results WHERE query_vec_id IS NOT NULL AND clip_score IS NOT NULL),
y AS (SELECT query_vec_id, video_id || ':' || keyframe_id AS path, (0.35 * a + 0.25 * b + CASE WHEN c IS NULL THEN 0 ELSE 0.05 * c END) / (0.6 + CASE WHEN c IS NULL THEN 0 ELSE 0.05 END) AS s FROM x)
SELECT query_vec_id, path, round(s, 6) AS final_score, row_number() OVER (PARTITION BY query_vec_id ORDER BY round(s, 9) DESC, path) AS rank FROM y""")
def reranked_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Stored results as chains of one frame, by the weighted mean of what is known; those without similarity are incomplete."""
    f = table(spark, sf, "fused_results").filter("query_vec_id IS NOT NULL").dropDuplicates(["query_vec_id", "video_id", "keyframe_id", "result_rank"])
    none = F.lit(None).cast("double")
    d = f.select("query_vec_id", F.concat_ws(":", "video_id", F.col("keyframe_id").cast("string")).alias("path"), F.col("clip_score").alias("semantic"), F.col("interaction_score").alias("temporal"), none.alias("linkage"), none.alias("context"), F.when(F.size("matched_rules") > 0, F.least("object_score", F.lit(1.0))).alias("multimodal"), none.alias("coverage"), F.col("clip_score").isNotNull().alias("complete"))
    return sequences.rerank_chains(d, ["query_vec_id"]).select("query_vec_id", "path", r6("final_score").alias("final_score"), "rank")


@registry(_CHANNELS + """, a AS (SELECT DISTINCT video_id FROM assets), q2 AS (SELECT query_id, video_id FROM q, a), b AS (SELECT video_id, arg_min(keyframe_id, (coalesce(-confidence, 1), keyframe_id)) AS keyframe_id FROM ocr WHERE keyframe_id IS NOT NULL GROUP BY 1)
SELECT query_id, video_id, keyframe_id, true AS representative_only FROM q2 ANTI JOIN w USING (query_id, video_id) LEFT JOIN b USING (video_id)""")
def fallback_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Registered videos without a candidate frame get their most confidently read frame, without a rank."""
    c = _candidates(spark, sf).select("query_id", "video_id").distinct()
    videos = c.select("query_id").distinct().crossJoin(table(spark, sf, "assets").select("video_id").distinct())  # the stated query set times the registered videos
    best = table(spark, sf, "ocr").filter("keyframe_id IS NOT NULL").groupBy("video_id").agg(F.min(F.struct(F.coalesce(-F.col("confidence"), F.lit(1.0)).alias("c"), "keyframe_id")).alias("b")).select("video_id", F.col("b.keyframe_id").alias("keyframe_id"))
    one = best.join(c.select("query_id").distinct(), how="cross").select("query_id", "video_id", "keyframe_id")
    return candidates.fallback_frames(videos, c, one).select("query_id", "video_id", "keyframe_id", "representative_only")


@registry(_CHANNELS + f""", k AS (SELECT DISTINCT video_id, keyframe_id FROM keyframes WHERE object_status = 'AVAILABLE')
SELECT query_id, video_id, keyframe_id, CASE WHEN clip_rank IS NOT NULL THEN 'matched' ELSE 'not_matched' END AS clip_state,
  CASE WHEN object_rank IS NOT NULL THEN 'matched' WHEN (video_id, keyframe_id) IN (SELECT (video_id, keyframe_id) FROM k) THEN 'not_matched' ELSE 'unknown' END AS object_state, 'disabled' AS ocr_state FROM w""")
def evidence_states(spark: SparkSession, sf: str) -> DataFrame:
    """What each modality says of a candidate frame; an untested frame is unknown, never a negative."""
    ready = table(spark, sf, "keyframes").filter("object_status = 'AVAILABLE'").select("video_id", "keyframe_id").distinct().withColumn("tested", F.lit(True))
    c = _candidates(spark, sf).join(ready, ["video_id", "keyframe_id"], "left")
    s = candidates.evidence_states(c, {"ocr": False}, {"object": F.col("tested")})
    return s.select("query_id", "video_id", "keyframe_id", "clip_state", "object_state", "ocr_state")


@registry("""WITH p AS (SELECT video_id, keyframe_id, unnest([(0, floor(least(greatest(center_x, 0), 1) * 255)), (1, floor(least(greatest(center_y, 0), 1) * 255)), (2, floor(least(greatest(bbox_y1, 0), 1) * 255))]) AS x FROM detections),
n AS (SELECT video_id, keyframe_id, count(*) AS n FROM detections GROUP BY ALL), h AS (SELECT video_id, keyframe_id, x[1] AS c, least(floor(x[2] / 31.875), 7) AS b, count(*) AS k FROM p WHERE x[2] IS NOT NULL GROUP BY ALL),
d AS (SELECT video_id, keyframe_id, c, b, k / n / 31.875 AS v FROM h JOIN n USING (video_id, keyframe_id)), l AS (SELECT video_id, keyframe_id, sqrt(sum(v * v)) AS l FROM d GROUP BY ALL)
SELECT video_id, keyframe_id, c::INTEGER AS channel, b::INTEGER AS bin, round(v / l, 6) AS value FROM d JOIN l USING (video_id, keyframe_id) WHERE v > 0""")
def pixel_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Histogram signatures per frame, their bins that aren't empty; box positions stand for pixels, as the tables hold no images."""
    c = lambda n: F.floor(F.least(F.greatest(F.col(n), F.lit(0.0)), F.lit(1.0)) * 255)
    p = table(spark, sf, "detections").select("video_id", "keyframe_id", c("center_x").alias("red"), c("center_y").alias("green"), c("bbox_y1").alias("blue"))
    s = colors.signatures(p, ["video_id", "keyframe_id"]).select("video_id", "keyframe_id", F.posexplode("signature").alias("at", "value")).filter("value > 0")
    return s.select("video_id", "keyframe_id", F.floor(F.col("at") / 8).cast("int").alias("channel"), (F.col("at") % 8).cast("int").alias("bin"), r6("value").alias("value"))


@registry("""SELECT video_id, keyframe_id, frame_idx, count(*) - 1 AS times FROM keyframes GROUP BY ALL HAVING count(*) > 1""")
def rerun_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that only one of two runs has: the delivered frames against the same without repeats."""
    k = table(spark, sf, "keyframes").select("video_id", "keyframe_id", "frame_idx")
    return evaluate.same_results(k, k.distinct()).filter("side = 'first'").groupBy("video_id", "keyframe_id", "frame_idx").agg(F.count(F.lit(1)).alias("times"))


@registry("""WITH c AS (SELECT 'assets' AS name, count(DISTINCT video_id) AS found, 5 AS expected FROM assets UNION ALL SELECT 'keyframes', count(*), 1000000000 FROM keyframes UNION ALL SELECT 'nothing', 0, 1)
SELECT name, found, expected::BIGINT AS expected, CASE WHEN found >= expected THEN 'OK' WHEN found = 0 THEN 'MISSING' ELSE 'WARNING' END AS status FROM c""")
def preflight(spark: SparkSession, sf: str) -> DataFrame:
    """Whether tables reach what a profile expects of them."""
    count = lambda name, df, n: df.select(F.lit(name).alias("name"), F.col("n").alias("found"), F.lit(n).cast("long").alias("expected"))
    a = table(spark, sf, "assets").agg(F.count_distinct("video_id").alias("n"))
    k = table(spark, sf, "keyframes").agg(F.count(F.lit(1)).alias("n"))
    none = table(spark, sf, "assets").filter("false").agg(F.count(F.lit(1)).alias("n"))
    return audit.minimum_status(count("assets", a, 5).unionByName(count("keyframes", k, 10**9)).unionByName(count("nothing", none, 1)))


@registry("SELECT source_type, count(keyframe_id) AS kept, count(*) FILTER (WHERE keyframe_id IS NULL) AS skipped FROM documents GROUP BY 1")
def frame_addressable_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each kind that name a frame, and those that can't be aligned in time."""
    return review.skipped_hits(table(spark, sf, "documents"), ["source_type"])


@registry("""WITH r AS (SELECT item_id AS request_id, expected_video_id AS video_id, CASE WHEN item_id % 3 = 0 THEN NULL ELSE (item_id % 40)::INTEGER END AS keyframe_id FROM eval_items WHERE expected_video_id IS NOT NULL),
f AS (SELECT video_id, min(keyframe_id) AS f FROM keyframes GROUP BY 1), k AS (SELECT DISTINCT video_id, keyframe_id FROM keyframes)
SELECT request_id, r.video_id, k.keyframe_id, CASE WHEN k.keyframe_id IS NULL THEN 'NOT_IN_INDEX' ELSE 'SELECTED' END AS status FROM r LEFT JOIN f USING (video_id) LEFT JOIN k ON k.video_id = r.video_id AND k.keyframe_id = coalesce(r.keyframe_id, f.f)""")
def selected_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up choices of a frame of each item's video; every third leaves the frame open."""
    i = F.col("item_id")
    asked = table(spark, sf, "eval_items").filter("expected_video_id IS NOT NULL").select(i.alias("request_id"), F.col("expected_video_id").alias("video_id"), F.when(i % 3 != 0, (i % 40).cast("int")).alias("keyframe_id"))
    return review.selected_frames(asked, table(spark, sf, "keyframes"))


@registry(f"""WITH j AS (SELECT query_vec_id AS query_id, result_rank AS rank, video_id, keyframe_id, CASE WHEN clip_score >= 0.6 THEN 'good' WHEN clip_score >= 0.4 THEN 'partial' ELSE 'bad' END AS judgement FROM fused_results WHERE clip_score IS NOT NULL),
d AS (SELECT video_id, keyframe_id, label_raw AS label, confidence, row_number() OVER (PARTITION BY video_id, keyframe_id ORDER BY confidence DESC, label_raw, detection_id) AS object_rank FROM detections WHERE {_OK} AND label_raw IS NOT NULL QUALIFY object_rank <= 8)
SELECT query_id, rank, judgement, j.video_id, j.keyframe_id, object_rank, label, confidence FROM j LEFT JOIN d USING (video_id, keyframe_id) WHERE judgement <> 'good'""")
def judged_objects(spark: SparkSession, sf: str) -> DataFrame:
    """The eight best objects of frames that were judged bad or partly right."""
    c = F.col("clip_score")
    j = table(spark, sf, "fused_results").filter(c.isNotNull()).select(F.col("query_vec_id").alias("query_id"), F.col("result_rank").alias("rank"), "video_id", "keyframe_id", F.when(c >= 0.6, "Good").when(c >= 0.4, " partial").otherwise("bad").alias("judgement"))
    return review.judged_objects(j, table(spark, sf, "detections"), ["bad", "partial"])


@registry("""WITH f AS (SELECT query_vec_id, list(clip_score ORDER BY result_rank, video_id, keyframe_id)[1:2] AS s, list(interaction_score ORDER BY result_rank, video_id, keyframe_id)[1:3] AS l, min(object_score) AS c FROM fused_results WHERE query_vec_id IS NOT NULL GROUP BY 1)
SELECT query_vec_id, concat_ws(',', CASE WHEN len(s) = 2 AND s[1] IS NOT NULL AND s[2] IS NOT NULL AND s[1] - s[2] <= 0.05 THEN 'SMALL_TOP1_TOP2_MARGIN' END, CASE WHEN len(list_filter(l, lambda x: x < 0.4)) > 0 THEN 'LOW_LINKAGE' END,
  CASE WHEN c < 0.7 THEN 'LOW_EVENT_CONFIDENCE' END, CASE WHEN query_vec_id % 2 = 0 THEN 'OOD_EVENT' END) AS reasons FROM f""")
def review_triggers(spark: SparkSession, sf: str) -> DataFrame:
    """Why stored results deserve a closer look; interaction stands for linkage, object scores for the events' confidence."""
    f = table(spark, sf, "fused_results").filter("query_vec_id IS NOT NULL")
    row = F.array_sort(F.collect_list(F.struct("result_rank", "video_id", "keyframe_id", "clip_score", "interaction_score", "object_score")))
    g = f.groupBy("query_vec_id").agg(row.alias("r"))
    reasons = review.trigger_reasons(F.transform("r", lambda x: x["clip_score"]), F.transform("r", lambda x: x["interaction_score"]), F.transform("r", lambda x: x["object_score"]), F.col("query_vec_id") % 2 == 0)
    return g.select("query_vec_id", F.array_join(reasons, ",").alias("reasons"))


@registry("""WITH f AS (SELECT DISTINCT query_vec_id, video_id, keyframe_id, result_rank FROM fused_results WHERE query_vec_id IS NOT NULL), k AS (SELECT video_id, keyframe_id, min(pts_time) AS t FROM keyframes WHERE pts_time IS NOT NULL GROUP BY ALL),
s AS (SELECT query_vec_id, video_id, keyframe_id, result_rank, t, t <= lag(t) OVER (PARTITION BY query_vec_id, video_id ORDER BY result_rank) AS back FROM f JOIN k USING (video_id, keyframe_id)),
c0 AS (SELECT query_vec_id, video_id, min(result_rank) AS rank FROM f GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY query_vec_id ORDER BY rank, video_id) AS n FROM c0 QUALIFY n <= 3),
o AS (SELECT query_vec_id, video_id FROM s GROUP BY ALL HAVING NOT coalesce(bool_or(back), false))
SELECT query_vec_id, video_id, result_rank::BIGINT AS event_order, round(t, 6) AS t FROM s JOIN c USING (query_vec_id, video_id) JOIN o USING (query_vec_id, video_id)""")
def shown_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Each query's results of a video as a chain; of the first three those that move strictly forward in time."""
    f = table(spark, sf, "fused_results").filter("query_vec_id IS NOT NULL").select("query_vec_id", "video_id", "keyframe_id", "result_rank").distinct()
    k = table(spark, sf, "keyframes").filter("pts_time IS NOT NULL").groupBy("video_id", "keyframe_id").agg(F.min("pts_time").alias("t"))
    chain = [F.col("query_vec_id").alias("request_id"), F.col("video_id").alias("chain_id")]
    chains = f.groupBy("query_vec_id", "video_id").agg(F.min("result_rank").alias("rank")).select(*chain, "rank")
    steps = f.join(k, ["video_id", "keyframe_id"]).select(*chain, F.lit("e").alias("event_id"), F.col("result_rank").cast("long").alias("event_order"), "video_id", "t")
    return review.safe_chains(chains, steps, []).select(F.col("request_id").alias("query_vec_id"), "video_id", "event_order", r6("t").alias("t"))


@registry("""SELECT query_id, expected_video_id AS video_id, item_id % 50 AS frame_id, expected_answer AS answer, item_id::VARCHAR AS export_id, query_text AS question, split FROM eval_items WHERE suite = 'qa' AND expected_answer IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY query_id, expected_video_id, item_id % 50 ORDER BY item_id DESC) = 1""")
def answer_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with an answer as confirmed exports."""
    e = table(spark, sf, "eval_items").filter("suite = 'qa' AND expected_answer IS NOT NULL")
    x = e.select(F.col("item_id").alias("export_id"), "query_id", F.col("expected_video_id").alias("video_id"), (F.col("item_id") % 50).alias("frame_id"), F.col("expected_answer").alias("answer"), F.col("query_text").alias("question"), F.create_map(F.lit("split"), F.col("split"), F.lit("empty"), F.lit(None).cast("string")).alias("metadata"), F.col("item_id").alias("exported_at"))
    m = F.col("metadata")
    return review.export_candidates(x).select("query_id", "video_id", "frame_id", "answer", m["export_id"].alias("export_id"), m["question"].alias("question"), m["split"].alias("split"))


@registry("""SELECT DISTINCT video_id, concat_ws(',', CASE WHEN video_path <> '' THEN 'watch_url' END, CASE WHEN media_info_path <> '' THEN 'title' END, CASE WHEN video_group <> '' THEN 'author' END) AS fields FROM assets""")
def clean_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Which allowed fields of each registered video hold something."""
    m = F.create_map(F.lit("author"), F.col("video_group"), F.lit("title"), F.col("media_info_path"), F.lit("watch_url"), F.col("video_path"), F.lit("secret"), F.lit("x"), F.lit("keywords"), F.lit("[]"))
    return table(spark, sf, "assets").select("video_id", F.array_join(F.sort_array(F.map_keys(review.clean_payload(m)), asc=False), ",").alias("fields")).distinct()


@registry(_TWO + """, cfg AS (SELECT unnest([('clip', 'clip', 1.0), ('both', 'clip', 1.0), ('both', 'bge', 0.5), ('bge', 'bge', 1.0)]) AS c),
on1 AS (SELECT query_id, channel, video_id, min(rank) AS rank FROM u GROUP BY ALL), rr AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY rank, video_id) AS r FROM on1),
sc AS (SELECT c[1] AS configuration, query_id, video_id, round(sum(c[3] / (60 + r)), 9) AS s FROM rr JOIN cfg ON c[2] = channel GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY configuration, query_id ORDER BY s DESC, video_id) AS p FROM sc), qa AS (SELECT vec_id AS query_id, 'V' || lpad(label::VARCHAR, 3, '0') AS video_id FROM embeddings WHERE vec_id % 50 = 0),
f AS (SELECT configuration, qa.query_id, min(p) AS first FROM (SELECT DISTINCT c[1] AS configuration FROM cfg) CROSS JOIN qa LEFT JOIN p USING (configuration, query_id, video_id) GROUP BY ALL)
SELECT configuration, count(*) AS queries, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg((coalesce(first, 0) = 1)::INT), 6) AS hit_1 FROM f GROUP BY 1""")
def channel_ablations(spark: SparkSession, sf: str) -> DataFrame:
    """Three configurations of two channels on the same hits; the video of the query's own label is relevant."""
    relevant = table(spark, sf, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("V"), F.lpad(F.col("label").cast("string"), 3, "0")).alias("video_id"))
    return evaluate.ablations(_two_channels(spark, sf), {"clip": {"clip": 1.0}, "both": {"clip": 1.0, "bge": 0.5}, "bge": {"bge": 1.0}}, relevant)


@registry("""WITH x AS (SELECT query_vec_id, count(*) AS n, min(clip_score) AS lo, max(object_score) AS hi, count(DISTINCT video_id) AS v FROM fused_results WHERE query_vec_id IS NOT NULL GROUP BY 1),
y AS (SELECT *, query_vec_id % 9 <> 0 AS session, least(n / 6.0, 1) AS recall, hi >= 0.05 AS top, n >= 4 AS chain, v >= 2 AS right_video, least(n / 8.0, 1) AS share, CASE WHEN lo < 0.3 THEN 6.0 ELSE 1.0 END AS err FROM x),
z AS (SELECT *, CASE WHEN NOT session THEN 'SESSION_NOT_PERSISTED' WHEN recall < 1 THEN 'EVENT_RECALL_FAILURE' WHEN NOT coalesce(top, false) THEN 'VIDEO_RECALL_FAILURE' WHEN NOT chain THEN 'TEMPORAL_FEASIBILITY_FAILURE' WHEN NOT right_video THEN 'WRONG_VIDEO'
  WHEN share < 1 THEN 'REQUIRED_EVENT_MISSING' WHEN err > 5 THEN 'FRAME_GRANULARITY_FAILURE' END AS stage FROM y)
SELECT stage, count(*) AS requests, round(avg(recall), 6) AS event_recall, round(avg((right_video)::INT), 6) AS video_recall, round(avg((chain AND right_video AND share >= 1)::INT), 6) AS chain_success, round(avg(err), 6) AS timestamp_error, count(*) FILTER (WHERE stage IS NULL) AS passed FROM z GROUP BY 1""")
def alignment_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Stored results as made-up alignments: where each was lost, and the rates of those lost there."""
    f = table(spark, sf, "fused_results").filter("query_vec_id IS NOT NULL").groupBy("query_vec_id").agg(F.count(F.lit(1)).alias("n"), F.min("clip_score").alias("lo"), F.max("object_score").alias("hi"), F.count_distinct("video_id").alias("v"))
    n = F.col("n")
    d = f.withColumns({"session": F.col("query_vec_id") % 9 != 0, "event_recall": F.least(n / 6.0, F.lit(1.0)), "top": F.col("hi") >= 0.05, "has_chain": n >= 4, "right_video": F.col("v") >= 2, "required_share": F.least(n / 8.0, F.lit(1.0)), "worst_error": F.when(F.col("lo") < 0.3, 6.0).otherwise(1.0)})
    d = d.withColumn("stage", evaluate.failure_stage(*[F.col(c) for c in ("session", "event_recall", "top", "has_chain", "right_video", "required_share", "worst_error")]))
    return evaluate.alignment_metrics(d, ["stage"])


@registry("""WITH a AS (SELECT suite, CASE item_id % 4 WHEN 0 THEN 'EDITED' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'CONFIRMED' END AS decision, item_id % 2 = 0 AS confirmed, item_id % 3 <> 0 AS backed, item_id % 60 AS frame, CASE WHEN item_id % 5 <> 0 THEN 10 END AS lo FROM eval_items)
SELECT suite, count(*) AS answers, round(avg((decision = 'EDITED')::INT) FILTER (WHERE decision IS NOT NULL), 6) AS edit_rate, round(avg((decision = 'REJECTED')::INT) FILTER (WHERE decision IS NOT NULL), 6) AS reject_rate, round(avg(backed::INT) FILTER (WHERE confirmed), 6) AS evidence_coverage,
  round(avg((NOT backed)::INT) FILTER (WHERE confirmed), 6) AS unsupported_rate, round(avg((frame BETWEEN lo AND 40)::INT) FILTER (WHERE lo IS NOT NULL), 6) AS frame_accuracy FROM a GROUP BY 1""")
def review_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up reviews of the evaluation items."""
    i = F.col("item_id")
    e = table(spark, sf, "eval_items").withColumns({
        "decision": F.when(i % 4 == 0, "EDITED").when(i % 4 == 1, "REJECTED").when(i % 4 == 2, "CONFIRMED"), "confirmed": i % 2 == 0, "evidence_ids": F.when(i % 3 != 0, F.array(F.lit("e"))),
        "frame": i % 60, "frame_from": F.when(i % 5 != 0, F.lit(10)), "frame_to": F.lit(40),
    })
    return evaluate.review_metrics(e, ["suite"])


@registry("""WITH x AS (SELECT item_id, query_id, query_text, suite, expected_answer AS a, expected_video_id AS v, item_id % 4 <> 0 AS answerable FROM eval_items)
SELECT item_id, unnest(list_filter([CASE WHEN coalesce(trim(query_id), '') = '' THEN 'QUERY_ID_REQUIRED' END, CASE WHEN coalesce(trim(query_text), '') = '' THEN 'QUERY_TEXT_REQUIRED' END, CASE WHEN suite <> 'qa' THEN 'UNSUPPORTED_QUESTION_TYPE' END,
  CASE WHEN answerable AND v IS NULL THEN 'EXPECTED_VIDEO_REQUIRED' END, CASE WHEN v IS NOT NULL AND NOT regexp_matches(v, '^L\\d{2}_V\\d{3}$') THEN 'INVALID_VIDEO_ID' END, CASE WHEN answerable AND coalesce(trim(a), '') = '' THEN 'EXPECTED_ANSWER_REQUIRED' END,
  CASE WHEN length(trim(a)) > 10 THEN 'ANSWER_TOO_LONG' END, CASE WHEN answerable AND item_id % 2 = 0 THEN 'KEYFRAME_EVIDENCE_REQUIRED' END, CASE WHEN item_id % 2 = 0 THEN 'UNSUPPORTED_MODALITY' END,
  CASE WHEN item_id % 6 = 0 THEN 'INVALID_RANGE' END, CASE WHEN item_id % 7 = 0 THEN 'ANNOTATOR_REQUIRED' END], lambda c: c IS NOT NULL)) AS code FROM x""")
def annotation_issues(spark: SparkSession, sf: str) -> DataFrame:
    """The evaluation items as labelled questions, with made-up modalities, ranges and annotators."""
    i = F.col("item_id")
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    e = table(spark, sf, "eval_items").withColumns({
        "question_type": F.when(F.col("suite") == "qa", "ocr").otherwise(F.col("suite")), "expected_videos": one("expected_video_id"), "expected_answers": one("expected_answer"), "modalities": F.array(F.when(i % 2 == 0, "smell").otherwise("keyframe")),
        "time_ranges": F.array(F.struct(F.when(i % 6 == 0, 9.0).otherwise(1.0).alias("start"), F.lit(2.0).alias("end"))), "annotator": F.when(i % 7 != 0, "me"), "annotated_at": F.lit("2024"), "answerable": i % 4 != 0,
    })
    return audit.issues(e, ["item_id"], audit.annotation_rules(longest_answer=10)).select("item_id", "code")


@registry("""WITH a AS (SELECT video_id, max(mapping_rows) AS f FROM assets GROUP BY 1), k AS (SELECT video_id, count(DISTINCT keyframe_id) AS f FROM keyframes GROUP BY 1)
SELECT video_id, CASE WHEN a.video_id IS NULL THEN 'UNLISTED' WHEN k.video_id IS NULL THEN 'MISSING' WHEN a.f IS NOT DISTINCT FROM k.f THEN 'READY' ELSE 'STALE' END AS status FROM a FULL JOIN k USING (video_id)""")
def artifact_status(spark: SparkSession, sf: str) -> DataFrame:
    """Registered mappings against the frames that exist; counts stand for fingerprints."""
    a = table(spark, sf, "assets").groupBy("video_id").agg(F.max("mapping_rows").cast("long").alias("f"))
    k = table(spark, sf, "keyframes").groupBy("video_id").agg(F.count_distinct("keyframe_id").alias("f"))
    return audit.staleness(a, k, ["video_id"], "f")


@registry("""SELECT count(*) AS rows, count(DISTINCT video_id) AS videos, count(*) FILTER (WHERE keyframe_id IS NULL) AS no_frame, count(*) FILTER (WHERE coalesce(trim(text_raw), '') = '') AS no_text,
  count(*) FILTER (WHERE confidence IS NULL OR isnan(confidence) OR confidence < 0 OR confidence > 1) AS bad_confidence, count(*) FILTER (WHERE pts_time < 0) AS negative_time FROM ocr""")
def evidence_store_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.store_audit(table(spark, sf, "ocr"), "pts_time", "confidence", "text_raw")


@registry("""SELECT asr_id, round(CASE WHEN confidence IS NULL THEN NULL ELSE least(greatest(exp(confidence - 1), 0), 1) END, 6) AS from_log, least(greatest(coalesce(confidence - 0.5, start_time, 1.0), 0), 1) AS picked FROM asr""")
def confidence_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Confidences as made of log probabilities, and picked from what is stated."""
    c = F.col("confidence")
    return table(spark, sf, "asr").select("asr_id", r6(T.log_confidence(c - 1)).alias("from_log"), T.picked_confidence(c - 0.5, F.col("start_time")).alias("picked"))


@registry("""SELECT doc_id, regexp_matches(text, 'Ãâ|Ãá|Ãà|Ãé|Ãê|Ãô|Æ°|Ä\\x{91}|Ä\\x{90}|á»|áº|â€|â\\x{96}|â\\x{9c}|Â©|Â®') AS mojibake, regexp_matches(lower(text), '[ăâđêôơưáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ]') AS vietnamese FROM documents WHERE text IS NOT NULL""")
def text_tests(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").filter(t.isNotNull()).select("doc_id", T.has_mojibake(t).alias("mojibake"), T.has_vietnamese(t).alias("vietnamese"))


@registry("""SELECT asset_id, array_to_string(list_filter([a, b, c], lambda x: x IS NOT NULL), '|') AS texts FROM (SELECT row_number() OVER (ORDER BY video_id, feature_rows) AS asset_id, clip_feature_path AS a, mapping_path AS b, media_info_path AS c FROM (SELECT DISTINCT video_id, feature_rows, clip_feature_path, mapping_path, media_info_path FROM assets))""")
def nested_texts(spark: SparkSession, sf: str) -> DataFrame:
    """All strings within a JSON value made of each registered video's paths, at several depths."""
    a = table(spark, sf, "assets").select("video_id", "feature_rows", "clip_feature_path", "mapping_path", "media_info_path").distinct()
    j = F.to_json(F.struct(F.array("clip_feature_path").alias("a"), F.struct(F.col("mapping_path").alias("m"), F.lit(3).alias("n")).alias("b"), F.col("media_info_path").alias("c")))
    d = ranking.rank_by(a.withColumn("j", j), [], [F.col("video_id"), F.col("feature_rows")], "asset_id")
    return d.select("asset_id", F.array_join(payloads.nested_texts("j"), "|").alias("texts"))


@registry("""SELECT source_type, count(*) AS documents, min(n) AS least, max(n) AS most, round(avg(n), 3) AS mean, count(*) FILTER (WHERE n > 60) AS over_limit FROM (SELECT source_type, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS n FROM documents WHERE text IS NOT NULL) GROUP BY 1""")
def text_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Words per text, and how many texts exceed what a model would read."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL").withColumn("n", F.size(T.tokens(F.col("text"))).cast("long"))
    return corpus.length_stats(d, ["source_type"], "n", 60)


@registry("""WITH c AS (SELECT video_id, (round(max(confidence), 9), -pts_time) AS b FROM ocr WHERE confidence IS NOT NULL AND pts_time IS NOT NULL GROUP BY video_id, pts_time), m AS (SELECT video_id, -max(b)[2] AS coarse_t FROM c GROUP BY 1),
f AS (SELECT a.video_id, (round(confidence, 9), -start_time) AS b FROM asr a JOIN m ON a.video_id = m.video_id AND abs(start_time - coarse_t) <= 30 WHERE confidence IS NOT NULL), g AS (SELECT video_id, max(b) AS b FROM f GROUP BY 1)
SELECT video_id, round(coarse_t, 6) AS coarse_t, round(-b[2], 6) AS t, round(b[1], 6) AS score, round_even(-b[2] * 25, 0)::BIGINT AS frame_idx FROM m LEFT JOIN g USING (video_id)""")
def refined_moments(spark: SparkSession, sf: str) -> DataFrame:
    """The best moment of each video in two stages; confidences of texts and speech stand for a decoder's scores."""
    coarse = table(spark, sf, "ocr").filter("pts_time IS NOT NULL").select("video_id", F.col("pts_time").alias("t"), F.col("confidence").alias("score"))
    fine = table(spark, sf, "asr").filter("start_time IS NOT NULL").select("video_id", F.col("start_time").alias("t"), F.col("confidence").alias("score"))
    out = localise.refined_events(coarse, fine, ["video_id"], 30.0, 25.0)
    return out.select("video_id", r6("coarse_t").alias("coarse_t"), r6("t").alias("t"), r6("score").alias("score"), "frame_idx")


@registry("""WITH e AS (SELECT DISTINCT video_id, start_time AS "at" FROM asr WHERE start_time IS NOT NULL AND segment_id % 10 = 0), s AS (SELECT DISTINCT video_id, pts_time AS t, confidence AS score FROM ocr WHERE pts_time IS NOT NULL AND confidence IS NOT NULL)
SELECT video_id, "at", round(t, 6) AS t, round(score, 6) AS score, row_number() OVER (PARTITION BY video_id, "at" ORDER BY round(score, 9) DESC, s.t) AS rank FROM e JOIN s USING (video_id) WHERE abs(s.t - "at") <= 10 QUALIFY rank <= 12""")
def dense_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Around every tenth segment of a video (a moment an alignment has chosen) the twelve best read frames within ten seconds."""
    events = table(spark, sf, "asr").filter("start_time IS NOT NULL AND segment_id % 10 = 0").select("video_id", F.lit("e").alias("event_id"), F.col("start_time").alias("at"))
    scores = table(spark, sf, "ocr").filter("pts_time IS NOT NULL").select("video_id", F.lit("e").alias("event_id"), F.col("pts_time").alias("t"), F.col("confidence").alias("score"))
    return localise.dense_candidates(events, scores, 10.0).select("video_id", "at", r6("t").alias("t"), r6("score").alias("score"), "rank")


@registry()
def dense_localisation(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of each video in two stages; greedy, tested on a fixture."""
    coarse = table(spark, sf, "ocr").filter("pts_time IS NOT NULL").select("video_id", F.col("pts_time").alias("t"), F.col("confidence").alias("score"))
    fine = table(spark, sf, "asr").filter("start_time IS NOT NULL").select("video_id", F.col("start_time").alias("t"), F.col("confidence").alias("score"))
    return localise.two_stage(coarse, fine, ["video_id"], anchors=6, window=5.0, gap=2.0, keep=12, fps=25.0)


@registry(_FRAMES + """, k AS (SELECT video_id, keyframe_id, min(pts_time) AS t FROM keyframes WHERE pts_time IS NOT NULL GROUP BY ALL), c AS (SELECT query_id, video_id, keyframe_id, min(rank) AS r FROM hits WHERE rank <= 20 GROUP BY ALL),
o AS (SELECT ocr_id, video_id, keyframe_id, pts_time AS t, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC NULLS LAST, ocr_id) AS r FROM ocr WHERE pts_time IS NOT NULL QUALIFY r <= 5),
q AS (SELECT DISTINCT query_id, video_id FROM c), h AS (SELECT query_id, 'clip' AS ch, video_id, keyframe_id, r FROM c UNION ALL SELECT query_id, 'ocr', o.video_id, o.keyframe_id, o.r FROM q JOIN o USING (video_id)),
b AS (SELECT query_id, video_id, keyframe_id, ch, min(r) AS r FROM h GROUP BY ALL), sc AS (SELECT query_id, video_id, keyframe_id, sum(1.0 / (60 + r)) AS score, string_agg(ch, ',' ORDER BY ch) AS channels FROM b GROUP BY ALL)
SELECT query_id, video_id, keyframe_id, round(score, 6) AS score, channels, row_number() OVER (PARTITION BY query_id, video_id ORDER BY round(score, 9) DESC, t, keyframe_id) AS rank FROM sc JOIN k USING (video_id, keyframe_id) QUALIFY rank <= 10""")
def refined_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of each query's videos by similarity and by their five best read texts."""
    clip = frame_hits(spark, sf, 20).select("query_id", "video_id", "keyframe_id", "rank")
    refs = table(spark, sf, "keyframes").select("video_id", "keyframe_id", F.col("pts_time").alias("t"))
    o = table(spark, sf, "ocr").filter("pts_time IS NOT NULL").select("video_id", "keyframe_id", F.col("pts_time").alias("t"), "confidence", "ocr_id")
    best = ranking.rank_by(o, ["video_id"], [F.col("confidence").desc_nulls_last(), F.col("ocr_id")], "rank", 5)
    text = clip.select("query_id", "video_id").distinct().join(best, "video_id").select("query_id", F.lit("ocr").alias("channel"), "video_id", "keyframe_id", "t", "rank", F.lit(None).cast("double").alias("seed_t"))
    out = fusion.refined_frames(clip, text, refs, radius=15.0, limit=10)
    return out.select("query_id", "video_id", "keyframe_id", r6("score").alias("score"), "channels", "rank")


@registry(_FRAMES.replace("FROM clip_features WHERE", "FROM clip_features WHERE video_id IN ('L21_V002', 'L21_V003', 'L21_V004') AND",1).replace("(SELECT * FROM v WHERE vec_id % 50 = 0) q", f"(SELECT vec_id, clip_feature::DOUBLE[] AS e, sqrt(list_inner_product(clip_feature::DOUBLE[], clip_feature::DOUBLE[])) AS n FROM clip_features WHERE {_USABLE} AND vec_id % 50 = 0) q")
  + "SELECT query_id, 'clip:' || video_id || ':' || keyframe_id AS document_id, 'clip' AS source_type, video_id, keyframe_id, round(score, 6) AS score, rank FROM hits WHERE rank <= 10")
def frame_retriever(spark: SparkSession, sf: str) -> DataFrame:
    """The frame search as one retriever among several, over three videos."""
    rows = table(spark, sf, "clip_features")
    out = vector.frame_retriever(rows, rows.filter("vec_id % 50 = 0"), key="vec_id", vector="clip_feature", query_key="vec_id", query_vector="clip_feature", k=10, dims=128, sources=["clip", "ocr"], videos=["L21_V002", "L21_V003", "L21_V004"], groups=["L21"])
    return out.withColumn("score", r6("score"))


@registry(_FRAMES + """, h AS (SELECT query_id, vec_id, rank FROM hits WHERE rank <= 12), x AS (SELECT query_id, vec_id, max((vec_id * 37 % 100) / 90.0) AS e FROM h WHERE vec_id % 3 <> 0 AND (vec_id * 37 % 100) / 90.0 <= 1 GROUP BY ALL)
SELECT query_id, vec_id, rank, round(e, 6) AS external_score, row_number() OVER (PARTITION BY query_id ORDER BY round(e, 9) DESC NULLS LAST, rank, vec_id) AS new_rank FROM h LEFT JOIN x USING (query_id, vec_id)""")
def external_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up scores from elsewhere reorder the hits they know; some are out of range, some for other frames."""
    hits = frame_hits(spark, sf, 12).select("query_id", "vec_id", "rank")
    given = frame_hits(spark, sf, 20).filter("vec_id % 3 <> 0").select("query_id", "vec_id", ((F.col("vec_id") * 37 % 100) / 90.0).alias("score"))
    return fusion.externally_ranked(hits, given, ["vec_id"]).select("query_id", "vec_id", "rank", r6("external_score").alias("external_score"), "new_rank")


@registry("""WITH w AS (SELECT video_id, arg_min(text_normalized, doc_id) AS t FROM documents WHERE source_type = 'metadata' AND text_normalized IS NOT NULL GROUP BY 1), f AS (SELECT DISTINCT query_vec_id, video_id, keyframe_id FROM fused_results)
SELECT query_vec_id, f.video_id, keyframe_id, array_to_string(string_split(t, ' ')[1:8], ' ') AS keywords FROM f LEFT JOIN w USING (video_id)""")
def enriched_results(spark: SparkSession, sf: str) -> DataFrame:
    """Stored results with eight keywords of their video; the words of its first metadata text stand for keywords."""
    d = table(spark, sf, "documents").filter("source_type = 'metadata' AND text_normalized IS NOT NULL")
    m = d.groupBy("video_id").agg(F.min_by("text_normalized", "doc_id").alias("t")).select("video_id", F.split("t", " ").alias("keywords"))
    f = table(spark, sf, "fused_results").select("query_vec_id", "video_id", "keyframe_id").distinct()
    return candidates.enriched(f, m).withColumn("keywords", F.array_join("keywords", " "))


@registry("""WITH l AS (SELECT document_id, doc_id, ingested_at FROM documents WHERE document_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ingested_at DESC NULLS LAST, doc_id DESC) = 1)
SELECT document_id, doc_id, ingested_at FROM l ORDER BY ingested_at DESC NULLS LAST, document_id LIMIT 25""")
def recent_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 documents whose current state is the newest (a listing)."""
    from vidsift.operators import submission

    now = submission.latest(table(spark, sf, "documents").filter("document_id IS NOT NULL"), ["document_id"], ["ingested_at", "doc_id"])
    return now.select("document_id", "doc_id", "ingested_at").orderBy(F.col("ingested_at").desc_nulls_last(), "document_id").limit(25)


@registry(_FRAMES.replace("WITH v AS", "WITH RECURSIVE v AS", 1) + """, k AS (SELECT video_id, keyframe_id, min(pts_time) AS t FROM keyframes WHERE pts_time IS NOT NULL GROUP BY ALL), m AS (SELECT query_id, video_id, keyframe_id, max(score) AS score FROM s JOIN k USING (video_id, keyframe_id) WHERE query_id IN (SELECT DISTINCT query_id FROM hits WHERE rank <= 2) GROUP BY ALL),
sd AS (SELECT DISTINCT h.query_id, h.video_id, k.t FROM hits h JOIN k USING (video_id, keyframe_id) WHERE rank <= 2), c AS (SELECT DISTINCT sd.query_id, k.video_id, k.keyframe_id, k.t FROM sd JOIN k USING (video_id) WHERE abs(k.t - sd.t) <= 20),
r0 AS (SELECT c.query_id, c.video_id, c.keyframe_id, c.t, m.score, row_number() OVER (PARTITION BY c.query_id, c.video_id ORDER BY round(m.score, 9) DESC, c.keyframe_id) AS rank FROM c JOIN m USING (query_id, video_id, keyframe_id)),
g AS (SELECT query_id, video_id, 0::BIGINT AS rank, []::DOUBLE[] AS taken FROM r0 GROUP BY ALL
  UNION ALL SELECT g.query_id, g.video_id, r0.rank, CASE WHEN len(taken) < 5 AND len(list_filter(taken, lambda x: abs(x - t) < 2)) = 0 THEN list_append(taken, t) ELSE taken END FROM g JOIN r0 ON r0.query_id = g.query_id AND r0.video_id = g.video_id AND r0.rank = g.rank + 1),
e AS (SELECT query_id, video_id, rank, len(taken) AS n FROM g), o AS (SELECT query_id, video_id, rank, n > lag(n) OVER (PARTITION BY query_id, video_id ORDER BY rank) AS ok FROM e)
SELECT query_id, video_id, keyframe_id, rank, ok AS is_spaced, row_number() OVER (PARTITION BY query_id, video_id ORDER BY ok DESC, rank) AS spaced_rank FROM r0 JOIN o USING (query_id, video_id, rank) QUALIFY spaced_rank <= 5""")
def spaced_localisation(spark: SparkSession, sf: str) -> DataFrame:
    """Frames near the two best hits of each query, five of a video that lie two seconds apart."""
    k = table(spark, sf, "keyframes").filter("pts_time IS NOT NULL").groupBy("video_id", "keyframe_id").agg(F.min("pts_time").alias("t"))
    f = table(spark, sf, "clip_features").filter(usable(F.col("clip_feature"), 128))
    seeds = frame_hits(spark, sf, 2).join(k, ["video_id", "keyframe_id"])
    frames = f.join(k, ["video_id", "keyframe_id"]).select("video_id", "keyframe_id", "t", F.col("clip_feature").alias("vector"))
    queries = f.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("clip_feature").alias("query_vector"))
    out = localise.localised_spaced(seeds, frames, queries, 20.0, 2.0, 5)
    return out.select("query_id", "video_id", "keyframe_id", "rank", "is_spaced", "spaced_rank")
