"""Objects, time, alignment, candidates, metadata, audits and submissions over the evidence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidsift.functions import vectors as V
from vidsift.operators import audit, candidates, corpus, evaluate, metadata, objects, ranking, submission, temporal
from vidsift.plans.vector_queries import _FRAMES, frame_hits
from vidsift.registry import Registry
from vidsift.sources.tables import table

registry = Registry()

_OK = "confidence IS NOT NULL AND NOT isnan(confidence) AND confidence BETWEEN 0 AND 1"
_READY = "SELECT DISTINCT video_id, keyframe_id FROM keyframes WHERE object_status = 'AVAILABLE'"


def _raw_boxes(spark: SparkSession, sf: str, least: float) -> DataFrame:
    """Boxes without suppression, as the SQL side has them."""
    d = table(spark, sf, "detections").filter(objects.valid_confidence() & (F.col("confidence") >= least))
    return d.select("video_id", "keyframe_id", "label_normalized", F.col("bbox_y1").alias("y1"), F.col("bbox_x1").alias("x1"), F.col("bbox_y2").alias("y2"), F.col("bbox_x2").alias("x2"), "confidence")


@registry(f"""WITH h AS (SELECT video_id, keyframe_id, count(*) AS n, max(confidence) AS best FROM detections WHERE {_OK} AND confidence >= 0.3 AND label_normalized IN ('person', 'car')
  AND (bbox_x1 + bbox_x2) / 2 < 0.33 AND (bbox_y1 + bbox_y2) / 2 >= 0.33 AND (bbox_y1 + bbox_y2) / 2 < 0.66 GROUP BY ALL)
SELECT video_id, keyframe_id, coalesce(n, 0) AS n, round(coalesce(best, 0), 6) AS score, row_number() OVER (ORDER BY round(coalesce(best, 0), 9) DESC, video_id, keyframe_id) AS rank
FROM ({_READY}) LEFT JOIN h USING (video_id, keyframe_id) WHERE coalesce(n, 0) >= 1""")
def object_position_count(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with a person or car on the left, in the middle row."""
    hits = objects.object_search(table(spark, sf, "keyframes"), _raw_boxes(spark, sf, 0.3), ["person", "car"], ">=", 1, "left", "middle")
    return hits.withColumn("score", F.round("score", 6))


@registry(f"""WITH h AS (SELECT video_id, keyframe_id, count(*) AS n, max(confidence) AS best FROM detections WHERE {_OK} AND confidence >= 0.5 AND label_normalized = 'person' GROUP BY ALL)
SELECT video_id, keyframe_id, coalesce(n, 0) AS n, round(coalesce(best, 0), 6) AS score, row_number() OVER (ORDER BY round(coalesce(best, 0), 9) DESC, video_id, keyframe_id) AS rank
FROM ({_READY}) LEFT JOIN h USING (video_id, keyframe_id) WHERE coalesce(n, 0) <= 0""")
def object_absent(spark: SparkSession, sf: str) -> DataFrame:
    """Tested frames without a person; untested ones stay unknown and don't appear."""
    hits = objects.object_search(table(spark, sf, "keyframes"), _raw_boxes(spark, sf, 0.5), ["person"], "<=", 0)
    return hits.withColumn("score", F.round("score", 6))


_SIDE = "greatest(least(k.{0}2, {0}2) - greatest(k.{0}1, {0}1), 0)"
_AREA = "greatest({0}y2 - {0}y1, 0) * greatest({0}x2 - {0}x1, 0)"


@registry(f"""WITH RECURSIVE d AS (SELECT DISTINCT video_id, keyframe_id, label_normalized AS l, confidence AS c, bbox_y1 AS y1, bbox_x1 AS x1, bbox_y2 AS y2, bbox_x2 AS x2 FROM detections WHERE {_OK} AND confidence >= 0.2 AND label_normalized IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY video_id, keyframe_id, l ORDER BY c DESC, y1, x1, y2, x2) AS n FROM d),
r AS (SELECT video_id, keyframe_id, l, n, [{{'y1': y1, 'x1': x1, 'y2': y2, 'x2': x2, 'c': c}}] AS kept FROM b WHERE n = 1
  UNION ALL SELECT b.video_id, b.keyframe_id, b.l, b.n, CASE WHEN len(list_filter(kept, lambda k: {_SIDE.format('y')} * {_SIDE.format('x')} > 0.5 * ({_AREA.format('k.')} + {_AREA.format('')} - {_SIDE.format('y')} * {_SIDE.format('x')}))) = 0
    THEN list_append(kept, {{'y1': y1, 'x1': x1, 'y2': y2, 'x2': x2, 'c': c}}) ELSE kept END FROM r JOIN b ON b.video_id = r.video_id AND b.keyframe_id = r.keyframe_id AND b.l = r.l AND b.n = r.n + 1),
g AS (SELECT video_id, keyframe_id, l, arg_max(kept, n) AS kept FROM r GROUP BY ALL), k AS (SELECT video_id, keyframe_id, l, unnest(kept) AS x FROM g)
SELECT video_id, keyframe_id, l AS label_normalized, x.y1 AS y1, x.x1 AS x1, x.y2 AS y2, x.x2 AS x2, x.c AS confidence, row_number() OVER (PARTITION BY video_id, keyframe_id ORDER BY x.c DESC, l, x.y1, x.x1, x.y2, x.x2) AS box_rank FROM k QUALIFY box_rank <= 20""")
def nms_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy suppression per frame and label, best twenty a frame."""
    return objects.suppressed(table(spark, sf, "detections"), 0.2, 0.5, keep=20)


@registry("""WITH k AS (SELECT DISTINCT video_id, keyframe_id, object_status FROM keyframes)
SELECT video_id, count(*) AS frames, count(*) FILTER (WHERE object_status = 'AVAILABLE') AS available,
  CASE WHEN count(*) FILTER (WHERE object_status = 'AVAILABLE') = count(*) THEN 'AVAILABLE' WHEN count(*) FILTER (WHERE object_status = 'AVAILABLE') = 0 THEN 'UNKNOWN' ELSE 'PARTIAL_UNKNOWN' END AS status FROM k GROUP BY 1""")
def tri_state_status(spark: SparkSession, sf: str) -> DataFrame:
    return objects.tri_state(table(spark, sf, "keyframes"))


@registry(f"""WITH d AS (SELECT video_id, keyframe_id, label_normalized, center_x AS x, center_y AS y, max(confidence) AS c FROM detections WHERE {_OK} AND confidence >= 0.3 AND label_normalized IN ('person', 'car') GROUP BY ALL),
p AS (SELECT a.video_id, a.keyframe_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist, a.c AS ac, b.c AS bc FROM d a JOIN d b USING (video_id, keyframe_id) WHERE a.label_normalized = 'person' AND b.label_normalized = 'car'),
s AS (SELECT video_id, keyframe_id, max(round(greatest(0, 1 - dist / 0.35) * sqrt(ac * bc), 9)) AS score FROM p WHERE dist <= 0.35 GROUP BY ALL)
SELECT video_id, keyframe_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, video_id, keyframe_id) AS rank FROM s""")
def proximity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = objects.proximity(table(spark, sf, "detections"), ["person"], ["car"], 0.3)
    return p.select("video_id", "keyframe_id", F.round("score", 6).alias("score"), "rank")


_RULE = {"Car": 1.0, "Motorcycle": 1.0, "Vehicle": 0.7, "Land vehicle": 0.7, "Wheel": 0.45, "Traffic sign": 0.25, "Truck": 0.55, "Bus": 0.55}


@registry(f"""SELECT video_id, keyframe_id, round(least(sum(confidence * CASE label_raw {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _RULE.items())} END), 1.0), 6) AS object_score,
  string_agg(DISTINCT label_raw, ',' ORDER BY label_raw) AS entities FROM detections WHERE {_OK} AND label_raw IN ({', '.join(f"'{k}'" for k in _RULE)}) GROUP BY ALL""")
def object_rule_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The vehicle rule: weighted confidences of its entities, capped."""
    return objects.rule_scores(table(spark, sf, "detections"), _RULE).withColumn("object_score", F.round("object_score", 6))


@registry(f"""WITH b AS (SELECT video_id, keyframe_id, label_normalized, max(confidence) AS c FROM detections WHERE {_OK} AND confidence >= 0.3 AND label_normalized IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, keyframe_id ORDER BY c DESC, label_normalized) AS n FROM b)
SELECT video_id, keyframe_id, string_agg(label_normalized, ' ' ORDER BY n) AS text, max(c) AS confidence FROM r WHERE n <= 20 GROUP BY ALL""")
def frame_object_texts(spark: SparkSession, sf: str) -> DataFrame:
    return objects.top_labels(table(spark, sf, "detections"), 0.3)


@registry(f"SELECT source, count(*) AS rows, count(*) FILTER (WHERE confidence >= 0.1) AS at_10, count(*) FILTER (WHERE confidence >= 0.2) AS at_20, count(*) FILTER (WHERE confidence >= 0.3) AS at_30, count(*) FILTER (WHERE confidence >= 0.5) AS at_50 FROM detections WHERE {_OK} GROUP BY 1")
def threshold_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return objects.threshold_counts(table(spark, sf, "detections"))


@registry("""SELECT count(*) AS rows, count(*) FILTER (WHERE confidence IS NULL OR isnan(confidence) OR confidence < 0 OR confidence > 1) AS bad_confidence,
  count(*) FILTER (WHERE NOT coalesce(bbox_y1 >= 0 AND bbox_y1 <= bbox_y2 AND bbox_y2 <= 1 AND bbox_x1 >= 0 AND bbox_x1 <= bbox_x2 AND bbox_x2 <= 1, false)) AS bad_box,
  count(*) FILTER (WHERE label_normalized IS NULL) AS no_label, count(*) FILTER (WHERE abs(area - (bbox_y2 - bbox_y1) * (bbox_x2 - bbox_x1)) > 0.0001) AS bad_area FROM detections""")
def bounds_audit(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    area = (c("bbox_y2") - c("bbox_y1")) * (c("bbox_x2") - c("bbox_x1"))
    return table(spark, sf, "detections").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(objects.valid_confidence(), F.lit(False))).alias("bad_confidence"),
        F.count_if(~V.valid_box(c("bbox_y1"), c("bbox_x1"), c("bbox_y2"), c("bbox_x2"))).alias("bad_box"), F.count_if(c("label_normalized").isNull()).alias("no_label"),
        F.count_if(F.abs(c("area") - area) > 0.0001).alias("bad_area"),
    )


@registry("""WITH r AS (SELECT DISTINCT video_id, pts_time, keyframe_id FROM keyframes WHERE pts_time IS NOT NULL),
n AS (SELECT asr_id, r.keyframe_id, abs(r.pts_time - start_time) AS d FROM asr JOIN r USING (video_id) WHERE abs(r.pts_time - start_time) <= 5)
SELECT asr_id, keyframe_id AS keyframe, round(d, 6) AS distance FROM n QUALIFY row_number() OVER (PARTITION BY asr_id ORDER BY d, keyframe_id) = 1""")
def nearest_ref(spark: SparkSession, sf: str) -> DataFrame:
    """The keyframe nearest to each segment's start within five seconds."""
    refs = temporal.distinct_times(table(spark, sf, "keyframes"))
    points = table(spark, sf, "asr").select(F.col("video_id").alias("entity"), F.col("asr_id").alias("id"), F.col("start_time").alias("t"))
    return temporal.asof_nearest(points, refs, 5.0).select(F.col("id").alias("asr_id"), F.col("ref").cast("int").alias("keyframe"), F.round("distance", 6).alias("distance"))


@registry("""WITH r AS (SELECT video_id, pts_time, min(keyframe_id) AS keyframe_id FROM keyframes WHERE pts_time IS NOT NULL GROUP BY ALL),
j AS (SELECT asr_id, r.keyframe_id, round(abs(r.pts_time - (start_time + end_time) / 2), 9) AS off FROM asr JOIN r USING (video_id) WHERE r.pts_time BETWEEN start_time AND end_time)
SELECT asr_id, arg_min(keyframe_id, (off, keyframe_id)) AS keyframe, round(min(off), 6) AS off_middle, count(*) AS inside FROM j GROUP BY 1""")
def interval_map(spark: SparkSession, sf: str) -> DataFrame:
    """The keyframe inside each speech segment that is closest to its middle."""
    refs = temporal.distinct_times(table(spark, sf, "keyframes"))
    i = table(spark, sf, "asr").select(F.col("video_id").alias("entity"), F.col("asr_id").alias("id"), F.col("start_time").alias("t0"), F.col("end_time").alias("t1"))
    out = temporal.inside_intervals(i, refs)
    return out.select(F.col("id").alias("asr_id"), F.col("ref").cast("int").alias("keyframe"), F.round("off_middle", 6).alias("off_middle"), "inside")


@registry("""WITH r AS (SELECT video_id, pts_time, min(keyframe_id) AS keyframe_id FROM keyframes WHERE pts_time IS NOT NULL GROUP BY ALL),
s AS (SELECT DISTINCT video_id, pts_time AS seed FROM ocr WHERE confidence >= 0.95 AND pts_time IS NOT NULL)
SELECT video_id, keyframe_id AS keyframe, pts_time, min(round(abs(pts_time - seed), 6)) AS distance FROM r JOIN s USING (video_id) WHERE abs(pts_time - seed) <= 4 GROUP BY ALL""")
def radius_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Keyframes within four seconds of any confidently read text."""
    refs = temporal.distinct_times(table(spark, sf, "keyframes"))
    seeds = table(spark, sf, "ocr").filter("confidence >= 0.95").select(F.col("video_id").alias("entity"), F.col("pts_time").alias("t"))
    out = temporal.within_radius(seeds, refs, 4.0)
    return out.select(F.col("entity").alias("video_id"), F.col("ref").alias("keyframe"), F.col("t").alias("pts_time"), F.round("distance", 6).alias("distance"))


@registry("""WITH k AS (SELECT DISTINCT video_id, keyframe_id FROM keyframes),
w AS (SELECT video_id, keyframe_id, list(keyframe_id) OVER (PARTITION BY video_id ORDER BY keyframe_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM k)
SELECT video_id, keyframe_id, array_to_string(n, '>') AS neighbours FROM w""")
def neighbors_window(spark: SparkSession, sf: str) -> DataFrame:
    k = table(spark, sf, "keyframes").select("video_id", "keyframe_id").distinct()
    n = ranking.neighbours(k, ["video_id"], ["keyframe_id"], "keyframe_id", 3)
    return n.withColumn("neighbours", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ">"))


@registry("""WITH k AS (SELECT video_id, keyframe_id, min(pts_time) AS t FROM keyframes WHERE pts_time IS NOT NULL GROUP BY ALL),
g AS (SELECT video_id, lead(t) OVER (PARTITION BY video_id ORDER BY keyframe_id) - t AS gap FROM k)
SELECT video_id, count(gap) AS gaps, round(min(gap), 6) AS least, round(max(gap), 6) AS most, round(avg(gap), 6) AS mean, coalesce(bool_or(gap < 0), false) AS out_of_order FROM g GROUP BY 1""")
def gap_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps between neighbouring keyframes, and whether their times ever fall."""
    k = table(spark, sf, "keyframes").filter("pts_time IS NOT NULL").groupBy("video_id", "keyframe_id").agg(F.min("pts_time").alias("t"))
    g = ranking.following(k, ["video_id"], "keyframe_id", "t", ["t"]).withColumn("gap", F.col("next.t") - F.col("t"))
    r = lambda c: F.round(c, 6)
    return g.groupBy("video_id").agg(F.count("gap").alias("gaps"), r(F.min("gap")).alias("least"), r(F.max("gap")).alias("most"), r(F.avg("gap")).alias("mean"), F.coalesce(F.bool_or(F.col("gap") < 0), F.lit(False)).alias("out_of_order"))


def _event_candidates(spark: SparkSession, sf: str, keep: int | None = 8) -> DataFrame:
    """Users as videos, event types as events: the best `keep` of each user and type by value, or all of them."""
    e = table(spark, sf, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("video_id"), F.col("event_type").alias("event_id"), F.col("event_id").alias("candidate_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("v"))
    top = ranking.rank_by(e, ["video_id", "event_id"], [F.col("v").desc_nulls_last(), F.col("candidate_id")], "rank", keep)
    return ranking.rank_score(top, ["video_id", "event_id"])


#: Every event of a user as a candidate; pools keep the best eight of each user and type.
_ALL = """
WITH e AS (SELECT 'U' || user_id AS video_id, event_type AS event_id, event_id AS candidate_id, epoch_us(ts) / 1e6 AS t, value AS v FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, event_id ORDER BY v DESC NULLS LAST, candidate_id) AS rank FROM e),
c AS (SELECT *, CASE WHEN count(*) OVER w = 1 THEN 1.0 ELSE 1 - (rank - 1.0) / (count(*) OVER w - 1) END AS s FROM r WINDOW w AS (PARTITION BY video_id, event_id))
"""
_CAND = _ALL.replace(" FROM e),", " FROM e QUALIFY rank <= 8),")


@registry(_CAND + "SELECT video_id, event_id, candidate_id, rank, round(s, 6) AS local_score FROM c")
def event_pools(spark: SparkSession, sf: str) -> DataFrame:
    return _event_candidates(spark, sf).select("video_id", "event_id", "candidate_id", "rank", F.round("local_score", 6).alias("local_score"))


_COST = "0.25 * ({b}.t - {a}.t) / ({b}.t - {a}.t + 60)"


@registry(
    _ALL
    + f""", p AS (SELECT a.video_id, a.s + b.s - {_COST.format(a='a', b='b')} AS obj, a.candidate_id || '>' || b.candidate_id AS path
  FROM c a JOIN c b ON a.video_id = b.video_id AND a.event_id = 'view' AND b.event_id = 'click' AND b.t > a.t AND b.t - a.t <= 864000),
z AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(obj, 9) DESC, path) AS rank FROM p)
SELECT video_id, round(obj, 6) AS objective, path, rank FROM z WHERE rank <= 5"""
)
def sequence_two(spark: SparkSession, sf: str) -> DataFrame:
    """The five best paths view, then click within ten days."""
    s = temporal.align(_event_candidates(spark, sf, None), ["view", "click"], most_gap=864000.0, top=5)
    return s.select("video_id", F.round("objective", 6).alias("objective"), "path", "rank")


@registry(
    _ALL
    + f""", p AS (SELECT a.video_id, a.s + b.s - {_COST.format(a='a', b='b')} AS obj, a.candidate_id || '>' || b.candidate_id AS path, b.t
  FROM c a JOIN c b ON a.video_id = b.video_id AND a.event_id = 'view' AND b.event_id = 'click' AND b.t > a.t),
p2 AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(obj, 9) DESC, path) AS r FROM p QUALIFY r <= 100),
q AS (SELECT p2.video_id, p2.obj + b.s - {_COST.format(a='p2', b='b')} AS obj, p2.path || '>' || b.candidate_id AS path
  FROM p2 JOIN c b ON p2.video_id = b.video_id AND b.event_id = 'purchase' AND b.t > p2.t),
z AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(obj, 9) DESC, path) AS rank FROM q)
SELECT video_id, round(obj, 6) AS objective, path, rank FROM z WHERE rank <= 20"""
)
def sequence_three(spark: SparkSession, sf: str) -> DataFrame:
    s = temporal.align(_event_candidates(spark, sf, None), ["view", "click", "purchase"], top=20)
    return s.select("video_id", F.round("objective", 6).alias("objective"), "path", "rank")


@registry(
    _ALL
    + f""", p AS (SELECT a.video_id, a.s + b.s - {_COST.format(a='a', b='b')} AS obj, a.candidate_id || '>' || b.candidate_id AS path, 2 AS matched
  FROM c a JOIN c b ON a.video_id = b.video_id AND a.event_id = 'signup' AND b.event_id = 'purchase' AND b.t > a.t
  UNION ALL SELECT video_id, s - 0.15, candidate_id || '>~skip', 1 FROM c WHERE event_id = 'signup'),
z AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(obj, 9) DESC, path) AS rank FROM p)
SELECT video_id, round(obj, 6) AS objective, path, matched::INTEGER AS matched, rank FROM z WHERE rank <= 10"""
)
def sequence_optional(spark: SparkSession, sf: str) -> DataFrame:
    """The second event may be skipped at a cost."""
    s = temporal.align(_event_candidates(spark, sf, None), ["signup", "purchase"], optional=["purchase"], top=10)
    return s.select("video_id", F.round("objective", 6).alias("objective"), "path", F.col("matched").cast("int").alias("matched"), "rank")


@registry(
    _ALL
    + """, h AS (SELECT video_id, count(*) FILTER (WHERE event_id = 'view') AS n0, count(*) FILTER (WHERE event_id = 'click') AS n1, count(*) FILTER (WHERE event_id = 'purchase') AS n2 FROM c GROUP BY 1),
o AS (SELECT DISTINCT a.video_id FROM c a JOIN c b ON a.video_id = b.video_id AND a.event_id = 'view' AND b.event_id = 'click' AND b.t > a.t AND b.t - a.t <= 86400
      JOIN c d ON a.video_id = d.video_id AND d.event_id = 'purchase' AND d.t > b.t AND d.t - b.t <= 86400)
SELECT video_id, CASE WHEN n0 = 0 THEN 'REQUIRED_EVENT_MISSING:view' WHEN n1 = 0 THEN 'REQUIRED_EVENT_MISSING:click' WHEN n2 = 0 THEN 'REQUIRED_EVENT_MISSING:purchase'
  WHEN video_id IN (SELECT video_id FROM o) THEN 'FEASIBLE' ELSE 'NO_MONOTONIC_REQUIRED_PATH' END AS status FROM h"""
)
def sequence_feasible(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.feasible(_event_candidates(spark, sf, None), ["view", "click", "purchase"], most_gap=86400.0)


@registry("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events),
n AS (SELECT *, CASE WHEN t - lag(t) OVER w > 3600 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM n)
SELECT user_id, session::BIGINT AS session, count(*) AS n, round(max(t) - min(t), 6) AS seconds FROM s GROUP BY user_id, session""")
def sessionize(spark: SparkSession, sf: str) -> DataFrame:
    s = temporal.sessions(table(spark, sf, "events"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "event_id", 3600.0)
    return s.select("user_id", "session", "n", F.round(F.col("last_t") - F.col("first_t"), 6).alias("seconds"))


_CHANNELS = (
    _FRAMES
    + f""", clip AS (SELECT query_id, video_id, keyframe_id, 'clip' AS channel, rank, score FROM hits WHERE rank <= 40),
obj AS (SELECT video_id, keyframe_id, row_number() OVER (ORDER BY round(c, 9) DESC, video_id, keyframe_id) AS rank, c AS score FROM (
  SELECT video_id, keyframe_id, max(confidence) AS c FROM detections WHERE {_OK} AND confidence >= 0.6 AND label_normalized = 'person' GROUP BY ALL)),
ocr_ AS (SELECT video_id, keyframe_id, row_number() OVER (ORDER BY round(c, 9) DESC, video_id, keyframe_id) AS rank, c AS score FROM (
  SELECT video_id, keyframe_id, max(confidence) AS c FROM ocr WHERE confidence >= 0.9 AND keyframe_id IS NOT NULL GROUP BY ALL)),
q AS (SELECT DISTINCT query_id FROM clip),
vids AS (SELECT DISTINCT query_id, video_id FROM clip),
u AS (SELECT query_id, video_id, keyframe_id, channel, rank, score FROM clip
  UNION ALL SELECT query_id, video_id, keyframe_id, 'object', rank, score FROM obj JOIN vids USING (video_id)
  UNION ALL SELECT query_id, video_id, keyframe_id, 'ocr', rank, score FROM ocr_ JOIN vids USING (video_id)),
w AS (SELECT query_id, video_id, keyframe_id, min(rank) FILTER (WHERE channel = 'clip') AS clip_rank, arg_min(score, (rank, score)) FILTER (WHERE channel = 'clip') AS clip_score,
  min(rank) FILTER (WHERE channel = 'object') AS object_rank, arg_min(score, rank) FILTER (WHERE channel = 'object') AS object_score, min(rank) FILTER (WHERE channel = 'ocr') AS ocr_rank,
  string_agg(DISTINCT channel, ',' ORDER BY channel) AS provenance FROM u GROUP BY ALL)
"""
)


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Similar frames, person frames and text frames of the videos that the similar frames are in."""
    clip = candidates.channel_hits(frame_hits(spark, sf, 40), "clip")
    vids = clip.select("query_id", "video_id").distinct()

    def by_confidence(name: str, df: DataFrame, label: str) -> DataFrame:
        best = df.groupBy("video_id", "keyframe_id").agg(F.max("confidence").alias("score"))
        # ranks over the whole table: one pass counts the rows of each score, so no task ranks all rows
        scores = best.withColumn("s", F.round("score", 9))
        return candidates.channel_hits(ranking.rank_by(scores, [], [F.col("s").desc(), F.col("video_id"), F.col("keyframe_id")], "rank").join(vids, "video_id"), label)

    person = table(spark, sf, "detections").filter(objects.valid_confidence() & (F.col("confidence") >= 0.6) & (F.col("label_normalized") == "person"))
    read = table(spark, sf, "ocr").filter("confidence >= 0.9 AND keyframe_id IS NOT NULL")
    return candidates.union_candidates([clip, by_confidence("object", person, "object"), by_confidence("ocr", read, "ocr")])


@registry(_CHANNELS + "SELECT query_id, video_id, keyframe_id, clip_rank, round(clip_score, 6) AS clip_score, object_rank, round(object_score, 6) AS object_score, ocr_rank, provenance FROM w")
def candidate_union_soft(spark: SparkSession, sf: str) -> DataFrame:
    c = _candidates(spark, sf)
    return c.select("query_id", "video_id", "keyframe_id", "clip_rank", F.round("clip_score", 6).alias("clip_score"), "object_rank", F.round("object_score", 6).alias("object_score"), "ocr_rank", "provenance")


@registry(_CHANNELS + "SELECT query_id, video_id, keyframe_id, clip_rank, object_rank, NULL::BIGINT AS ocr_rank FROM w WHERE object_rank IS NOT NULL")
def candidate_union_hard(spark: SparkSession, sf: str) -> DataFrame:
    """Object hard, on-screen text disabled."""
    c = candidates.apply_modes(_candidates(spark, sf), {"object": "hard", "ocr": "disabled"})
    return c.select("query_id", "video_id", "keyframe_id", "clip_rank", "object_rank", "ocr_rank")


@registry(
    _CHANNELS
    + """, f AS (SELECT *, round(coalesce(1.0 / (60 + clip_rank), 0) + coalesce(0.5 / (60 + object_rank), 0) + coalesce(0.6 / (60 + ocr_rank), 0), 9) AS fs FROM w),
pn AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY fs DESC, coalesce(clip_rank, 1000000000), coalesce(object_rank, 1000000000), keyframe_id) AS k FROM f),
pv AS (SELECT query_id, video_id, min(clip_rank) AS c, min(object_rank) AS o, min(ocr_rank) AS t, max(keyframe_id) FILTER (WHERE k = 1) AS keyframe_id, count(*) AS frame_count,
  string_agg(keyframe_id::VARCHAR, '>' ORDER BY k) FILTER (WHERE k <= 5) AS frames FROM pn GROUP BY ALL),
pr AS (SELECT *, CASE WHEN c IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY c NULLS LAST, video_id) END AS cr, CASE WHEN o IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY o NULLS LAST, video_id) END AS orr,
  CASE WHEN t IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY t NULLS LAST, video_id) END AS tr FROM pv),
z AS (SELECT *, coalesce(1.0 / (60 + cr), 0) + coalesce(0.5 / (60 + orr), 0) + coalesce(0.6 / (60 + tr), 0) AS score FROM pr)
SELECT query_id, video_id, round(score, 6) AS score, keyframe_id, frame_count, frames,
  row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, coalesce(cr, 1000000000), coalesce(orr, 1000000000), video_id) AS rank FROM z"""
)
def structured_ranking(spark: SparkSession, sf: str) -> DataFrame:
    v = candidates.structured_videos(_candidates(spark, sf))
    return v.select("query_id", "video_id", F.round("score", 6).alias("score"), "keyframe_id", "frame_count", "frames", "rank")


@registry("""SELECT o_orderkey, 'group=exact;publish_date=range;number=range' AS evidence, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate::DATE BETWEEN DATE '1994-01-01' AND DATE '1995-12-31' AND o_totalprice BETWEEN 1000 AND 200000""")
def metadata_constraints(spark: SparkSession, sf: str) -> DataFrame:
    want = metadata.Constraints(groups=["1-URGENT", "2-HIGH"], date_from="1994-01-01", date_to="1995-12-31", number_min=1000, number_max=200000)
    o = table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    out = metadata.constrained(o, want, str.lower, {"key": "o_orderkey", "group": "o_orderpriority", "date": "day", "number": "o_totalprice"})
    return out.select("o_orderkey", "evidence", "rank")


@registry("""WITH k AS (SELECT doc_id, CASE WHEN contains(lower(text), 'lễ khai mạc') THEN 'exact_original_phrase' WHEN contains(text_folded, 'le khai mac') THEN 'normalized_accent_insensitive_phrase' END AS kind FROM documents)
SELECT doc_id, 'title=' || kind AS evidence, (kind = 'exact_original_phrase')::BIGINT AS exact_count, row_number() OVER (ORDER BY kind = 'exact_original_phrase' DESC, kind = 'normalized_accent_insensitive_phrase', doc_id) AS rank FROM k WHERE kind IS NOT NULL""")
def phrase_match_kind(spark: SparkSession, sf: str) -> DataFrame:
    want = metadata.Constraints(title="lễ khai mạc")
    fold = lambda p: "le khai mac"
    out = metadata.constrained(table(spark, sf, "documents"), want, fold, {"key": "doc_id", "title": "text", "title_folded": "text_folded"})
    return out.select("doc_id", "evidence", "exact_count", "rank")


_ASSET_SQL = """
SELECT video_id, code, severity, count(*) AS rows FROM (
  SELECT video_id, unnest([CASE WHEN clip_feature_path IS NULL THEN 'missing_clip_feature_path:ERROR' END, CASE WHEN mapping_path IS NULL THEN 'missing_mapping_path:ERROR' END,
    CASE WHEN media_info_path IS NULL THEN 'missing_media_info_path:ERROR' END, CASE WHEN object_path IS NULL THEN 'missing_object_path:ERROR' END,
    CASE WHEN feature_rows <> mapping_rows THEN 'feature_mapping_row_mismatch:ERROR' END, CASE WHEN feature_dim <> 128 THEN 'unexpected_feature_dim:ERROR' END,
    CASE WHEN feature_dtype <> 'float16' THEN 'unexpected_feature_dtype:WARNING' END,
    CASE WHEN has_keyframe_images AND mapping_rows IS DISTINCT FROM keyframe_image_count THEN 'mapping_keyframe_count_mismatch:ERROR' END,
    CASE WHEN NOT has_keyframe_images THEN 'missing_keyframe_images:WARNING' END]) AS x FROM assets),
  LATERAL (SELECT split_part(x, ':', 1) AS code, split_part(x, ':', 2) AS severity) WHERE x IS NOT NULL GROUP BY ALL"""


@registry(_ASSET_SQL)
def registry_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule of the registry over every delivered row; feature width is 128 here."""
    i = audit.issues(table(spark, sf, "assets"), ["video_id"], audit.asset_rules(dims=128))
    return i.groupBy("video_id", "code", "severity").agg(F.count(F.lit(1)).alias("rows"))


@registry("""SELECT video_group, count(*) AS rows, count(DISTINCT video_id) AS videos, count(*) FILTER (WHERE has_keyframe_images) AS with_images, count(video_path) AS with_video, sum(video_file_size_bytes)::BIGINT AS bytes FROM assets GROUP BY 1""")
def registry_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "assets").groupBy("video_group").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("video_id").alias("videos"), F.count_if("has_keyframe_images").alias("with_images"), F.count("video_path").alias("with_video"), F.sum("video_file_size_bytes").alias("bytes"))


@registry("""WITH k AS (SELECT video_id, count(DISTINCT keyframe_id) AS frames FROM keyframes GROUP BY 1), f AS (SELECT video_id, count(*) AS vectors FROM clip_features GROUP BY 1),
a AS (SELECT video_id, max(mapping_rows) AS stated_frames, max(feature_rows) AS stated_vectors FROM assets GROUP BY 1)
SELECT video_id, frames, vectors, stated_frames, stated_vectors, CASE WHEN frames IS NULL OR vectors IS NULL THEN 'MISSING' WHEN frames <> stated_frames OR vectors <> stated_vectors THEN 'WARNING' ELSE 'OK' END AS status
FROM a FULL JOIN k USING (video_id) FULL JOIN f USING (video_id)""")
def capability_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Stated against found counts of each video, over all three tables."""
    k = table(spark, sf, "keyframes").groupBy("video_id").agg(F.countDistinct("keyframe_id").alias("frames"))
    f = table(spark, sf, "clip_features").groupBy("video_id").agg(F.count(F.lit(1)).alias("vectors"))
    a = table(spark, sf, "assets").groupBy("video_id").agg(F.max("mapping_rows").alias("stated_frames"), F.max("feature_rows").alias("stated_vectors"))
    j = a.join(k, "video_id", "full").join(f, "video_id", "full")
    off = (F.col("frames") != F.col("stated_frames")) | (F.col("vectors") != F.col("stated_vectors"))
    return j.select("video_id", "frames", "vectors", "stated_frames", "stated_vectors", F.when(F.col("frames").isNull() | F.col("vectors").isNull(), "MISSING").when(off, "WARNING").otherwise("OK").alias("status"))


@registry("""SELECT source_type, count(*) AS rows, count(*) FILTER (WHERE text <> '') AS has_text, count(*) FILTER (WHERE lang <> '') AS has_lang, count(keyframe_id) AS has_keyframe_id, count(pts_time) AS has_pts_time FROM documents GROUP BY 1""")
def coverage_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.coverage(table(spark, sf, "documents"), ["text", "lang", "keyframe_id", "pts_time"], ["source_type"])


@registry("SELECT sum(n)::BIGINT AS rows, count(*) AS distinct_keys, (sum(n) - count(*))::BIGINT AS repeated FROM (SELECT count(*) AS n FROM keyframes GROUP BY video_id, keyframe_id)")
def duplicate_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.repeats(table(spark, sf, "keyframes"), ["video_id", "keyframe_id"])


@registry("""SELECT CASE WHEN mapping_distance_seconds IS NULL THEN 'unmapped' WHEN mapping_distance_seconds <= 0.25 THEN '<=0.25' WHEN mapping_distance_seconds <= 0.5 THEN '<=0.5' WHEN mapping_distance_seconds <= 1 THEN '<=1'
  WHEN mapping_distance_seconds <= 2 THEN '<=2' WHEN mapping_distance_seconds <= 3 THEN '<=3' WHEN mapping_distance_seconds <= 5 THEN '<=5' ELSE '>5' END AS bucket, source_status, count(*) AS rows FROM ocr GROUP BY ALL""")
def mapping_distance_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "ocr").groupBy(audit.bucketed(F.col("mapping_distance_seconds")).alias("bucket"), "source_status").agg(F.count(F.lit(1)).alias("rows"))


@registry(f"""SELECT source_type, n, v[(round_even((n - 1) * 0.5, 0))::BIGINT + 1] AS p50, v[(round_even((n - 1) * 0.95, 0))::BIGINT + 1] AS p95 FROM (
  SELECT source_type, count(*) AS n, list_sort(list(length(text))) AS v FROM documents WHERE text IS NOT NULL GROUP BY 1)""")
def percentiles_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("v", F.length("text").cast("long"))
    return evaluate.nearest_rank(d, ["source_type"], "v", {"p50": 0.5, "p95": 0.95})


@registry("""SELECT source_type, n, v[greatest(floor(n * 0.95 + 0.999999), 1)::BIGINT] AS p95, m AS median FROM (
  SELECT source_type, count(*) AS n, list_sort(list(length(text))) AS v, median(length(text)) AS m FROM documents WHERE text IS NOT NULL GROUP BY 1)""")
def percentiles_ceil_rank(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("v", F.length("text").cast("long"))
    p = evaluate.nearest_rank(d, ["source_type"], "v", {"p95": 0.95}, rule="ceil")
    m = d.filter("v IS NOT NULL").groupBy("source_type").agg(F.median("v").alias("median"))
    return p.join(m, "source_type")


_JUDGE = """
WITH j AS (SELECT query_vec_id AS query_id, result_rank AS rank, CASE WHEN clip_score IS NULL THEN NULL WHEN clip_score >= 0.6 THEN 1.0 WHEN clip_score >= 0.4 THEN 0.5 ELSE 0.0 END AS g, clip_score, video_id, keyframe_id FROM fused_results)
"""


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """Stored results; the similarity band stands for a reader's judgement, null is not judged."""
    c = F.col("clip_score")
    g = F.when(c.isNull(), F.lit(None)).when(c >= 0.6, 1.0).when(c >= 0.4, 0.5).otherwise(0.0)
    return table(spark, sf, "fused_results").select(F.col("query_vec_id").alias("query_id"), F.col("result_rank").alias("rank"), g.alias("g"), "clip_score", "video_id", "keyframe_id")


@registry(_JUDGE + "SELECT query_id, count(*) AS rows, count(*) FILTER (WHERE g = 1) AS good, count(*) FILTER (WHERE g = 0.5) AS partial, count(*) FILTER (WHERE g = 0) AS bad, count(*) FILTER (WHERE g IS NULL) AS blank, arg_min(g, (rank, video_id, keyframe_id)) FILTER (WHERE g IS NOT NULL) AS first_judged FROM j GROUP BY 1")
def graded_judgements(spark: SparkSession, sf: str) -> DataFrame:
    g = F.col("g")
    first = F.min(F.when(g.isNotNull(), F.struct("rank", "video_id", "keyframe_id", "g")))
    return _judged(spark, sf).groupBy("query_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(g == 1).alias("good"), F.count_if(g == 0.5).alias("partial"), F.count_if(g == 0).alias("bad"), F.count_if(g.isNull()).alias("blank"), first["g"].alias("first_judged"))


@registry(
    _JUDGE
    + """, o AS (SELECT query_id, g, row_number() OVER (PARTITION BY query_id ORDER BY rank, video_id, keyframe_id) AS r, row_number() OVER (PARTITION BY query_id ORDER BY g DESC NULLS LAST, rank, video_id, keyframe_id) AS b FROM j),
s AS (SELECT query_id, sum(CASE WHEN r <= 10 THEN coalesce(g, 0) / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN b <= 10 THEN coalesce(g, 0) / log2(b + 1) ELSE 0 END) AS ideal FROM o GROUP BY 1)
SELECT query_id, CASE WHEN ideal > 0 THEN round(dcg / ideal, 6) END AS ndcg FROM s"""
)
def graded_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    d = ranking.rank_by(_judged(spark, sf), ["query_id"], [F.col("rank"), F.col("video_id"), F.col("keyframe_id")], "r")
    return evaluate.graded_ndcg(d, "query_id", "r", F.col("g")).withColumn("ndcg", F.round("ndcg", 6))


@registry("""SELECT query_vec_id, video_id, keyframe_id, round(clip_score + 0.05 * least(object_score, 1.0) + 0.05 * interaction_score, 6) AS fused,
  row_number() OVER (PARTITION BY query_vec_id ORDER BY round(clip_score + 0.05 * least(object_score, 1.0) + 0.05 * interaction_score, 9) DESC NULLS LAST, baseline_rank, video_id, keyframe_id) AS rank FROM fused_results""")
def rule_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity plus bounded object and interaction evidence; a row without similarity has no fused score and comes last."""
    score = F.col("clip_score") + 0.05 * F.least("object_score", F.lit(1.0)) + 0.05 * F.col("interaction_score")
    d = table(spark, sf, "fused_results").withColumn("f", score)
    r = ranking.rank_by(d, ["query_vec_id"], [ranking.by_score("f"), F.col("baseline_rank"), F.col("video_id"), F.col("keyframe_id")], "rank")
    return r.select("query_vec_id", "video_id", "keyframe_id", F.round("f", 6).alias("fused"), "rank")


_SUB = """
WITH p AS (SELECT 'query-' || query_vec_id || '-kis' AS query_id, 'KIS' AS task, row_number() OVER (PARTITION BY query_vec_id ORDER BY result_rank, video_id, keyframe_id) AS row_no, video_id, keyframe_id::BIGINT AS frame FROM fused_results)
"""


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "fused_results").select(F.concat(F.lit("query-"), F.col("query_vec_id").cast("string"), F.lit("-kis")).alias("query_id"), F.lit("KIS").alias("task"), "result_rank", "video_id", "keyframe_id")
    r = ranking.rank_by(f, ["query_id"], [F.col("result_rank"), F.col("video_id"), F.col("keyframe_id")], "row_no")
    return r.select("query_id", "task", "row_no", "video_id", F.array(F.col("keyframe_id").cast("long")).alias("frame_ids"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("int").alias("event_count"))


@registry(
    _SUB
    + """, d AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id, frame ORDER BY row_no) > 1 AS again, count(*) OVER (PARTITION BY query_id) AS n FROM p)
SELECT query_id, row_no, code, 'ERROR' AS severity FROM (SELECT query_id, row_no, unnest([CASE WHEN n > 100 THEN 'INVALID_PREDICTION_COUNT' END, CASE WHEN NOT regexp_matches(video_id, '^L\\d{2}_V\\d{3}$') THEN 'INVALID_VIDEO_ID' END,
  CASE WHEN frame IS NULL OR frame < 0 THEN 'INVALID_FRAME_ID' END, CASE WHEN again THEN 'DUPLICATE_PREDICTION' END]) AS code FROM d) WHERE code IS NOT NULL"""
)
def submission_validate(spark: SparkSession, sf: str) -> DataFrame:
    return submission.prediction_issues(_predictions(spark, sf))


@registry(_SUB + "SELECT query_id, row_no, video_id || ', ' || frame AS line FROM p")
def submission_lines(spark: SparkSession, sf: str) -> DataFrame:
    p = _predictions(spark, sf)
    return p.select("query_id", "row_no", submission.line(F.col("task"), F.col("video_id"), F.col("frame_ids"), F.col("answer")).alias("line"))


@registry("""SELECT document_id, doc_id, ingested_at FROM documents WHERE document_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ingested_at DESC NULLS LAST, doc_id DESC) = 1""")
def latest_delivery(spark: SparkSession, sf: str) -> DataFrame:
    """The current state of the append-only document log."""
    d = table(spark, sf, "documents").filter("document_id IS NOT NULL")
    return submission.latest(d, ["document_id"], ["ingested_at", "doc_id"]).select("document_id", "doc_id", "ingested_at")


@registry("""WITH e AS (SELECT video_id, source_type, doc_id, text, row_number() OVER (PARTITION BY video_id, source_type ORDER BY keyframe_id NULLS LAST, doc_id) AS n FROM documents WHERE regexp_matches(text, '\\S'))
SELECT video_id, source_type, doc_id, source_type || ':' || video_id || ':' || substring(sha256(doc_id::VARCHAR), 1, 16) AS evidence_id, n FROM e WHERE n <= 8""")
def evidence_pack(spark: SparkSession, sf: str) -> DataFrame:
    """The first eight pieces of evidence per video and modality, with stable ids."""
    d = table(spark, sf, "documents").filter(F.col("text").rlike(r"\S"))
    r = ranking.rank_by(d, ["video_id", "source_type"], [F.col("keyframe_id").asc_nulls_last(), F.col("doc_id")], "n", 8)
    key = F.concat(F.col("source_type"), F.lit(":"), F.col("video_id"), F.lit(":"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16))
    return r.select("video_id", "source_type", "doc_id", key.alias("evidence_id"), "n")


@registry("""SELECT video_id, count(*) AS rows, bit_xor(('0x' || substring(sha256(coalesce(text_raw, '') || '|' || ocr_id), 1, 15))::BIGINT) AS x0, bit_xor(('0x' || substring(sha256(coalesce(text_raw, '') || '|' || ocr_id), 16, 15))::BIGINT) AS x1 FROM ocr GROUP BY 1""")
def group_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """A digest per video that tells a stale index, independent of the order of rows."""
    item = F.concat(F.coalesce("text_raw", F.lit("")), F.lit("|"), F.col("ocr_id").cast("string"))
    return corpus.fingerprint(table(spark, sf, "ocr"), ["video_id"], item)


@registry("""SELECT asr_id, CASE WHEN end_time IS NULL OR start_time IS NULL THEN NULL ELSE round(greatest(start_time - pts_time, pts_time - end_time, 0), 6) END AS distance,
  CASE WHEN end_time - start_time <= 60 THEN 'short' WHEN end_time - start_time <= 300 THEN 'medium' WHEN end_time - start_time IS NOT NULL THEN 'long' END AS span FROM asr WHERE pts_time IS NOT NULL""")
def interval_distances(spark: SparkSession, sf: str) -> DataFrame:
    """How far the stored frame lies from its segment; null where the segment has no bounds."""
    from vidsift.plans.planner import gap_class

    a = table(spark, sf, "asr").filter("pts_time IS NOT NULL")
    d = F.when(F.col("start_time").isNotNull() & F.col("end_time").isNotNull(), F.round(V.interval_distance(F.col("pts_time"), F.col("start_time"), F.col("end_time")), 6))
    return a.select("asr_id", d.alias("distance"), gap_class(F.col("end_time") - F.col("start_time")).alias("span"))


@registry("SELECT DISTINCT video_id, keyframe_id FROM keyframes ANTI JOIN detections USING (video_id, keyframe_id)")
def frames_without_detections(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "detections").select("video_id", "keyframe_id").distinct()
    return table(spark, sf, "keyframes").select("video_id", "keyframe_id").distinct().join(d, ["video_id", "keyframe_id"], "left_anti")


@registry("""WITH p AS (SELECT 'query-' || query_vec_id || '-trake' AS query_id, video_id, list(keyframe_id::BIGINT ORDER BY result_rank, keyframe_id) AS f FROM fused_results GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY video_id) AS row_no FROM p)
SELECT query_id, row_no, code, CASE code WHEN 'FRAME_ORDER_FALLBACK' THEN 'WARNING' ELSE 'ERROR' END AS severity FROM (
  SELECT query_id, row_no, unnest([CASE WHEN NOT regexp_matches(video_id, '^L\\d{2}_V\\d{3}$') THEN 'INVALID_VIDEO_ID' END, CASE WHEN len(f) <> 3 THEN 'INVALID_COLUMN_COUNT' END,
    CASE WHEN len(f) > 1 AND list_bool_or(list_transform(range(1, len(f)), lambda i: f[i] >= f[i + 1])) THEN 'FRAME_ORDER_FALLBACK' END]) AS code FROM n) WHERE code IS NOT NULL""")
def submission_validate_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Each query's frames of a video as an ordered answer of three events."""
    f = table(spark, sf, "fused_results").withColumn("query_id", F.concat(F.lit("query-"), F.col("query_vec_id").cast("string"), F.lit("-trake")))
    seq = F.transform(F.array_sort(F.collect_list(F.struct("result_rank", F.col("keyframe_id").cast("long").alias("k")))), lambda x: x["k"])
    p = ranking.rank_by(f.groupBy("query_id", "video_id").agg(seq.alias("frame_ids")), ["query_id"], [F.col("video_id")], "row_no")
    return submission.prediction_issues(p.withColumns({"task": F.lit("TRAKE"), "answer": F.lit(None).cast("string"), "event_count": F.lit(3)}))
