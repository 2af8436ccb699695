"""Operators without an SQL form against plain loops, and fixtures of the order-dependent ones."""

import itertools
import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vidsift.functions import text as T
from vidsift.functions import vectors as V
from vidsift.operators import audit, candidates, evaluate, fusion, lexical, metadata, objects, ranking, submission, temporal, vector

D = "video_id string, keyframe_id int, label_normalized string, confidence double, bbox_y1 double, bbox_x1 double, bbox_y2 double, bbox_x2 double"


def iou(a, b):
    h = max(0, min(a[2], b[2]) - max(a[0], b[0]))
    w = max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - h * w
    return h * w / union if union > 0 else 0.0


def test_suppression_equals_plain_loop(spark):
    rng = random.Random(3)
    rows = []
    for frame in range(6):
        for _ in range(25):
            y, x = rng.random() * 0.5, rng.random() * 0.5
            rows.append(("V", frame, rng.choice(["a", "b", None]), rng.choice([0.3, 0.5, 0.9, math.nan, None]), y, x, y + 0.3 * rng.random(), x + 0.3 * rng.random()))
    rows += rows[:20]
    got = {(r.keyframe_id, r.label_normalized, r.y1, r.x1, r.y2, r.x2) for r in objects.suppressed(spark.createDataFrame(rows, D), 0.2, 0.4).collect()}
    want = set()
    ok = sorted({r for r in rows if r[2] and r[3] and not math.isnan(r[3])}, key=lambda r: (-r[3], r[4:]))
    for f, label in itertools.product(range(6), "ab"):
        kept = []
        for r in ok:
            if r[1] == f and r[2] == label and all(iou(r[4:], k) <= 0.4 for k in kept):
                kept.append(r[4:])
        want |= {(f, label, *k) for k in kept}
    assert got == want


def test_two_overlapping_boxes_one_kept(spark):
    rows = [("V", 1, "person", 0.9, 0.0, 0.0, 0.5, 0.5), ("V", 1, "person", 0.8, 0.0, 0.0, 0.5, 0.49), ("V", 1, "person", 0.7, 0.6, 0.6, 0.9, 0.9)]
    assert objects.suppressed(spark.createDataFrame(rows, D), 0.1).count() == 2


def test_a_prefix_decides_the_first_boxes(spark):
    """A frame of many boxes, most of them suppressed: the first ones are the same whichever way."""
    rng = random.Random(8)
    rows = [("V", 0, "x", round(rng.random(), 3), 0.1 + rng.random() * 0.05, 0.1, 0.5, 0.5) for _ in range(300)] + [("V", 0, rng.choice("yz"), 0.05, k / 100, k / 100, k / 100 + 0.01, k / 100 + 0.01) for k in range(60)]
    rows += [("V", 1, "x", 0.5, 0.1, 0.1, 0.2, 0.2)]
    d = spark.createDataFrame(rows, "video_id string, keyframe_id int, label_normalized string, confidence double, bbox_y1 double, bbox_x1 double, bbox_y2 double, bbox_x2 double")
    whole = [sorted(map(tuple, objects.suppressed(d, 0.0, keep=20, prefix=n).collect())) for n in (1, 50, 320, 10_000)]
    assert all(w == whole[0] for w in whole) and len(whole[0]) == 21


def test_regions(spark):
    d = spark.createDataFrame([(0.329999,), (0.33,), (0.659999,), (0.66,), (None,)], "x double")
    assert [r[0] for r in d.select(V.horizontal_region(F.col("x"))).collect()] == ["left", "center", "center", "right", None]


def brute(cands, events, most_gap):
    out = []
    for path in itertools.product(*[[c for c in cands if c[0] == e] for e in events]):
        if all(a[1] == b[1] for a, b in zip(path, path[1:])):
            gaps = [b[3] - a[3] for a, b in zip(path, path[1:])]
            if all(0 < g <= most_gap for g in gaps):
                out.append((path[0][1], round(sum(c[4] for c in path) - sum(0.25 * g / (g + 60) for g in gaps), 6), ">".join(str(c[2]) for c in path)))
    return out


def test_alignment_equals_all_paths(spark):
    rng = random.Random(5)
    cands = [(e, v, i, rng.randrange(100) / 2, rng.randrange(10) / 10) for i, (e, v) in enumerate((e, v) for e in "abc" for v in ("V1", "V2") for _ in range(5))]
    df = spark.createDataFrame(cands, "event_id string, video_id string, candidate_id long, t double, local_score double")
    got = {(r.video_id, round(r.objective, 6), r.path) for r in temporal.align(df, list("abc"), most_gap=20.0, beam=1000, top=1000).collect()}
    assert got == set(brute(cands, "abc", 20.0))


def test_best_chain_beats_greedy(spark):
    rows = [("e1", "V", 9, 9.0, 1.0), ("e1", "V", 1, 1.0, 0.8), ("e2", "V", 8, 8.0, 1.0)]
    df = spark.createDataFrame(rows, "event_id string, video_id string, candidate_id long, t double, local_score double")
    assert temporal.align(df, ["e1", "e2"], top=1).first().path == "1>8"
    assert [r.status for r in temporal.feasible(df, ["e1", "e3"]).collect()] == ["REQUIRED_EVENT_MISSING:e3"]
    assert [r.status for r in temporal.feasible(df.filter("candidate_id > 7"), ["e1", "e2"]).collect()] == ["NO_MONOTONIC_REQUIRED_PATH"]


def test_nearest_prefers_smaller_ref_on_ties(spark):
    refs = spark.createDataFrame([("V", 0.0, 0), ("V", 1.0, 1), ("V", 3.0, 2)], "entity string, t double, ref int")
    points = spark.createDataFrame([("V", 1, 0.9), ("V", 2, 2.0), ("V", 3, 9.0), ("W", 4, 1.0), ("V", 5, None)], "entity string, id long, t double")
    got = {r.id: (r.ref, round(r.distance, 6)) for r in temporal.asof_nearest(points, refs, 5.0).collect()}
    assert got == {1: (1, 0.1), 2: (1, 1.0)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 40)), min_size=1, max_size=30), st.lists(st.integers(0, 300), min_size=1, max_size=20))
def test_nearest_equals_scan(spark, refs, points):
    r = spark.createDataFrame([("V", t / 2, i) for t, i in refs], "entity string, t double, ref int")
    p = spark.createDataFrame([("V", i, t / 2) for i, t in enumerate(points)], "entity string, id long, t double")
    got = {x.id: (x.distance, x.ref) for x in temporal.asof_nearest(p, r.groupBy("entity", "t").agg(F.min("ref").alias("ref")), 20.0, span=41.0).collect()}
    want = {i: min((abs(t / 2 - rt / 2), ref) for rt, ref in refs) for i, t in enumerate(points)}
    assert got == {i: w for i, w in want.items() if w[0] <= 20}


def test_rrf_fixture(spark):
    hits = [(1, "bge", 1, "V1", "a"), (1, "bge", 2, "V1", "b"), (1, "bge", 3, "V2", "c"), (1, "bm25", 1, "V2", "d"), (1, "bm25", 2, "V1", "e")]
    out = fusion.rrf_videos(spark.createDataFrame(hits, "query_id int, channel string, rank int, video_id string, document_id string")).orderBy("rank").collect()
    assert [r.video_id for r in out] == ["V1", "V2"]
    assert abs(out[0].score - (1 / 61 + 1 / 62)) < 1e-12 and abs(out[1].score - (1 / 61 + 1 / 62)) < 1e-12


def test_suppress_texts_counts_kept_rows_only(spark):
    rows = [(1, "V", r, t) for r, t in enumerate(["a", "a", "b", "", "", "c", "d"], start=1)]
    out = ranking.suppress_texts(spark.createDataFrame(rows, "query_id int, video_id string, rank int, text string"), "text").orderBy("rank").collect()
    assert [r.text for r in out] == ["a", "b", "", ""]


def test_spaced_fills_up(spark):
    rows = [(1, i, float(t), i) for i, t in enumerate([10, 11, 50, 12, 90], start=1)]
    out = ranking.spaced(spark.createDataFrame(rows, "query_id int, id int, t double, rank int"), ["query_id"], "t", "rank", 5.0, 4).orderBy("spaced_rank").collect()
    assert [(r.id, r.is_spaced) for r in out] == [(1, True), (3, True), (5, True), (2, False)]


def test_rescue_keeps_head_and_lifts_lanes(spark):
    fused = spark.createDataFrame([(1, f"V{i}", i) for i in range(1, 9)], "query_id int, video_id string, rank long")
    lanes = spark.createDataFrame([(1, 0, "V8", 1), (1, 0, "V7", 2), (1, 1, "V6", 1), (1, 1, "X", 2)], "query_id int, lane int, video_id string, rank int")
    seq = spark.createDataFrame([(1, "V5", 1), (1, "X", 2)], "query_id int, video_id string, rank int")
    out = ranking.rescue(fused, lanes, seq, window=7).orderBy("rank").collect()
    assert [r.video_id for r in out] == ["V1", "V2", "V3", "V5", "V8", "V6", "V7", "V4"]


def test_metrics_fixture(spark):
    hits = spark.createDataFrame([(1, "V1", 1), (1, "V2", 2), (2, "V1", 1), (2, "V2", 2), (3, "V1", 1)], "query_id int, video_id string, rank int")
    qrels = spark.createDataFrame([(1, "V1"), (2, "V2")], "query_id int, video_id string")
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    m = {r.query_id: r for r in evaluate.rank_metrics(hits, qrels, q).collect()}
    assert (m[1].rr, m[2].rr, m[3].rr, m[3].ndcg) == (1.0, 0.5, None, None)
    mean = evaluate.mean_metrics(evaluate.rank_metrics(hits, qrels, q)).first()
    assert (mean.mean_rr, mean.mean_hit_1, mean.mean_hit_5, mean.judged) == (0.75, 0.5, 1.0, 2)


def test_percentiles_round_half_to_even(spark):
    d = spark.createDataFrame([("a", float(i)) for i in range(1, 5)], "g string, v double")
    assert evaluate.nearest_rank(d, ["g"], "v", {"p": 0.5}).first().p == 3.0
    assert evaluate.nearest_rank(d.filter("v < 4"), ["g"], "v", {"p": 0.25}).first().p == 1.0


def test_video_scores_order(spark):
    rows = [(1, 1, 0.9, "V2", "a"), (1, 2, 0.8, "V1", "b"), (1, 3, 0.7, "V2", "c"), (1, 4, 0.6, "V3", "d")]
    out = vector.video_scores(spark.createDataFrame(rows, "query_id int, rank int, score double, video_id string, frame_key string")).orderBy("rank").collect()
    assert [(r.video_id, r.frame_count, r.frames) for r in out] == [("V2", 2, ["a", "c"]), ("V1", 1, ["b"]), ("V3", 1, ["d"])]


def test_cosine_skips_unusable_and_breaks_ties_by_key(spark):
    index = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [0.0, 1.0])], "id long, v array<double>")
    q = spark.createDataFrame([(9, [5.0, 0.0]), (8, [0.0, 0.0])], "id long, v array<double>")
    out = vector.cosine_topk(index, q, key="id", vector="v", query_key="id", query_vector="v", k=3, dims=2).orderBy("rank").collect()
    assert [(r.query_id, r.id) for r in out] == [(9, 1), (9, 3), (9, 7)]


def test_bm25_finds_exact_term(spark):
    docs = spark.createDataFrame([(1, "thời sự 19h"), (2, "bản tin thể thao"), (3, None), (4, "")], "id long, t string")
    q = spark.createDataFrame([(1, "THỜI SỰ")], "query_id int, query_text string")
    out = lexical.bm25(docs, q, doc_id="id", fields={"t": "t"}).collect()
    assert [(r.doc_id, r.matched_terms) for r in out] == [(1, 2)]


def test_text_functions(spark):
    one = spark.createDataFrame([("Ngày 1/8/2024: “Bóng ĐÁ” then a man enters the door; hỏi mấy?", "ngay 1 thang 8 nam 2024", "20240801", "12 kg", "Điện thoại")], "a string, b string, c string, d string, e string")
    r = one.select(
        T.date_tokens(F.col("a"), F.col("b")).alias("dates"), T.parse_date(F.col("c")).alias("day"), T.quoted_phrases(F.col("a")).alias("q"), T.color_of(F.col("a")).alias("color"),
        T.question_scene(F.col("a")).alias("scene"), T.answer_alternatives(T.answer_canonical(F.col("d"))).alias("alt"), T.label_fold(F.col("e")).alias("label"),
        T.object_alias(T.label_fold(F.col("e"))).alias("alias"), T.fold_exact(F.col("e")).alias("fold"), T.event_fold(F.col("e")).alias("event"), T.search_fold(F.col("e")).alias("search"),
    ).first()
    assert r.dates == ["01082024"] and str(r.day) == "2024-08-01" and r.q == ["Bóng ĐÁ"] and r.color == "red"
    assert r.scene.endswith("the door") and r.alt == ["12kg"]
    assert (r.label, r.alias, r.fold, r.event, r.search) == ("ien thoai", "phone", "dien thoai", "đien thoai", "dien thoai")


def test_split_events_and_variants(spark):
    r = spark.createDataFrame([("a man opens the door sau đó the crowd cheers loudly. rồi tắt", )], "t string").select(T.split_events(F.col("t")).alias("e"), T.query_variants(F.col("t")).alias("v")).first()
    assert r.e == ["a man opens the door", "the crowd cheers loudly"] and r.v[0].startswith("a person opens")


def test_metadata_evidence(spark):
    docs = spark.createDataFrame([("A", "Bóng đá", "bong da"), ("B", "bong da", "bong da"), ("C", "x", "x")], "k string, t string, f string")
    out = metadata.constrained(docs, metadata.Constraints(title="bóng đá"), lambda p: "bong da", {"key": "k", "title": "t", "title_folded": "f"}).orderBy("rank").collect()
    assert [(r.k, r.evidence) for r in out] == [("A", "title=exact_original_phrase"), ("B", "title=normalized_accent_insensitive_phrase")]


def test_candidate_union_and_representatives(spark):
    s = "query_id int, video_id string, keyframe_id int, rank int, score double"
    clip = candidates.channel_hits(spark.createDataFrame([(1, "V1", 1, 1, 0.9), (1, "V1", 2, 2, 0.8), (1, "V2", 5, 3, 0.7)], s), "clip")
    obj = candidates.channel_hits(spark.createDataFrame([(1, "V1", 2, 1, 0.99), (1, "V3", 7, 2, 0.5)], s), "object")
    u = candidates.union_candidates([clip, obj])
    assert u.count() == 4
    both = u.filter("keyframe_id = 2").first()
    assert (both.clip_rank, both.object_rank, both.ocr_rank, both.provenance) == (2, 1, None, "clip,object")
    hard = candidates.apply_modes(u, {"object": "hard"})
    assert {r.keyframe_id for r in hard.collect()} == {2, 7}
    v = {r.video_id: r for r in candidates.structured_videos(u).collect()}
    assert v["V1"].rank == 1 and v["V1"].keyframe_id == 2 and v["V1"].frames == "2>1"
    best = spark.createDataFrame([(1, "V9", 3)], "query_id int, video_id string, keyframe_id int")
    f = candidates.fallback_frames(spark.createDataFrame([(1, "V9"), (1, "V1")], "query_id int, video_id string"), u, best).collect()
    assert [(r.video_id, r.keyframe_id, r.representative_only) for r in f] == [("V9", 3, True)]


def test_submission_codes(spark):
    s = "query_id string, task string, row_no int, video_id string, frame_ids array<long>, answer string, event_count int"
    rows = [
        ("query-1-kis", "KIS", 1, "L21_V001", [5], None, None), ("query-1-kis", "KIS", 2, "L21_V001", [5], None, None), ("query-1-qa", "QA", 1, "L21_V001", [5], "", None),
        ("query-2-qa", "QA", 1, "V1", [-1], "x" * 101, None), ("query-1-trake", "TRAKE", 1, "L21_V002", [5, 4], None, 3), ("q", "KIS", 1, "L21_V001", [5, 6], "a", None), ("query-9-kis", "FOO", 1, "L21_V001", [5], None, None),
    ]
    got = {(r.query_id, r.row_no, r.code) for r in submission.prediction_issues(spark.createDataFrame(rows, s)).collect()}
    assert got == {
        ("query-1-kis", 2, "DUPLICATE_PREDICTION"), ("query-1-qa", 1, "ANSWER_REQUIRED"), ("query-2-qa", 1, "INVALID_VIDEO_ID"), ("query-2-qa", 1, "INVALID_FRAME_ID"), ("query-2-qa", 1, "ANSWER_TOO_LONG"),
        ("query-1-trake", 1, "INVALID_COLUMN_COUNT"), ("query-1-trake", 1, "FRAME_ORDER_FALLBACK"), ("q", 1, "INVALID_QUERY_ID"), ("q", 1, "INVALID_COLUMN_COUNT"), ("q", 1, "UNEXPECTED_ANSWER"), ("query-9-kis", 1, "UNSUPPORTED_TASK"),
    }
    line = spark.createDataFrame([("QA", "L21_V001", [7], 'say "hi"'), ("TRAKE", "L21_V002", [1, 2], None)], "t string, v string, f array<long>, a string")
    assert [r[0] for r in line.select(submission.line(*[F.col(c) for c in "tvfa"])).collect()] == ['L21_V001, 7, "say ""hi"""', "L21_V002, 1, 2"]


def test_audit_roll_up(spark):
    d = spark.createDataFrame([("a", "OK"), ("a", "MISSING"), ("b", "OK")], "g string, s string")
    assert {(r.g, r.status) for r in audit.roll_up(d, ["g"], "s").collect()} == {("a", "MISSING"), ("b", "OK")}
    assert audit.expected_minimum({"x": 3, "y": 1, "z": 1}, {"x": 2, "z": 4}) == {"x": "WARNING", "y": "MISSING", "z": "OK"}


def test_proximity_uses_best_pair(spark):
    s = "video_id string, keyframe_id int, label_normalized string, confidence double, center_x double, center_y double"
    rows = [("V", 1, "phone", 0.9, 0.5, 0.5), ("V", 1, "hand", 0.4, 0.5, 0.6), ("V", 1, "hand", 0.9, 0.9, 0.9), ("V", 2, "phone", 0.9, 0.0, 0.0)]
    out = objects.proximity(spark.createDataFrame(rows, s), ["phone"], ["hand"], 0.1).collect()
    assert len(out) == 1 and abs(out[0].score - (1 - 0.1 / 0.35) * math.sqrt(0.36)) < 1e-6
