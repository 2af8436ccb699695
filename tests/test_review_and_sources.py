"""Chosen frames, chains to show, exports, two-stage localisation, several retrievers, settings, payloads, manifests and submissions."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidsift.operators import audit, evaluate, fusion, localise, ranking, review
from vidsift.plans import payloads, settings
from vidsift.sources import readers, writers


def test_selected_frames(spark):
    refs = spark.createDataFrame([("A", 3), ("A", 1), ("B", 7)], "video_id string, keyframe_id int")
    asked = spark.createDataFrame([(1, "A", 3), (2, "A", None), (3, "B", 8), (4, "C", 1)], "request_id int, video_id string, keyframe_id int")
    got = {r.request_id: (r.keyframe_id, r.status) for r in review.selected_frames(asked, refs).collect()}
    assert got == {1: (3, "SELECTED"), 2: (1, "SELECTED"), 3: (None, "NOT_IN_INDEX"), 4: (None, "NOT_IN_INDEX")}


def test_trigger_reasons(spark):
    d = spark.createDataFrame([([0.9, 0.87], [0.9], [0.9], False), ([0.9, 0.5], [0.3], [0.6], True), ([0.9], None, None, None)], "s array<double>, l array<double>, c array<double>, o boolean")
    got = [r.x for r in d.select(review.trigger_reasons(F.col("s"), F.col("l"), F.col("c"), F.col("o")).alias("x")).collect()]
    assert got == [["SMALL_TOP1_TOP2_MARGIN"], ["LOW_LINKAGE", "LOW_EVENT_CONFIDENCE", "OOD_EVENT"], []]


def test_safe_chains(spark):
    chains = spark.createDataFrame([(1, c, i) for i, c in enumerate("abcde", 1)], "request_id int, chain_id string, rank int")
    steps = [(1, "a", "x", 1, "V", 1.0), (1, "a", "y", 2, "V", 2.0), (1, "b", "x", 1, "V", 1.0), (1, "b", "y", 2, "W", 2.0), (1, "c", "x", 1, "V", 2.0), (1, "c", "y", 2, "V", 2.0),
             (1, "d", "x", 1, "V", 1.0), (1, "d", "y", 2, "V", None), (1, "e", "x", 1, "V", 1.0), (1, "e", "y", 2, "V", 3.0)]
    s = spark.createDataFrame(steps, "request_id int, chain_id string, event_id string, event_order int, video_id string, t double")
    assert {r.chain_id for r in review.safe_chains(chains, s, ["x", "y"], top=5).collect()} == {"a", "e"}
    assert {r.chain_id for r in review.safe_chains(chains, s, ["x", "y"], top=4).collect()} == {"a"}


def test_exports_and_payloads(spark):
    rows = [(1, 5, "V", 9, "x", "q?", {"a": "1", "b": None}, 1), (2, 5, "V", 9, "y", "q?", None, 2), (3, 6, "V", 9, None, None, {"export_id": "own"}, None)]
    d = spark.createDataFrame(rows, "export_id long, query_id long, video_id string, frame_id int, answer string, question string, metadata map<string,string>, exported_at int")
    got = {r.query_id: (r.answer, r.metadata) for r in review.export_candidates(d).collect()}
    assert got["5"] == ("y", {"export_id": "2", "question": "q?"}) and got["6"][1]["export_id"] == "own"
    m = spark.createDataFrame([({"title": "x", "author": "", "keywords": "[]", "secret": "s", "duration": None},), (None,)], "m map<string,string>")
    assert [r.c for r in m.select(review.clean_payload(F.col("m")).alias("c")).collect()] == [{"title": "x"}, None]


def test_spaced_equals_loop_over_all_rows(spark):
    rng = random.Random(5)
    rows = [(q, r, None if rng.random() < 0.05 else rng.uniform(0, 400)) for q in range(4) for r in range(1, 1500 if q == 0 else 40)]
    d = spark.createDataFrame(rows, "q int, rank int, t double")
    got = sorted((r.q, r.spaced_rank, r["rank"], r.is_spaced) for r in ranking.spaced(d, ["q"], "t", "rank", 50.0, 9).collect())
    want = []
    for q in range(4):
        taken, rest = [], []
        for _, r, t in sorted(x for x in rows if x[0] == q):
            if len(taken) < 9 and t is not None and all(abs(t - k) >= 50.0 for _, k in taken):
                taken.append((r, t))
            else:
                rest.append(r)
        out = [(r, True) for r, _ in taken] + [(r, False) for r in rest[: 9 - len(taken)]]
        want += [(q, i, r, ok) for i, (r, ok) in enumerate(out, 1)]
    assert got == want


def test_following_rows_across_buckets(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["A", "B", None]), None if i == 5 else rng.randrange(60), i) for i in range(90)]
    d = spark.createDataFrame(rows, "v string, o int, i int")
    want = {}
    for v in ("A", "B", None):
        own = sorted((r for r in rows if r[0] == v), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {a[2]: b[2] for a, b in zip(own, own[1:])} | {own[-1][2]: None}
    for width in (1, 7, 1000):
        got = {r.i: r.next.i if r.next else None for r in ranking.following(d, ["v"], "o", "i", ["i"], width).collect()}
        assert got == want


def test_two_stages(spark):
    coarse = spark.createDataFrame([("V", float(t), s) for t, s in ((0, 0.1), (1, 0.9), (2, 0.8), (9, 0.7), (10, None))], "video_id string, t double, score double")
    fine = spark.createDataFrame([("V", 1.25, 0.95), ("V", 1.5, 0.2), ("V", 5.0, 0.99), ("V", 9.1, 0.75), ("W", 1.0, 1.0)], "video_id string, t double, score double")
    got = localise.two_stage(coarse, fine, ["video_id"], anchors=3, window=0.5, gap=0.5, keep=3, fps=25.0).orderBy("rank").collect()
    assert [(r.t, r.is_spaced) for r in got] == [(1.25, True), (2.0, True), (9.1, True)] and got[0].frame_idx == 31
    best = localise.refined_events(coarse, fine, ["video_id"], 1.0, 25.0).first()
    assert (best.coarse_t, best.t, best.score) == (1.0, 1.25, 0.95)
    e = spark.createDataFrame([("V", "e1", 2.0)], "video_id string, event_id string, at double")
    s = coarse.withColumn("event_id", F.lit("e1"))
    assert [r.t for r in localise.dense_candidates(e, s, 2.0, top=2).orderBy("rank").collect()] == [1.0, 2.0]


def test_several_retrievers(spark):
    hits = lambda *v: spark.createDataFrame([(1, i, x, f"d{i}") for i, x in enumerate(v, 1)], "query_id int, rank int, video_id string, document_id string")

    def broken(n):
        raise OSError("down")

    out, failed = fusion.hybrid({"bge": lambda n: hits("V1", "V1", "V2"), "bm25": lambda n: hits("V2", "V1"), "clip": broken}, 5)
    assert [r.video_id for r in out.orderBy("rank").collect()] == ["V1", "V2"] and failed == {"clip": "OSError: down"}
    with pytest.raises(OSError):
        fusion.hybrid({"bge": lambda n: hits("V1"), "clip": broken}, 5, strict=True)
    with pytest.raises(OSError):
        fusion.hybrid({"clip": broken}, 5)
    assert [fusion.channel_pool(k) for k in (5, 300, 5000)] == [200, 300, 1000]


def test_refined_frames(spark):
    clip = spark.createDataFrame([(1, "V", 10, 1), (1, "V", 20, 2)], "query_id int, video_id string, keyframe_id int, rank int")
    text = spark.createDataFrame([(1, "bm25", "V", 20, 20.0, 1, None), (1, "bm25", "V", None, 29.0, 2, None), (1, "bge", "V", 20, 20.0, 9, 90.0), (1, "bge", "V", None, None, 1, None)], "query_id int, channel string, video_id string, keyframe_id int, t double, rank int, seed_t double")
    refs = spark.createDataFrame([("V", k, float(k)) for k in (10, 20, 30)] + [("V", 40, None)], "video_id string, keyframe_id int, t double")
    got = [(r.keyframe_id, round(r.score, 6), r.channels) for r in fusion.refined_frames(clip, text, refs, radius=15.0, limit=5).orderBy("rank").collect()]
    assert got == [(20, round(1 / 62 + 1 / 61, 6), "bm25,clip"), (10, round(1 / 61, 6), "clip"), (30, round(1 / 62, 6), "bm25")]


def test_ablations_and_failure_stages(spark):
    hits = spark.createDataFrame([(1, "a", 1, "X"), (1, "a", 2, "Y"), (1, "b", 1, "Y"), (2, "a", 1, "Z")], "query_id int, channel string, rank int, video_id string")
    rel = spark.createDataFrame([(1, "Y"), (2, "Q")], "query_id int, video_id string")
    got = {r.configuration: (r.queries, r.mrr, r.hit_1) for r in evaluate.ablations(hits, {"a": {"a": 1.0}, "ab": {"a": 1.0, "b": 1.0}, "b": {"b": 1.0, "a": 0.0}}, rel).collect()}
    assert got == {"a": (2, 0.25, 0.0), "ab": (2, 0.5, 0.5), "b": (2, 0.5, 0.5)}
    rows = [(False, 1.0, True, True, True, 1.0, 0.0), (True, 0.5, True, True, True, 1.0, 0.0), (True, 1.0, False, True, True, 1.0, 0.0), (True, None, True, False, True, 1.0, 0.0), (True, 1.0, True, True, None, 1.0, 0.0), (True, 1.0, True, True, True, 0.5, 0.0), (True, 1.0, True, True, True, 1.0, 5.5), (True, 1.0, True, True, True, 1.0, 5.0)]
    d = spark.createDataFrame(rows, "session boolean, event_recall double, top boolean, has_chain boolean, right_video boolean, required_share double, worst_error double")
    d = d.withColumn("stage", evaluate.failure_stage(*[F.col(c) for c in d.columns]))
    assert [r.stage for r in d.collect()] == ["SESSION_NOT_PERSISTED", "EVENT_RECALL_FAILURE", "VIDEO_RECALL_FAILURE", "TEMPORAL_FEASIBILITY_FAILURE", "WRONG_VIDEO", "REQUIRED_EVENT_MISSING", "FRAME_GRANULARITY_FAILURE", None]
    assert evaluate.alignment_metrics(d.withColumn("k", F.lit(1)), ["k"]).first().passed == 1
    r = spark.createDataFrame([("EDITED", True, ["e"], 5, 1, 9), ("REJECTED", False, None, 5, 6, 9), (None, True, [], 5, None, None)], "decision string, confirmed boolean, evidence_ids array<string>, frame int, frame_from int, frame_to int")
    m = evaluate.review_metrics(r.withColumn("k", F.lit(1)), ["k"]).first()
    assert (m.edit_rate, m.reject_rate, m.evidence_coverage, m.unsupported_rate, m.frame_accuracy) == (0.5, 0.5, 0.5, 0.5, 0.5)


def test_annotations_and_artifacts(spark):
    schema = "query_id string, query_text string, question_type string, expected_videos array<string>, expected_answers array<string>, modalities array<string>, time_ranges array<struct<start:double,end:double>>, annotator string, annotated_at string, answerable boolean"
    good = ("q1", "t", "ocr", ["L21_V001"], ["x"], ["keyframe", "ocr"], [(1.0, 2.0)], "me", "2024", True)
    bad = (" ", None, "poem", ["V1"], [" ", "y" * 101], ["smell"], [(2.0, 1.0)], None, None, None)
    free = ("q3", "t", "asr", [], [], [], [], "me", "2024", False)
    got = {}
    for r in audit.issues(spark.createDataFrame([good, bad, free], schema), ["query_id"], audit.annotation_rules()).collect():
        got.setdefault(r.query_id, set()).add(r.code)
    assert set(got) == {" "} and got[" "] == {"QUERY_ID_REQUIRED", "QUERY_TEXT_REQUIRED", "UNSUPPORTED_QUESTION_TYPE", "INVALID_VIDEO_ID", "ANSWER_TOO_LONG", "KEYFRAME_EVIDENCE_REQUIRED", "UNSUPPORTED_MODALITY", "INVALID_RANGE", "ANNOTATOR_REQUIRED"}
    f = lambda rows: spark.createDataFrame(rows, "k string, f string")
    assert {r.k: r.status for r in audit.staleness(f([("a", "1"), ("b", "1"), ("c", None)]), f([("a", "1"), ("b", "2"), ("d", "9")]), ["k"], "f").collect()} == {"a": "READY", "b": "STALE", "c": "MISSING", "d": "UNLISTED"}


def test_settings():
    s = settings.load({"temporal": {"beam": 7, "videos": 9}, "fusion": {"weights": {"clip": 1.0}}}, {"temporal": {"beam": 8}, "fusion": {"weights": {"ocr": 0.5}}})
    assert (s.temporal.beam, s.temporal.videos, s.retrieval.default) == (8, 9, 100) and s.fusion.weights == {"clip": 1.0, "ocr": 0.5}
    for bad in ({"temporal": {"beam": 2}}, {"temporal": {"alignment": "x"}}, {"retrieval": {"least": 300}}, {"fusion": {"k": 0}}, {"reranking": {"weights": {"a": -1.0}}}, {"retrieval": {"most": True}}, {"x": {}}, {"review": {"y": 1}}):
        with pytest.raises(ValueError):
            settings.load(bad)
    assert settings.load({"temporal": {"default_gap_seconds": None}}).temporal.default_gap_seconds is None


def test_external_plans_and_nested_texts(spark):
    good = '```json\n{"clip_query": "a  man", "clip_queries": ["A man", "a dog"], "routes": ["bm25", "clip"], "reasons": ["r", " "], "secret": 1}\n```'
    d = spark.createDataFrame([(good,), ("no",), ("[1]",), ('{"routes": ["web"]}',), ('{"routes": ["clip"], "clip_queries": [1]}',), (None,)], "a string")
    got = [r.p for r in d.select(payloads.guarded_plan(F.col("a"), F.lit("biển hiệu")).alias("p")).collect()]
    assert got[0].clip_queries == ["a man", "a dog"] and got[0].routes == ["bm25"] and got[0].intent == "lexical_text" and got[0].error is None and got[0].reasons[0] == "r"
    assert [p.error for p in got[1:]] == ["NOT_JSON", "NOT_AN_OBJECT", "INVALID_ROUTES", "INVALID_QUERIES", "NOT_JSON"] and got[1].clip_queries == ["biển hiệu"]
    t = spark.createDataFrame([('{"a": ["x", {"b": "y", "c": 3}], "d": null}',), ('"z"',), ("{",), (None,)], "j string")
    assert [r.t for r in t.select(payloads.nested_texts("j").alias("t")).collect()] == [["x", "y"], ["z"], None, None]


def test_matrix_headers(spark, tmp_path):
    np.save(tmp_path / "L21_V001.npy", np.zeros((7, 3), np.float16))
    np.save(tmp_path / "L21_V002.npy", np.zeros(5, np.float32))
    got = {r.video_id: (r.rows, r.dims, r.dtype) for r in readers.npy_headers(spark, str(tmp_path)).collect()}
    assert got == {"L21_V001": (7, 3, "float16"), "L21_V002": (5, 1, "float32")}


def test_consolidated_lines(spark, tmp_path):
    frame = {"schema_version": "v2", "collection_id": "L21", "video_id": "L21_V001", "keyframe_id": "L21_V001_F120", "timestamp_ms": 4800, "status": "ok", "image": {"width": 100, "height": 50}}
    box = {"text": " Thời sự ", "recognizer_confidence": 1.4, "bbox": [10, 5, 60, 30]}
    lines = [
        {**frame, "retrieval_text": "Thời sự", "retrieval_detections": [box, {**box, "text": "THỜI SỰ!"}, {"text": " "}]},
        {**frame, "keyframe_id": "x", "frame_number": 7, "retrieval_text": "khác", "retrieval_detections": [box]},
        {**frame, "video_id": "L22_V001"}, {**frame, "keyframe_id": "y", "retrieval_text": "", "retrieval_detections": None},
    ]
    (tmp_path / "o.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    texts, left = readers.consolidated_ocr(spark, str(tmp_path / "o.jsonl"), "L21")
    got = sorted((r.source_keyframe_id, r.source_frame_idx, r.text, r.confidence, r.is_reviewed, r.bbox_json) for r in texts.collect())
    corners = "[[0.1,0.1],[0.6,0.1],[0.6,0.6],[0.1,0.6]]"
    # both spellings together differ from the reviewed text, so it counts as well
    assert got == [
        ("L21_V001_F120", 120, "Thời sự", 1.0, False, corners), ("L21_V001_F120", 120, "Thời sự", 1.0, True, readers.WHOLE_IMAGE),
        ("x", 7, "Thời sự", 1.0, False, corners), ("x", 7, "khác", 1.0, True, readers.WHOLE_IMAGE),
    ]
    assert {r.reason: r.lines for r in left.collect()} == {"IDENTITY_MISMATCH": 1, "NOT_PARSED": 1}


def test_versions_manifests_and_submissions(spark, tmp_path):
    target = str(tmp_path / "t")
    assert writers.manifest_issues(spark, target, {}) == ["missing _CURRENT"]
    first = writers.publish(spark.range(3), target, lambda d: True, manifest={"rows": 3})
    assert writers.manifest_issues(spark, target, {"rows": 3}) == [] and writers.manifest_issues(spark, target, {"rows": 4}) == ["stale rows"]
    writers.publish(spark.range(5), target, lambda d: d.count() == 5)
    assert writers.published(spark, target).count() == 5 and spark.read.parquet(f"{first}/data").count() == 3
    assert writers.manifest_issues(spark, target, {}) == ["missing manifest.json"]
    with pytest.raises(FileNotFoundError):
        writers.published(spark, str(tmp_path / "none"))
    lines = spark.createDataFrame([("query-2-kis", 2, "V, 2"), ("query-2-kis", 1, "V, 1"), ("query-1-qa", 1, 'V, 1, "x"')], "query_id string, row_no int, line string")
    path = str(tmp_path / "s.zip")
    assert writers.zipped(lines, path) == ["query-1-qa.csv", "query-2-kis.csv"]
    assert writers.zip_layout(path, ["query-2-kis.csv", "query-3-kis.csv"]) == {"missing": ["query-3-kis.csv"], "unexpected": ["query-1-qa.csv"]}
    spark.createDataFrame([("L21_V1",), ("L22_V1",)], "video_id string").write.parquet(str(tmp_path / "a"))
    writers.copied(spark, str(tmp_path / "a"), str(tmp_path / "b"), "L21_")
    assert [r.video_id for r in spark.read.parquet(str(tmp_path / "b")).collect()] == ["L21_V1"]
