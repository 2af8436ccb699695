"""Chains, windows, guards, registry files, colours and grids on fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from vidsift.operators import answers, colors, evaluate, localise, sequences
from vidsift.sources import registry


def test_compact_chain_prefers_more_frames(spark):
    rows = [("a", "V", 1, 1.0, 1), ("b", "V", 2, 5.0, 3), ("b", "V", 3, 0.8, 1), ("c", "V", 4, 9.0, 2), ("a", "W", 5, 9.0, 1), ("b", "W", 6, 1.0, 1), ("b", "X", 7, None, 1)]
    h = spark.createDataFrame(rows, "lane string, video_id string, candidate_id long, t double, rank int")
    out = sequences.compact_chains(h, ["a", "b", "c"]).collect()
    # 3 lies 0.2 before 1, which the slack allows, and has the better rank
    assert [(r.video_id, r.path, r.frames) for r in out] == [("V", "1>3>4", 3)]


def test_windows_walk_from_the_anchor(spark):
    rows = [("a", "V", 1, 1.0, 0.5), ("a", "V", 2, 4.0, 0.5), ("b", "V", 3, 5.0, 0.9), ("c", "V", 4, 6.0, 0.2), ("c", "V", 5, 9.0, 0.8), ("b", "W", 6, 1.0, 1.0)]
    c = spark.createDataFrame(rows, "event_id string, video_id string, candidate_id long, t double, local_score double")
    w = sequences.windows(c, ["a", "b", "c"], "b", pad=5.0).collect()
    assert [(r.video_id, r.start, r.end, round(r.score, 6)) for r in w] == [("V", 0.0, 14.0, round((0.5 + 0.9 + 0.8) / 3, 6))]


def test_anchor_and_scores(spark):
    e = spark.createDataFrame([(1, "x", True, 0.5, 0.1, 2), (1, "y", True, 0.5, 0.1, 1), (1, "z", False, 0.9, 0.1, 0)], "request_id int, event_id string, required boolean, distinctiveness double, local_score double, event_order int")
    assert [r.event_id for r in sequences.anchor(e).collect()] == ["y"]
    one = spark.range(1).select(sequences.chain_score(*[F.lit(float(x)) for x in (2, 1, 1.5, 2, 1, 1, 1)]).alias("s"), sequences.weighted_mean({"a": F.lit(1.0), "b": F.lit(None).cast("double")}, {"a": 0.2, "b": 0.8}).alias("m")).first()
    assert abs(one.s - (4 + 0.5 + 1.5 + 0.06 - 0.25 - 0.15 - 1)) < 1e-12 and one.m == 1.0
    ch = spark.createDataFrame([(1, "p", True, 0.9, None, 0.5, None, None, 1.0), (1, "q", True, 0.2, 0.9, 0.5, None, None, 1.0), (1, "r", False, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], "k int, path string, complete boolean, semantic double, temporal double, linkage double, context double, multimodal double, coverage double")
    assert [(r.path, r.rank) for r in sequences.rerank_chains(ch, ["k"]).orderBy("rank").collect()] == [("p", 1), ("q", 2)]


def test_guard_rules(spark):
    s = "state string, answer string, selected array<string>, used array<string>, kind string, modalities array<string>"
    rows = [("UNSUPPORTED", "a", ["1"], ["1"], "ocr", ["ocr"]), ("OK", "", ["1"], [], "ocr", ["ocr"]), ("OK", "a", [], [], "ocr", []), ("OK", "a", ["1"], ["1", "2"], "ocr", ["ocr"]), ("OK", "a", ["1"], ["1"], "asr", ["ocr"]), ("OK", "a", ["1"], ["1"], "asr", ["asr"])]
    d = spark.createDataFrame(rows, s)
    got = [r[0] for r in d.select(answers.guard(*[F.col(c) for c in ("state", "answer", "selected", "used", "kind", "modalities")])).collect()]
    assert got == ["state", "no_answer", "nothing_selected", "evidence_not_selected", "speech_needs_asr", "ok"]
    sel = spark.createDataFrame([("a", "V"), ("a", "V"), ("b", "V"), ("b", "W"), ("c", None)], "k string, video_id string")
    assert {r.k: r.one_video for r in answers.one_video(sel, ["k"]).collect()} == {"a": True, "b": False, "c": False}


def test_registry_scan_and_files(spark, tmp_path):
    for p in ("clip-features/L21_V001.npy", "map-keyframes/L21_V001.csv", "objects/L21_V002/001.json", "keyframes/L21_V001/0001.jpg", "keyframes/L21_V001/0002.jpg"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    a = {r.video_id: r for r in registry.scan_assets(spark, str(tmp_path)).collect()}
    assert set(a) == {"L21_V001", "L21_V002"} and a["L21_V001"].keyframe_image_count == 2 and a["L21_V001"].object_path is None and a["L21_V002"].video_group == "L21"
    v = spark.createDataFrame([("A", 0, [1.0]), ("A", 1, [2.0]), ("B", 0, [3.0])], "video_id string, feature_row int, v array<double>")
    m = spark.createDataFrame([("A", 1, 0.0), ("A", 2, 1.0), ("B", 1, 0.0), ("B", 2, 1.0)], "video_id string, n int, pts_time double")
    assert sorted((r.video_id, r.feature_row, r.pts_time) for r in registry.features_with_frames(v, m).collect()) == [("A", 0, 0.0), ("A", 1, 1.0)]
    (tmp_path / "j.csv").write_text("query_id,query_text,rank,video_id,keyframe_id,manual_judgement\nq1,t,1,V,1,Good\nq1,t,2,V,2,\n")
    assert [r.manual_judgement for r in registry.judgements(spark, str(tmp_path / "j.csv")).collect()] == ["good", None]
    (tmp_path / "b.json").write_text(json.dumps([{"id": 1, "query": "x"}, {"query_id": "2", "text": "y"}]))
    assert sorted((r.query_id, r.query_text) for r in registry.benchmark_queries(spark, str(tmp_path / "b.json")).collect()) == [("1", "x"), ("2", "y")]
    (tmp_path / "c.jsonl").write_text('{"document_id": "a", "source_type": "asr", "video_id": "V", "text": "x"}\n{"document_id": "a", "source_type": "asr", "video_id": "V", "text": ""}\n')
    with pytest.raises(ValueError, match="repeated"):
        registry.checked_corpus(spark, str(tmp_path / "c.jsonl"))
    (tmp_path / "s.csv").write_text('L21_V001, 5, "a ""b"", c"\nL21_V001, x, "a"\nL21_V001, 5\n')
    got = sorted((r.issue or "", r.answer) for r in registry.official_rows(spark, str(tmp_path / "s.csv"), "QA").collect())
    assert got[0] == ("", 'a "b", c') and [g[0] for g in got[1:]] == ["INVALID_COLUMN_COUNT", "INVALID_FRAME_ID"]


def test_colors_and_signatures(spark):
    px = [("A", y, x, 4, 4, 200 if y < 2 else 10, 10, 10) for y in range(4) for x in range(4)]
    p = spark.createDataFrame(px, "k string, y int, x int, height int, width int, red int, green int, blue int")
    r = colors.color_search(p, ["k"], "red").first()
    assert (r.color_ratio, r.attribute_score, r["rank"]) == (0.5, 1.0, 1)
    # the crop keeps rows 0 to 2 and columns 0 to 2
    assert round(colors.color_search(p, ["k"], "red", "clothing").first().color_ratio, 6) == round(2 / 3, 6)
    assert abs(sum(x * x for x in colors.signatures(p, ["k"]).first().signature) - 1) < 1e-9


def test_sampling_and_thinning(spark):
    r = spark.range(1).select(localise.sampling_times(F.lit(-1.0), F.lit(2.0), 2.0, 4).alias("a"), localise.thinned(F.sequence(F.lit(0), F.lit(9)), 4).alias("b"), localise.thinned(F.sequence(F.lit(0), F.lit(9)), 1).alias("c")).first()
    assert r.a == [0.0, 0.5, 1.0, 1.5] and r.b == [0, 3, 6, 9] and r.c == [5]
    refs = spark.createDataFrame([("V", 0.0, 1, 0), ("V", 4.0, 2, 100)], "entity string, t double, ref long, frame_idx long")
    t = spark.createDataFrame([("V", 1, 4.5), ("V", 2, -9.0)], "entity string, id long, t double")
    assert {r.id: r.frame for r in localise.time_to_frame(t, refs, F.lit(25.0)).collect()} == {1: 112, 2: 0}


def test_interval_hits_and_determinism(spark):
    d = spark.createDataFrame([(1, 5.0, 4.0, 6.0), (1, 9.0, 4.0, 6.0)], "request_id int, t double, start double, end double")
    r = evaluate.interval_hits(d, [1, 3, 5]).first()
    assert (r.mean_error, r.within_1, r.within_3, r.within_5) == (1.5, 0.5, 1.0, 1.0)
    assert evaluate.same_results(d, d).count() == 0
