"""Rules that plan queries, against hand-made cases and plain loops."""

import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from vidsift.functions import text as T
from vidsift.operators import lexical
from vidsift.plans import planner


def plans(spark, *texts, **more):
    d = spark.createDataFrame(list(enumerate(texts)), "item_id int, query_text string")
    return [r for r in planner.plan_queries(d, **more).orderBy("item_id").collect()]


def test_modalities_objects_hints_and_variants(spark):
    held, sign, street = plans(
        spark, 'Người cầm điện thoại, sau đó nói "xin chào"', "biển hiệu chữ đỏ của kênh Tuổi Trẻ", "Cảnh quay chiếc xe màu trắng rẽ trái. Hỏi con số ghi trên hông xe là số mấy?"
    )
    assert {"clip", "objects", "asr"} <= set(held.modalities) and held.objects == ["phone", "person"]
    assert "sau đó" in held.temporal_hints and "xin chào" in held.variants and len(held.events) == 2
    assert {"clip", "ocr", "attributes", "metadata"} <= set(sign.modalities)
    assert "hỏi" not in street.visual_query and "số mấy" not in street.visual_query and "chiếc xe màu trắng rẽ trái" in street.visual_query
    assert {"clip", "ocr", "attributes"} <= set(street.modalities)


def test_decomposed_and_upper_case_queries_match_markers(spark):
    composed, apart = plans(spark, "NGƯỜI mặc áo ĐỎ nói", unicodedata.normalize("NFD", "NGƯỜI mặc áo ĐỎ nói"))
    assert composed.modalities == apart.modalities == ["clip", "objects", "attributes", "asr"]
    assert plans(spark, "a man holding a phone")[0].modalities == ["clip", "objects"]


def test_variants_are_bounded_and_can_be_chosen(spark):
    assert len(plans(spark, 'nói "a" rồi "b"', max_variants=1)[0].variants) == 1
    d = planner.plan_queries(spark.createDataFrame([('nói "xin chào"',)], "query_text string"))
    some = planner.select_variants(d, F.array(F.lit("xin chào"), F.lit("khác"))).first()
    none = planner.select_variants(d, F.array(F.lit("khác"))).first()
    assert some.variants == ["xin chào"] and none.variants == ['nói "xin chào"']


def test_null_empty_and_plain_queries(spark):
    nothing, empty, short = plans(spark, None, "", "mưa")
    assert nothing.visual_query is None and empty.routes == ["clip"] and short.events == ["mưa"]


def test_sources_and_warnings(spark):
    asked = "người dẫn nói gì về chữ trên bảng"
    cover = planner.Coverage(ocr_records=0, asr_segments=5, asr_videos=2, total_videos=9)
    r = plans(spark, asked, coverage=cover)[0]
    assert r.source_filters == ["asr", "ocr"] and r.warnings == ["ASR_PARTIAL", "OCR_UNAVAILABLE"] and r.intent == "mixed" and r.profile.endswith("_rrf")
    assert plans(spark, 'nói "xin chào"')[0].source_filters == ["asr"]  # quotes alone are speech here


def test_questions(spark):
    d = spark.createDataFrame([("What is the YouTube channel ID?",), ("which channel?",), ("Có bao nhiêu người?",), ("hmm",)], "q string")
    got = [tuple(r.r) for r in d.select(planner.question_route(F.col("q")).alias("r")).collect()]
    assert got == [("metadata", "channel_id"), ("metadata", "author"), ("count", None), ("unknown", None)]


def moments(spark, *texts, **more):
    d = spark.createDataFrame(list(enumerate(texts)), "query_id int, query_text string")
    out = {}
    for r in planner.sequence_events(d, **more).orderBy("query_id", "event_order").collect():
        out.setdefault(r.query_id, []).append(r)
    return out


def test_moments_in_order(spark):
    got = moments(
        spark, "a man opens the door, sau đó the crowd cheers → fireworks", "She sits before the train arrives", "chạy sau xe buýt", "một → hai → ba → bốn → năm → sáu", "", None,
        'immediately the sign shows "EXIT" then a red car stops', default_gap=60.0,
    )
    assert [r.event_text for r in got[0]] == ["a man opens the door", "the crowd cheers", "fireworks"]
    assert [r.event_id for r in got[0]] == ["e1", "e2", "e3"] and [r.max_gap_seconds for r in got[0]] == [None, 60.0, 60.0] and got[0][1].gap_class == "short"
    assert (got[0][0].subject, got[0][0].action, got[0][0].object) == ("man", None, "door")
    assert [r.event_text for r in got[1]] == ["She sits", "the train arrives"]
    assert [r.event_text for r in got[2]] == ["chạy sau xe buýt"] and got[2][0].warnings == [planner.REVIEW_WARNING, planner.LOW_CONFIDENCE_WARNING] and got[2][0].confidence == 0.65
    assert not {3, 4, 5} & set(got)
    sign, car = got[6]
    assert sign.terms == ["EXIT"] and "ocr" in sign.modalities and car.color == "red" and car.object == "car" and car.max_gap_seconds == 15.0
    status = planner.temporal_parts(spark.createDataFrame([("một → hai → ba → bốn → năm → sáu",), ("",)], "query_text string")).collect()
    assert [r.status for r in status] == ["TOO_MANY_EVENTS", "EMPTY_QUERY"]


def test_metadata_search_tells_accents_apart(spark):
    docs = [(1, "Bóng đá tối nay", "VTV", "bóng đá"), (2, "bong da nghiệp dư", "kênh khác", ""), (3, "Nấu ăn", None, "bong bóng"), (4, None, None, None)]
    d = spark.createDataFrame(docs, "id long, title string, author string, description string").withColumn("score", F.lit(9))
    queries = [(0, "bóng đá"), (1, "bong da"), (2, "VTV"), (3, ""), (4, None)]
    q = spark.createDataFrame(queries, "query_id long, query_text string")
    weights, roles = {"title": 3.0, "author": 2.0, "description": 1.0}, {"title": "title", "author": "author", "description": "description"}
    got = [(r.query_id, r.doc_id, round(r.score, 6), r.matched_terms) for r in lexical.fielded_bm25(d, q, doc_id="id", weights=weights, roles=roles).orderBy("query_id", "rank").collect()]

    fold = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.lower().replace("đ", "d")) if unicodedata.category(c) != "Mn")
    tf = []
    for _, *fields in docs:
        own = {}
        for text, w in zip(fields, weights.values()):
            for x in re.findall(r"\w+", fold(text or "")):
                own[x] = own.get(x, 0) + w
        tf.append(own)
    mean = sum(sum(o.values()) for o in tf) / len(tf)
    want = []
    for qid, text in queries:
        rows = []
        for (i, *fields), own in zip(docs, tf):
            asked = re.findall(r"\w+", fold(text or ""))
            hit = [x for x in asked if x in own]
            if not hit:
                continue
            s = 0.0
            for x in hit:
                n = sum(x in o for o in tf)
                s += math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) * own[x] * 2.2 / (own[x] + 1.2 * (0.25 + 0.75 * sum(own.values()) / mean))
            spelled = {x for f in fields for x in re.findall(r"\w+", (f or "").lower())}
            s += 0.35 * sum(x in spelled for x in re.findall(r"\w+", text.lower()))
            if len(asked) > 1:
                for f, name in zip(fields, weights):
                    f = (f or "").lower()
                    s += lexical.SPELLED_BONUS[name] if text.lower() in f else lexical.FOLDED_BONUS[name] if fold(text) in fold(f) else 0.0
            rows.append((qid, i, round(s, 6), len(hit)))
        want += sorted(rows, key=lambda r: (-r[2], r[1]))
    assert got == want and got[0][1] == 1 and [g[1] for g in got if g[0] == 1][0] == 2


def test_dates_and_spellings_ask_the_corpus(spark):
    docs = [(1, "tin 31082024", "tin 31082024"), (2, "bóng đá", "bong da"), (3, "khác", "khac"), (4, "nữa", "nua"), (5, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text_normalized string, text_folded string")
    q = spark.createDataFrame([(1, "ngày 31 tháng 8 năm 2024"), (2, "31/8/2024"), (3, "bóng"), (4, "bong"), (5, None)], "query_id long, query_text string")
    got = {(r.query_id, r.doc_id): r for r in lexical.corpus_search(d, q, doc_id="doc_id").collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 2)}
    assert got[3, 2].score == pytest.approx(2 * got[4, 2].score) and got[3, 2].matched_terms == 2  # both spellings are asked


def test_many_queries_are_joined(spark, monkeypatch):
    d = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, "d"), (4, None)], "doc_id long, t string")
    q = spark.createDataFrame([(1, "b d"), (2, "c")], "query_id long, query_text string")
    run = lambda: sorted((r.query_id, r.doc_id, round(r.score, 9), r.matched_terms, r.rank) for r in lexical.bm25(d, q, doc_id="doc_id", fields={"t": "t"}).collect())
    few = run()
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 1)
    assert run() == few and len(few) == 4


def test_small_text_functions(spark):
    d = spark.createDataFrame([("Ã¡", -0.5), ("nước", None), ("plain", 1.0)], "t string, p double")
    r = d.select(T.has_mojibake(F.col("t")).alias("m"), T.has_vietnamese(F.col("t")).alias("v"), T.log_confidence(F.col("p")).alias("c"), T.picked_confidence(F.lit(None), F.col("p")).alias("k"), T.unmarked(F.lit("Ấm đường")).alias("u")).collect()
    assert [x.m for x in r] == [False, False, False] and [x.v for x in r] == [True, True, False]
    assert r[0].c == pytest.approx(math.exp(-0.5)) and r[1].c is None and r[2].c == 1.0 and [x.k for x in r] == [0.0, 1.0, 1.0] and r[0].u == "Am đuong"
