"""Look-alike texts, event runs, nearest times, top N: fixtures of odd rows, and plain loops over the small tables."""

import math
import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vidsift.llm import event_runs, group_top, time_match, visual_forms


def forms(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in visual_forms.consistent_texts(d, doc_id="doc_id", text="text").collect()}


def test_equal_looks_become_equal(spark):
    texts = ["Cần Thơ - ofﬁce 12", "Ｃần Thơ - office １２", "Cần Thơ ‐ office 12", "C​ầ­n Thơ − office 12", unicodedata.normalize("NFD", "Cần Thơ - office 12"), "Сần Thơ - оffice 12"]
    r = forms(spark, texts)
    assert {r[i].text for i in r} == {"Cần Thơ - office 12"}
    assert (r[0].text_normalized, r[0].text_folded) == ("cần thơ office 12", "can tho office 12")


def test_different_looks_stay_different(spark):
    r = forms(spark, ["a b", "a  b", "ab", "a\nb", "A b", "á b", "a–b", "a-b", "a’b", "a'b"])
    assert len({r[i].text for i in r}) == 10


def test_russian_words_come_out_in_cyrillic(spark):
    r = forms(spark, ["Погода сегодня", "Пoгoдa ceгoдня", "сор", "cop", "МОСКВА", "MOCKBA"])
    assert r[0].text == r[1].text == "Погода сегодня"
    assert r[2].text == r[3].text and r[4].text == r[5].text


def test_null_empty_and_long_texts(spark):
    long = "mưa " * 200_000
    r = forms(spark, [None, "", " 　", long])
    assert r[0].text is None and r[0].text_folded is None and r[1].text == "" and r[2].text_normalized == ""
    assert r[3].text == "mưa " * 200_000


def test_pairs(spark):
    rows = [(1, "mưa to"), (2, "mưa to"), (3, "mưa to"), (4, "mua to"), (5, None), (6, " "), (7, "　"), (2, "mưa to"), (8, "mưa tо")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"form_id": F.lit(1), "k": F.lit(2), "t": F.lit("x"), "n": F.lit(3)})
    got = {tuple(r) for r in visual_forms.lookalike_pairs(d, doc_id="doc_id", text="text").collect()}
    assert got == {(1, 2), (2, 3), (1, 8), (2, 8), (3, 8)}
    assert visual_forms.lookalike_pairs(d.limit(0), doc_id="doc_id", text="text").count() == 0


def test_a_look_that_holds_many_rows(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "giá​ vàng").when(F.col("id") < 1000, "giá vàng").otherwise(F.concat(F.lit("x"), "id")).alias("text"))
    assert visual_forms.lookalike_pairs(d, doc_id="doc_id", text="text").count() == 999


def test_width_style_ligatures_and_scripts(spark):
    same = [("ｶﾞ", "ガ"), ("￠￦", "¢₩"), ("ǆ ǅ ǈ ǋ", "dž Dž Lj Nj"), ("𝐀𝟏 𝓫", "A1 b"), ("αbc", "abc"), ("Ꭺ", "A"), ("﹐", ","), ("ﻻ", "لا"), ("αλφα", "aλφa"), ("ofﬁce Ⅷ", "office VIII")]
    r = forms(spark, [x for pair in same for x in pair])
    assert all(r[2 * i].text == r[2 * i + 1].text for i in range(len(same)))
    assert r[16].text == "αλφα"
    apart = ["x²", "x2", "½", "1/2", "①", "1", "…", "...", "как", "kak", "ſ", "s"]
    assert len({x.text for x in forms(spark, apart).values()}) == len(apart)


def plain_pairs(rows):
    docs = {}
    for i, look, t in rows:
        docs.setdefault(look, set()).add((i, t))
    return {(min(i, j), max(i, j)) for own in docs.values() for i, s in own for j, t in own if i != j and s != t}


def test_pairs_and_classes_of_split_looks(spark):
    """A look that holds a third of the rows, one of many spellings, and rows that are delivered again."""
    hidden = ["​", "‌", "‍", "⁠"]
    rows = [(i, "hot", "giá vàng") for i in range(60)] + [(100 + i, "hot", "giá v" + hidden[i % 4] + "àng") for i in range(6)]
    rows += [(200 + i, "many", "mưa" + "".join(hidden[i >> k & 1] for k in range(5))) for i in range(20)] + [(300 + i, f"own{i}", f"x {i}") for i in range(90)] + [(0, "hot", "giá vàng")]
    d = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string").withColumns({"part": F.lit(1), "k": F.lit(2), "n": F.lit(3)})
    want = plain_pairs(rows)
    for block in (3, 1000):
        got = [tuple(r) for r in visual_forms.lookalike_pairs(d, doc_id="doc_id", text="text", block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        links = {r.doc_id: r.links for r in visual_forms.lookalike_classes(d, doc_id="doc_id", text="text", block=block).collect()}
        assert links == {i: sum(i in p for p in want) for i in {x for p in want for x in p}}
    assert visual_forms.lookalike_classes(d.limit(0), doc_id="doc_id", text="text").count() == 0


def plain_edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("ab1", max_size=12), st.text("ab1", max_size=12), st.integers(0, 12))
def test_edits(a, b, most):
    assert event_runs.edits_within(a, b, most) == min(plain_edits(a, b), most + 1)


def plain_cost(costs, penalty):
    """The least cost of all segmentations, by trying each."""
    n = len(costs)
    best = math.inf
    for mask in range(1 << (n - 1)):
        total = penalty
        for i in range(1, n):
            total += penalty if mask >> (i - 1) & 1 else costs[i]
        best = min(best, total)
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=8), st.integers(1, 20))
def test_segmentation_is_optimal(costs, penalty):
    s = event_runs.Segmenter(penalty)
    runs = []
    for i, c in enumerate(costs):
        s.add(c, i)
        runs += s.settled()
    runs = [(a, b) for a, b, n in runs + s.rest() if n == b - a + 1]
    assert s.best == plain_cost(costs, penalty)
    assert runs[0][0] == 0 and runs[-1][1] == len(costs) - 1 and all(b + 1 == c for (_, b), (c, _) in zip(runs, runs[1:]))
    # the longer run where it costs the same
    assert [a for a, _ in runs] == [i for i, c in enumerate(costs) if i == 0 or c > penalty]


E = "video_id string, keyframe_id int, ocr_id long, pts_time double, text_normalized string"


def runs(spark, rows, parts):
    d = spark.createDataFrame(rows, E).withColumns({"entity": F.lit("x"), "rid": F.lit(1), "part": F.lit(2)})
    out = event_runs.collapse_runs(d, entity="video_id", event_id="ocr_id", position="keyframe_id", time="pts_time", text="text_normalized", parts=parts)
    return {(r.video_id, r.first_id, r.last_id, r.n_events, r.duration_seconds) for r in out.collect()}


def test_runs_don_t_depend_on_parts(spark):
    rng = random.Random(1)
    rows, rid = [], 0
    for v in ("A", "B", "C", None):
        text = "bản tin thời sự số một"
        for k in range(200 if v == "A" else 9):
            rid += 1
            if rng.random() < 0.2:
                text = f"bản tin {rng.randrange(10**9)} thời sự"
            noisy = text if rng.random() < 0.5 else text[:3] + "x" + text[4:]
            rows.append((v, k, rid, k * 2.0, noisy))
    one = runs(spark, rows, 1)
    assert one == runs(spark, rows, 7) == runs(spark, rows, 50)
    assert sum(r[3] for r in one) == len(rows)


def test_odd_events(spark):
    rows = [
        ("A", 1, 5, 1.0, "đèn ĐỎ"), ("A", 1, 4, 1.0, "den do"), ("A", 2, 6, 2.0, "Đèn, đỏ!"), ("A", None, 7, None, "den do"), ("A", 3, 8, 3.0, None), ("A", 4, 9, 4.0, " 　"),
        ("A", 5, 10, 5.0, "..."), ("A", 6, 11, 6.0, "!!"), ("A", 7, 12, None, "den do"),
    ]
    assert runs(spark, rows, 3) == {("A", 4, 6, 2, 1.0), ("A", 10, 11, 2, 1.0), ("A", 12, 12, 1, None)}
    assert runs(spark, rows[:0], 3) == set()
    long = "a" * 30_000
    assert runs(spark, [("A", 1, 1, 1.0, long), ("A", 2, 2, 2.0, long[:-3000] + "b" * 3000), ("A", 3, 3, 3.0, "c" * 30_000)], 1) == {("A", 1, 2, 2, 1.0), ("A", 3, 3, 1, 0.0)}


def near(spark, records, refs, **more):
    a = spark.createDataFrame(records, "video_id string, id long, t double").withColumns({"__t": F.lit(0), "keyframe_id": F.lit(9)})
    b = spark.createDataFrame(refs, "video_id string, keyframe_id int, pts_time double").withColumn("id", F.lit(1))
    out = time_match.nearest_in_time(a, b, entity="video_id", record_id="id", record_time="t", ref_id="keyframe_id", ref_time="pts_time", **more)
    return sorted((r.id, r.keyframe_id, round(r.distance_seconds, 6)) for r in out.collect())


def test_nearest_odd_rows(spark):
    refs = [("V", 1, 0.0), ("V", 1, 0.0), ("V", 2, 4.0), ("V", 3, 4.0), ("V", None, 4.1), ("V", 5, None), ("V", 6, math.nan), (None, 7, 9.0), ("V", 8, 64.5), ("V", 9, math.inf)]
    records = [("V", 1, 2.0), ("V", 2, 3.9), ("V", 3, 7.0), ("V", 4, 7.1), ("V", 5, None), ("V", 6, math.nan), (None, 7, 9.0), ("W", 8, 0.0), ("V", 9, 63.9), ("V", 1, 2.0), ("V", 10, -2.5)]
    want = sorted([(1, 1, 2.0), (1, 1, 2.0), (2, 2, 0.1), (3, 2, 3.0), (9, 8, 0.6), (10, 1, 2.5)])
    assert near(spark, records, refs) == want
    assert near(spark, records, refs, bundle_rows=1) == want  # every range is split, over parts and a grid
    assert near(spark, records[:0], refs) == [] and near(spark, records, refs[:0]) == []


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([3, 100_000]))
def test_nearest_equals_scan(spark, seed, bundle):
    rng = random.Random(seed)
    refs = [(rng.choice("VW"), k, rng.randrange(3000) / 10) for k in range(60)]
    records = [(rng.choice("VW"), i, rng.randrange(3000) / 10) for i in range(60)]
    want = []
    for v, i, t in records:
        best = min(((abs(rt - t), k) for rv, k, rt in refs if rv == v), default=(9.0, 0))
        if best[0] <= 3.0:
            want.append((i, best[1], round(best[0], 6)))
    assert near(spark, records, refs, bundle_rows=bundle) == sorted(want)


S = "g string, k int, id long, label string, score double, box double"


def top(spark, rows, **more):
    d = spark.createDataFrame(rows, S).withColumns({"__rank": F.lit(1), "__id": F.lit(2), "result_rank": F.lit("x")})
    out = group_top.top_n_per_group(d, group=["g", "k"], score="score", label="label", row_id="id", same=["box"], n=3, **more)
    return sorted((str(r.g), r.k, r.result_rank, r.id) for r in out.collect())


def plain_top(rows, n=3):
    ok = [r for r in rows if r[4] is not None and not math.isnan(r[4]) and 0 <= r[4] <= 1]
    seen, out = set(), {}
    for r in sorted(ok, key=lambda r: r[2]):
        same = (r[0], r[1], r[3], r[4], r[5]) if r[3] is not None else r[2]
        if same not in seen:
            seen.add(same)
            out.setdefault((r[0], r[1]), []).append(r)
    order = lambda r: (-r[4], r[3] is None, r[3] or "", r[2])
    return sorted((str(g), k, i, r[2]) for (g, k), own in out.items() for i, r in enumerate(sorted(own, key=order)[:n], start=1))


def test_top_equals_plain_sort(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        rows.append((g, rng.randrange(2) if g != "hot" else 0, i, rng.choice(["x", "y", "Z", None]), rng.choice([1.0, 0.9, 0.9, 0.35, 0.0, -0.1, 1.5, math.nan, None]), rng.choice([0.1, 0.2, None])))
    want = plain_top(rows)
    assert top(spark, rows) == want
    assert top(spark, rows, large_least=50) == want  # most groups count as large
    assert top(spark, rows[:0]) == []


def test_a_group_of_equal_rows(spark):
    rows = [("hot", 0, i, "x", 0.5, 0.1) for i in range(500)] + [("hot", 0, 1000, None, 0.5, 0.1), ("hot", 0, 1001, None, 0.5, 0.1)]
    assert top(spark, rows, large_least=10) == plain_top(rows) == [("hot", 0, 1, 0), ("hot", 0, 2, 1000), ("hot", 0, 3, 1001)]
