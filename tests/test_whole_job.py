"""Queries and operators that must look at every row: each test fails where rows are cut before they are looked at."""

import random
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from vidsift import catalog
from vidsift.operators import temporal

CANDIDATES = "event_id string, video_id string, candidate_id long, t double, local_score double"


def write(folder, name, rows, **columns):
    pd.DataFrame(rows, columns=list(columns)).astype(columns).to_parquet(folder / f"{name}.parquet", index=False)


def test_sequences_look_at_every_event(spark, tmp_path):
    """Nine events a type; only the lowest-valued of each, beyond any pool of eight, lie in order."""
    rows, at = [], {"view": 100, "click": 50, "purchase": 0}
    for kind in at:
        rows += [(len(rows) + i, 1, kind, pd.Timestamp("2024-01-01") + pd.Timedelta(days=at[kind] + i), 9.0 - i) for i in range(8)]
    rows += [(90 + i, 1, kind, pd.Timestamp("2024-06-01") + pd.Timedelta(hours=i), 0.0) for i, kind in enumerate(at)]
    write(tmp_path, "events", rows, event_id="int64", user_id="int64", event_type="str", ts="datetime64[us]", value="float64")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert [r.status for r in run("sequence_feasible")] == ["FEASIBLE"]
    assert "90>91" in {r.path for r in run("sequence_two")}
    assert "90>91>92" in {r.path for r in run("sequence_three")}
    assert len(run("event_windows_around_anchor")) == 1


def test_candidates_beyond_the_beam_can_follow(spark):
    """The only candidate after the first event is the last of 151 by score, then of the states: beams of 100 lose it."""
    late = [("b", "V", i, 1.0, 0.9) for i in range(150)] + [("b", "V", 150, 20.0, 0.1)]
    df = spark.createDataFrame([("a", "V", 900, 10.0, 0.5), *late], CANDIDATES)
    assert [r.path for r in temporal.align(df, ["a", "b"]).collect()] == ["900>150"]
    early = [("a", "W", i, 30.0, 0.9) for i in range(150)] + [("a", "W", 150, 10.0, 0.1), ("b", "W", 900, 20.0, 0.5)]
    got = temporal.feasible(df.union(spark.createDataFrame(early, CANDIDATES)), ["a", "b"], most_gap=15.0).collect()
    assert {(r.video_id, r.status) for r in got} == {("V", "FEASIBLE"), ("W", "FEASIBLE")}


def test_feasible_equals_all_paths(spark):
    rng = random.Random(3)
    rows = [(e, f"V{v}", i, rng.choice([None, *range(24)]) if i % 9 == 0 else float(rng.randrange(24)), 0.5) for v in range(60) for i, e in enumerate("aabbcc") if rng.random() < 0.9]
    rows = [(e, v, i, None if t is None else float(t), s) for e, v, i, t, s in rows]
    df = spark.createDataFrame(rows, CANDIDATES)

    def status(video, least, most):
        times = [[t for e, v, _, t, _ in rows if v == video and e == x] for x in "abc"]
        for x, ts in zip("abc", times):
            if not ts:
                return f"REQUIRED_EVENT_MISSING:{x}"
        ok = lambda p, q: None not in (p, q) and q - p > 0 and q - p >= least and (most is None or q - p <= most)
        return "FEASIBLE" if any(ok(p, q) and ok(q, r) for p in times[0] for q in times[1] for r in times[2]) else "NO_MONOTONIC_REQUIRED_PATH"

    for least, most in ((0.0, None), (0.0, 6.0), (3.0, None), (3.0, 6.0)):
        got = {r.video_id: r.status for r in temporal.feasible(df, list("abc"), least, most).collect()}
        assert got == {v: status(v, least, most) for v in {r[1] for r in rows}} and len(set(got.values())) > 2


#: Composed and decomposed Vietnamese, horns and strokes, other scripts, full case folding, typographic and invisible characters.
TEXTS = [
    "Đường về nhà ở Cần Thơ", unicodedata.normalize("NFD", "Người ƯỚC mơ, tươi đẹp"), "Привет, Ёлка!", "ΟΔΟΣ Σίσυφος", "Ｆｕｌｌ　Ｗｉｄｔｈ １２", "Straße ẞ ﬁn", "“quoted” – it’s",
    "zero​width­soft", "x² ½ nº 1ª", "Łódź Øre æ ð þ", "İstanbul ı", "日本語 テスト ガ", "", "   ", "́", None,
]


def plain(text, fold):
    """The reference's rule, a character at a time."""
    out, word = [], ""
    for c in unicodedata.normalize("NFC", text).casefold():
        for x in unicodedata.normalize("NFD", c) if fold else c:
            if fold and unicodedata.category(x) == "Mn":
                continue
            x = "d" if fold and x == "đ" else x
            if x.isalnum():
                word += x
            elif word:
                out, word = [*out, word], ""
    return " ".join([*out, word] if word else out)


def test_every_text_is_normalised(spark, tmp_path):
    rows = list(enumerate(TEXTS))
    pd.DataFrame(rows, columns=["doc_id", "text"]).to_parquet(tmp_path / "documents.parquet", index=False)
    got = {r.doc_id: r.normalized for r in catalog.queries()["normalized_texts"](spark, str(tmp_path)).collect()}
    assert got == {i: plain(t, False) for i, t in rows if t is not None}
    assert got[0] == "đường về nhà ở cần thơ" and got[2] == "привет ёлка" and got[5] == "strasse ss fin"


def test_every_speech_text_is_folded(spark, tmp_path):
    rows = list(enumerate(TEXTS))
    pd.DataFrame(rows, columns=["asr_id", "text_raw"]).to_parquet(tmp_path / "asr.parquet", index=False)
    got = {r.asr_id: r.folded for r in catalog.queries()["folded_texts"](spark, str(tmp_path)).collect()}
    assert got == {i: plain(t, True) for i, t in rows if t is not None}
    assert got[0] == "duong ve nha o can tho" and got[1] == "nguoi uoc mo tuoi dep"


def test_the_sample_is_rows(spark, tmp_path):
    rows = [(i, ("view", "click")[i % 3 == 0], float(i)) for i in range(6000)]
    sample = lambda some: (write(tmp_path, "events", some, event_id="int64", event_type="str", value="float64"), catalog.queries()["stratified_sample"](spark, str(tmp_path)).collect())[1]
    got = sample(rows)
    assert {tuple(r) for r in got} <= set(rows) and len({r.event_id for r in got}) == len(got)
    for kind, n in (("view", 4000), ("click", 2000)):
        assert abs(sum(r.event_type == kind for r in got) / n - 0.1) < 0.03
    # a row is in or out for good, whatever other rows there are
    spark.catalog.clearCache()
    assert {r.event_id for r in sample(rows[::2])} == {r.event_id for r in got if r.event_id % 2 == 0}


def test_estimates_are_close(spark, tmp_path):
    rows = [(b, float((i * 7919) % n)) for b, n in (("A", 40), ("B", 900)) for i in range(3000)]
    write(tmp_path, "part", rows, p_brand="str", p_retailprice="float64")
    got = {r.p_brand: r for r in catalog.queries()["approximate_counts"](spark, str(tmp_path)).collect()}
    for b, n in (("A", 40), ("B", 900)):
        prices = sorted(x for k, x in rows if k == b)
        assert abs(got[b].prices - n) <= 0.15 * n + 1 and prices[1200] <= got[b].median <= prices[1800]
