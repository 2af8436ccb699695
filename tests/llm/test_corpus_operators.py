"""Nearest vectors, BPE, leaked passages, wrong encodings: fixtures of odd rows, held-out accuracy, exact libraries."""

import base64
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vidsift.llm import bpe, leakage, mojibake, queries, vector_neighbours as vn

SMALL = "/root/testdata/sf0.01"


def exact(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = {}
    for i, v in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))
        out[v] = [ids[j] for j in order[:k]]
    return out


def nearest(spark, rows, **more):
    d = spark.createDataFrame(rows, "vec_id long, v array<float>").withColumns({"h": F.lit(1), "n": F.lit(2), "rep": F.lit(3), "ids": F.lit(4)})
    out = {}
    for r in vn.nearest_vectors(d, vec_id="vec_id", vector="v", **more).orderBy("vec_id", "neighbour_rank").collect():
        out.setdefault(r.vec_id, []).append(r.neighbour_id)
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    want = exact(list(range(3000)), x.astype(np.float64), 5)
    got = nearest(spark, [(i, v.tolist()) for i, v in enumerate(x)], dims=16, leaf_rows=64, shard_rows=400, tree_sample=1500)
    assert len(got) == 3000
    assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want]) >= 0.9


def test_odd_vectors_and_copies(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=4).tolist()) for i in range(30)]
    copies = [(100 + i, good[3][1]) for i in range(20)]
    odd = [(200, None), (201, [1.0]), (202, [0.0] * 4), (203, [float("nan")] * 4), (204, [float("inf"), 0.0, 0.0, 1.0]), (205, [None, 1.0, 1.0, 1.0])]
    rows = good + copies
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    assert nearest(spark, rows + odd, dims=4) == exact([i for i, _ in rows], x, 5)
    assert nearest(spark, odd, dims=4) == {}
    assert nearest(spark, good[:2], dims=4) == {0: [1], 1: [0]}


def test_index_holds_every_stored_vector(spark):
    near = queries.p2_neighbours(spark, SMALL)
    usable = spark.read.parquet(f"{SMALL}/clip_features.parquet").filter("size(clip_feature) = 128 AND forall(clip_feature, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e30) AND exists(clip_feature, x -> x <> 0)").count()
    assert near.select("vec_id").distinct().count() == usable and near.count() == 5 * usable


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_ranks(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"), bpe.load_pattern(bpe.TOKENIZERS))


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.load_pattern(bpe.TOKENIZERS), mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(encoder, reference, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 20_000, "ab" * 5_000, "đường" * 2_000, "<|endoftext|>", "\n\n \t x", "🙂" * 300, "1" * 999])
def test_long_pre_tokens_and_odd_texts(encoder, reference, text):
    ids = encoder.encode(text)
    assert ids == reference.encode_ordinary(text) and reference.decode(ids) == text


def test_corpus_encoding(spark):
    d = spark.createDataFrame([(1, "xin chào"), (2, None), (3, ""), (1, "xin chào")], "doc_id long, text string").withColumns({"k": F.lit(1), "ids": F.lit("x"), "t": F.lit(0)})
    got = sorted((r.doc_id, tuple(r.ids)) for r in bpe.encode_corpus(d, doc_id="doc_id", text="text").collect())
    assert len(got) == 4 and got[0] == got[1] and got[2:] == [(2, ()), (3, ())]
    assert bpe.encode_corpus(d.limit(0), doc_id="doc_id", text="text").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab ", max_size=30), max_size=4), st.lists(st.text("ab ", max_size=80), max_size=3))
def test_matcher_equals_scan(items, texts):
    m = 3
    items, texts = [" ".join(t.split()) for t in items], [" ".join(t.split()) for t in texts]
    passages, shift = leakage.patterns(list(range(len(items))), pa.array(items, pa.string()), m)
    runs = lambda t: [" ".join(w[j : j + m]) for w in [t.split()] for j in range(len(w) - m + 1)]
    assert sorted((i, p) for i, _, p in passages) == sorted((i, p) for i, t in enumerate(items) for p in runs(t))
    h = np.array([x for _, x, _ in passages], np.int64).view(np.uint64) >> np.uint64(64 - leakage.BUCKET_BITS)
    bits = {}
    for b in h.tolist():
        bits[b >> 6] = bits.get(b >> 6, 0) | 1 << (b & 63)
    table = lambda d, kind: (np.array(list(d), np.int64), np.array(list(d.values()), kind))
    matcher = leakage.Matcher(*leakage.Matcher.tables(table(shift, np.uint8), table(bits, np.uint64), m), m)
    known = {p for _, _, p in passages}
    assert [(t, p) for t, _, p in matcher.search(pa.array(texts, pa.string())) if p in known] == [(i, p) for i, t in enumerate(texts) for p in runs(t) if p in known]


def test_leaks(spark):
    q = "Tìm cảnh một người đàn ông mặc áo đỏ đứng trước cổng chợ Đông Ba lúc trời mưa"
    items = spark.createDataFrame([(1, q), (2, "quá ngắn"), (3, None), (4, q), (1, q)], "item_id long, query_text string")
    part = " ".join(q.split()[3:13])
    nine = " ".join(q.split()[3:12])
    docs = spark.createDataFrame(
        [(1, f"x {part.upper()} y"), (2, part.replace(" ", " - ")), (3, "nguoi dan ong mac ao do dung truoc cong cho"), (4, nine), (5, None), (6, ""), (7, "a " * 100_000 + "người đ​àn ông, mặc áo đỏ đứng trước cổng chợ"), (8, part.replace(" ", ""))],
        "doc_id long, text string",
    ).withColumns({"item": F.lit(1), "t": F.lit(2), "windows": F.lit(3)})
    run = lambda d, i: sorted((r.doc_id, r.item_id) for r in leakage.leaked_passages(d, i, doc_id="doc_id", text="text", item_id="item_id", item_text="query_text").collect())
    want = sorted((d, i) for d in (1, 2, 3, 7) for i in (1, 4))
    assert run(docs, items) == want
    assert run(docs.limit(0), items) == [] and run(docs, items.limit(0)) == []
    assert run(docs.unionByName(docs), items) == want  # rows of one doc_id are one document


def corpus(seed=4, n=400):
    """Texts of a small vocabulary, as clean as any."""
    rng = random.Random(seed)
    words = "nước đường phố người đàn ông mặc áo đỏ trước cổng chợ lúc trời mưa giông tại thị trấn hưng viễn giảm còn tấn cá được mùa với sự cố máy trình diễn cổ vũ khán giả “ngày hội” thể thao giỏ lụa quý".split()
    return [" ".join(rng.choice(words) for _ in range(25)) for _ in range(n)]


def misread(clean, written, table):
    data = (mojibake.tones_apart(clean) if written == "cp1258" else clean).encode(written)
    return "".join(table[x] for x in data)


def own_table(seed=9):
    """An encoding that no library knows."""
    high = [chr(c) for c in range(0x2500, 0x2580)]
    random.Random(seed).shuffle(high)
    return [chr(b) for b in range(128)] + high


def planted(texts):
    table = {name: mojibake.encodings()[name] for name in ("cp1252", "mac_roman", "cp437", "cp1256", "iso8859_1")} | {"own": own_table()}
    wrong = {i: misread(texts[i], "utf-8", table[("cp1252", "mac_roman", "cp437", "cp1256", "own")[i % 5]]) for i in range(0, 120)}
    for i in range(120, 150):
        wrong[i] = misread(misread(texts[i], "utf-8", table["cp1252"]), "utf-8", table["cp1252"])
    for i in range(150, 180):
        wrong[i] = misread(texts[i], "cp1258", table["iso8859_1"])
    return wrong


def test_learned_encodings_find_and_restore(spark):
    texts = corpus(n=2000)
    wrong = planted(texts)
    rows = [(i, wrong.get(i, t)) for i, t in enumerate(texts)] + [(900, "mất ch�"), (901, None), (902, ""), (903, "plain"), (904, "MÃ CẢNH")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k": F.lit(1), "hits": F.lit(2), "t": F.lit("x"), "word": F.lit(3)})
    found = {r.doc_id for r in mojibake.garbled(d, doc_id="doc_id", text="text").collect()}
    assert found == set(wrong) | {900}
    back = {r.doc_id: r for r in mojibake.restored(d, doc_id="doc_id", text="text").collect()}
    right = [back[i].text_restored == texts[i] for i in wrong if i >= 120 or i % 5 < 4]
    assert sum(right) / len(right) >= 0.9 and not back[900].is_complete
    # of the encoding that no library knows, only bytes that were seen are known: most words come back
    words = [(a, b) for i in range(4, 120, 5) for a, b in zip(texts[i].split(), back[i].text_restored.split(), strict=True)]
    assert sum(a == b for a, b in words) / len(words) >= 0.8


def test_what_is_learned_does_not_depend_on_partitions(spark):
    texts = corpus(n=2000)
    wrong = planted(texts)
    d = spark.createDataFrame([(wrong.get(i, t),) for i, t in enumerate(texts)], "text string")
    one, many = (mojibake.infer(d.repartition(n), text="text") for n in (1, 13))
    assert one == many
    own = next(m for m in one[0] if m.read.startswith("inferred"))
    assert len(own.reads) > 20 and sum(own_table()[b] == c for b, c in own.reads) >= 0.9 * len(own.reads)
    assert {"cp1252", "mac_roman", "cp437", "cp1256"} <= {m.read for m in one[0]} and any(m.letters for m in one[0])


def test_tiny_tables(spark):
    d = spark.createDataFrame([(1, "Ã©"), (2, "�"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in mojibake.garbled(d, doc_id="doc_id", text="text").collect()] == [2]
    assert mojibake.garbled(d.limit(0), doc_id="doc_id", text="text").count() == 0
    assert mojibake.restored(d.limit(0), doc_id="doc_id", text="text").count() == 0


def test_assignments_of_aligned_words():
    read = mojibake.encodings()["cp1252"]
    word = "người"
    kind, own = mojibake.assignments("".join(read[b] for b in word.encode()), word)
    assert kind == 0 and own == sorted({(b, ord(read[b])) for b in word.encode() if b >= 0x80})
    assert mojibake.assignments("ng\u00fd\u00f5\u00cci", mojibake.tones_apart(word)) == (1, [(0x1A1, 0xF5), (0x1B0, 0xFD), (0x300, 0xCC)])
    assert mojibake.assignments("mùa", "mưa") is None and mojibake.assignments("mưa", "mưa") is None


def test_mappings_need_support_of_their_own():
    a, b, c, d, e, f = (0xC3, 1), (0xE1, 2), (0xC3, 3), (0xBB, 4), (0xE1, 5), (0xBA, 6)
    own = lambda links: [{s: x for s, (x, _) in t.items()} for t in mojibake.tables(links)]
    links = {(a, b): 50, (b, d): 40, (a, d): 30, (c, b): 9, (c, d): 2}
    first = {0xC3: 1, 0xE1: 2, 0xBB: 4}
    assert own(links) == [first]  # (c, b) comes from wrong twins
    # what is mostly linked with rivals of the first mapping belongs to another, which may share an assignment with it
    assert own(links | {(c, e): 20, (e, f): 20, (c, f): 20, (e, d): 20}) == [first, {0xC3: 3, 0xE1: 5, 0xBA: 6, 0xBB: 4}]
    assert mojibake.tables({(a, b): 2}) == []


def test_queries_equal_their_sql(spark):
    from tests.oracle import connect, rows, sql_rows

    con = connect(SMALL)
    for name, sql in queries.oracle_sql().items():
        assert rows(queries.queries()[name](spark, SMALL)) == sql_rows(con, sql), name
