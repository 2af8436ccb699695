"""Rule tables that plan batches of queries: modalities, retrievers, moments, question types. Column expressions over a query table."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidsift.functions.text import (
    TEXT_MARKERS, contains_phrase, event_fold, nfc, phrases_in, planner_normalize, query_variants, question_scene, quoted_phrases, split_events, without_phrases,
)

# Marker words of each route, and question cues in the order in which they are tried.
OBJECT_TERMS = {
    "phone": ("phone", "điện thoại", "smartphone"),
    "car": ("car", "vehicle", "ô tô", "xe hơi"),
    "person": ("person", "people", "người", "man", "woman"),
    "bicycle": ("bicycle", "bike", "xe đạp"),
}
SPEECH_MARKERS = ("nói", "phát biểu", "nhắc đến", "được nhắc đến", "nghe", "lời thoại", "trò chuyện", "đối thoại", "trả lời", "says", "speaks", "talks", "conversation")
TEMPORAL_MARKERS = ("trước", "sau", "sau đó", "tiếp theo", "cuối cùng", "before", "after", "then", "finally")
METADATA_MARKERS = ("kênh", "tác giả", "ngày", "tiêu đề", "channel", "author", "published")
COLORS = ("đỏ", "xanh", "vàng", "trắng", "đen", "hồng", "green", "red", "blue", "white", "black")
CONTENT_MARKERS = ("nội dung", "chủ đề", "bản tin", "đề cập", "nhắc đến", "được nhắc đến", "nói", "phát biểu", "trò chuyện", "đối thoại", "trả lời", "lời thoại",
                   "content", "topic", "report", "about", "mentions", "says", "speech", "conversation")
EXACT_MARKERS = ("chính xác", "nguyên văn", "từ khóa", "mã", "mã số", "số hiệu", "con số", "số mấy", "số lượng", "số thứ tự", "bao nhiêu", "chữ", "ký tự", "biển hiệu",
                 "biển báo", "bảng", "ghi", "hiển thị", "địa chỉ", "đường nào", "exact", "keyword", "code", "written", "sign")
VISUAL_MARKERS = ("cảnh", "khung hình", "hình ảnh", "đoạn phim", "đoạn clip", "người", "cô gái", "người đàn ông", "người phụ nữ", "cụ ông", "cụ bà", "xe", "ô tô", "mặc",
                  "màu", "cầm", "đặt", "đứng", "ngồi", "đi", "chạy", "rẽ", "nấu", "bên cạnh", "phía sau", "scene", "frame", "image", "person", "man", "woman", "car",
                  "wearing", "holding", "standing", "sitting", "walking", "driving", "cooking")
#: Kind of question, cues, and the field that answers it, where one is meant.
QUESTION_CUES = (
    ("metadata", ("youtube channel id", "channel id"), "channel_id"),
    ("metadata", ("channel",), "author"),
    ("count", ("bao nhiêu", "how many", "mấy ", "số lượng", "number of"), None),
    ("temporal", ("trước", "sau", "tiếp theo", "before", "after", "next"), None),
    ("asr", ("nói gì", "phát biểu", "nhắc đến", "lời thoại", "what does", "say", "speak"), None),
    ("ocr", ("ghi gì", "viết gì", "chữ", "biển hiệu", "logo", "text", "sign"), None),
    ("metadata", ("kênh nào", "tác giả", "đăng ngày", "tiêu đề", "author", "published", "title"), None),
    ("attribute_color", ("màu gì", "màu", "color", "colour"), None),
    ("object", ("cầm gì", "vật gì", "đối tượng", "what is", "what object", "holding"), None),
    ("visual", ("ai", "ở đâu", "mặc", "trông", "what is shown", "who is", "where is"), None),
)
GAP_CLASSES = ((60.0, "short"), (300.0, "medium"))
#: Connectors between moments in order, in reverse order, and hints at an order that isn't stated.
FORWARD_CONNECTOR = r"(?iU)\s*(?:→|\b(?:sau\s+đó|rồi|tiếp\s+theo|then|after\s+that|followed\s+by)\b)\s*"
BEFORE_CONNECTOR = r"(?iU)\s+\b(?:trước\s+khi|before)\b\s+"
TEMPORAL_HINT = r"(?iU)→|\b(?:sau|trước|rồi|tiếp|then|after|before|followed)\b"
#: Words of folded moments: whole query contexts, then what a moment needs, shows and does.
CONTEXT_WORDS = (
    ("football match / stadium", ("football", "soccer", "stadium", "bong da", "san van dong")),
    ("cooking / kitchen", ("kitchen", "cook", "cooking", "nau an", "nha bep")),
    ("classroom / education", ("classroom", "teacher", "student", "lop hoc", "giao vien")),
    ("road / traffic", ("road", "street", "traffic", "duong pho", "giao thong")),
    ("live event / stage", ("concert", "stage", "audience", "khán giả", "sân khấu")),
    ("retail / store", ("store", "shop", "cua hang", "sieu thi")),
)
OCR_WORDS = ("text", "word", "sign", "screen", "subtitle", "logo", "chu", "bien", "man hinh", "phu de")
ASR_WORDS = ("say", "says", "said", "speak", "speech", "shout", "hear", "noi", "phat bieu", "het")
COLOR_WORDS = ("red", "blue", "green", "yellow", "black", "white", "pink", "orange", "purple", "do", "xanh", "vang", "den", "trang", "hong")
OBJECT_WORDS = ("ball", "phone", "trophy", "cup", "car", "bicycle", "door", "table", "chair", "dog", "cat", "book", "bong", "dien thoai", "xe", "cua", "ban", "ghe", "cho", "meo")
SUBJECT_WORDS = ("man", "woman", "person", "player", "goalkeeper", "child", "crowd", "nguoi dan ong", "nguoi phu nu", "cau thu", "thu mon", "tre em", "khan gia")
ACTION_WORDS = ("enter", "open", "hold", "carry", "run", "walk", "kick", "save", "celebrate", "sit", "stand", "buoc vao", "mo", "cam", "chay", "di bo", "sut", "can", "an mung", "ngoi", "dung")
LOCATION_WORDS = ("stadium", "kitchen", "classroom", "street", "store", "stage", "room", "san van dong", "nha bep", "lop hoc", "duong", "cua hang", "san khau", "phong")
SOON_WORDS, LATE_WORDS = ("immediately", "right after", "ngay sau"), ("later", "after a while", "mot luc sau")
SOON_SECONDS, LATE_SECONDS, MOST_EVENTS = 15.0, 300.0, 5
REVIEW_WARNING, LOW_CONFIDENCE_WARNING = "DECOMPOSITION_REVIEW_REQUIRED", "PLANNER_LOW_CONFIDENCE"


@dataclass(frozen=True)
class Coverage:
    """What text evidence a corpus has."""

    ocr_records: int = 0
    asr_segments: int = 0
    asr_videos: int = 0
    total_videos: int = 0


def _any_part(text: Column, markers: tuple[str, ...]) -> Column:
    return text.rlike("|".join(map(re.escape, markers)))


def _named(flags: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags]))


def objects(text: Column) -> Column:
    """The objects whose names a normalised query contains."""
    return _named([(label, contains_phrase(text, *names)) for label, names in OBJECT_TERMS.items()])


def modalities(query: Column) -> Column:
    """The modalities a query hints at, in a fixed order, clip first."""
    text = planner_normalize(query)
    return _named([
        ("clip", F.lit(True)),
        ("objects", F.size(objects(text)) > 0),
        ("attributes", contains_phrase(text, *COLORS)),
        ("ocr", contains_phrase(text, *TEXT_MARKERS) | (F.size(quoted_phrases(query)) > 0)),
        ("asr", contains_phrase(text, *SPEECH_MARKERS)),
        ("metadata", contains_phrase(text, *METADATA_MARKERS)),
    ])


def routes(query: Column) -> Column:
    """clip, bge, bm25 in this order: what is seen, what is said or meant, what is written exactly; clip if nothing else fits."""
    text, m = planner_normalize(query), modalities(query)
    lexical = F.arrays_overlap(m, F.array(F.lit("ocr"), F.lit("metadata"))) | contains_phrase(text, *EXACT_MARKERS)
    semantic = F.array_contains(m, "asr") | _any_part(text, CONTENT_MARKERS)
    visual = F.arrays_overlap(m, F.array(F.lit("objects"), F.lit("attributes"))) | contains_phrase(text, *VISUAL_MARKERS) | ~(lexical | semantic)
    return _named([("clip", visual), ("bge", semantic), ("bm25", lexical)])


def text_sources(query: Column) -> Column:
    """Kinds of documents that the text retrievers are limited to: asr, ocr, metadata. Quotes alone mean speech where speech is meant."""
    m, stated = modalities(query), contains_phrase(planner_normalize(query), *TEXT_MARKERS)
    asr = F.array_contains(m, "asr")
    return _named([("asr", asr), ("ocr", F.array_contains(m, "ocr") & (stated | ~asr)), ("metadata", F.array_contains(m, "metadata"))])


def coverage_warnings(query: Column, coverage: Coverage) -> Column:
    """What the query asks for and the corpus hasn't got, or not throughout."""
    asked = text_sources(query)
    asr = F.array_contains(asked, "asr")
    return _named([
        ("ASR_UNAVAILABLE", asr & F.lit(coverage.asr_segments <= 0)),
        ("ASR_PARTIAL", asr & F.lit(0 < coverage.asr_segments and coverage.asr_videos < coverage.total_videos)),
        ("OCR_UNAVAILABLE", F.array_contains(asked, "ocr") & F.lit(coverage.ocr_records <= 0)),
    ])


def question_route(question: Column) -> Column:
    """(question_type, answer_field) of the first cue that is a part of the question."""
    text = planner_normalize(question)
    route = lambda kind, answer: F.struct(F.lit(kind).alias("question_type"), F.lit(answer).cast("string").alias("answer_field"))
    return F.coalesce(*[F.when(_any_part(text, cues), route(kind, answer)) for kind, cues, answer in QUESTION_CUES], route("unknown", None))


def question_type(question: Column) -> Column:
    return question_route(question)["question_type"]


def gap_class(seconds: Column) -> Column:
    out = None
    for most, name in GAP_CLASSES:
        out = F.when(seconds <= most, name) if out is None else out.when(seconds <= most, name)
    return out.when(seconds.isNotNull(), "long")


def plan_queries(queries: DataFrame, text: str = "query_text", max_variants: int = 3, coverage: Coverage | None = None) -> DataFrame:
    """The query table with what the rules say of each query; lists are arrays.

    objects, text_hints, metadata_hints, temporal_hints: what it names; modalities, routes, intent, profile: where to ask;
    visual_query: its scene without marker words; variants: itself, that and its quotations (`max_variants`, five at most);
    events: the moments of its scene; source_filters, warnings: kinds of documents, and what the corpus lacks of them;
    question_type, answer_field. A null query has null lists; an empty one asks clip for nothing.
    """
    q = F.trim(F.col(text))
    norm, scene = F.col("__norm"), F.col("__scene")
    compact = F.col("__compact")
    lone = F.create_map(F.lit("clip"), F.lit("visual"), F.lit("bge"), F.lit("semantic_text"), F.lit("bm25"), F.lit("lexical_text"))
    planned = queries.withColumns({"__norm": planner_normalize(q), "__scene": planner_normalize(question_scene(q)), "modalities": modalities(q), "routes": routes(q)})
    planned = planned.withColumn("__compact", without_phrases(scene, (*TEXT_MARKERS, *SPEECH_MARKERS, *METADATA_MARKERS)))
    listed = F.array_distinct(F.concat(F.array(q), F.when((compact != "") & (compact != norm), F.array(compact)).otherwise(F.array().cast("array<string>")), quoted_phrases(q)))
    several = F.size("routes") > 1
    route = question_route(q)
    return planned.withColumns({
        "objects": objects(norm),
        "text_hints": F.concat(phrases_in(norm, TEXT_MARKERS), phrases_in(norm, SPEECH_MARKERS)),
        "metadata_hints": phrases_in(norm, METADATA_MARKERS),
        "temporal_hints": phrases_in(norm, TEMPORAL_MARKERS),
        "visual_query": F.when(compact != "", compact).otherwise(q),
        "variants": F.slice(listed, 1, max(1, min(max_variants, 5))),
        "events": split_events(scene),
        "intent": F.when(several, "mixed").otherwise(lone[F.get("routes", F.lit(0))]),
        "profile": F.concat(F.array_join("routes", "_"), F.when(several, "_rrf").otherwise("")),
        "source_filters": F.when(F.arrays_overlap("routes", F.array(F.lit("bge"), F.lit("bm25"))), text_sources(q)).otherwise(F.array().cast("array<string>")),
        "warnings": coverage_warnings(q, coverage or Coverage()),
        "question_type": route["question_type"],
        "answer_field": route["answer_field"],
    }).drop("__norm", "__scene", "__compact")


def select_variants(plan: DataFrame, selected: Column, text: str = "query_text") -> DataFrame:
    """Only the selected ones of a plan's variants; the query itself where none of them is left."""
    chosen = F.filter(selected, lambda v: F.array_contains("variants", v))
    return plan.withColumn("variants", F.when(F.size(chosen) > 0, chosen).otherwise(F.array(F.trim(F.col(text)))))


def _first_word(folded: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(folded.rlike(rf"(?U)\b{w}\b"), F.lit(w)) for w in words])


def _clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.btrim(nfc(c), F.lit(" \t\r\n,;.")), r"(?U)\s+", " "))


def temporal_parts(queries: DataFrame, text: str = "query_text") -> DataFrame:
    """The query table with `parts` (texts of moments in order), `status` and `review`: split at connectors that say an order,
    else at one that says the reverse; a query with a mere hint at an order stays whole and asks for review.

    status: OK, EMPTY_QUERY or TOO_MANY_EVENTS (more than five; parts are null then).
    """
    tidy = lambda parts: F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(F.btrim(p, F.lit(" \t\r\n,;.")), r"(?U)\s+", " "))), lambda p: p != "")
    d = queries.withColumn("__clean", _clean(F.coalesce(F.col(text), F.lit(""))))
    d = d.withColumns({"__forward": tidy(F.split("__clean", FORWARD_CONNECTOR)), "__before": tidy(F.split("__clean", BEFORE_CONNECTOR))})
    parts = F.when(F.size("__forward") > 1, F.col("__forward")).when(F.size("__before") > 1, F.col("__before")).otherwise(F.array("__clean"))
    d = d.withColumns({"parts": parts})
    status = F.when(F.col("__clean") == "", "EMPTY_QUERY").when(F.size("parts") > MOST_EVENTS, "TOO_MANY_EVENTS").otherwise("OK")
    d = d.withColumns({"status": status, "review": (F.size("parts") == 1) & F.col("__clean").rlike(TEMPORAL_HINT)})
    return d.withColumn("parts", F.when(F.col("status") == "OK", F.col("parts"))).drop("__clean", "__forward", "__before")


def sequence_events(queries: DataFrame, query_id: str = "query_id", text: str = "query_text", default_gap: float | None = None) -> DataFrame:
    """One row for each moment of each query: query_id, event_id (e1, e2, ...), event_order, event_text, modalities, color, object,
    subject, action, location, terms (quotations, where text or speech is meant), variants, max_gap_seconds, gap_class,
    global_context, confidence, warnings.

    With `default_gap`, each moment but the first may follow the one before it within that time, less where the query says
    `immediately`, more where it says `later`. A query that asks for review has a confidence of .65 instead of .9.
    """
    q = temporal_parts(queries.select(F.col(query_id).alias("query_id"), F.col(text).alias("query_text"))).withColumn("__all", event_fold("query_text"))
    context = F.coalesce(*[F.when(_any_part(F.col("__all"), words), F.lit(name)) for name, words in CONTEXT_WORDS])
    wait = F.lit(None).cast("double")
    if default_gap is not None:
        soon, late = _any_part(F.col("__all"), SOON_WORDS), _any_part(F.col("__all"), LATE_WORDS)
        wait = F.when(soon, F.lit(min(default_gap, SOON_SECONDS))).when(late, F.lit(max(default_gap, LATE_SECONDS))).otherwise(F.lit(float(default_gap)))
    q = q.withColumns({"global_context": context, "__wait": wait, "confidence": F.when(F.col("review"), 0.65).otherwise(0.9), "__n": F.size("parts")})
    e = q.select("*", F.posexplode("parts").alias("__at", "event_text")).withColumn("__f", event_fold("event_text"))
    f, follows = F.col("__f"), (F.col("__at") > 0) & (F.col("__n") > 1)
    color, thing = _first_word(f, COLOR_WORDS), _first_word(f, OBJECT_WORDS)
    ocr, asr = _any_part(f, OCR_WORDS), _any_part(f, ASR_WORDS)
    said = F.when(_any_part(f, SOON_WORDS), "short").when(_any_part(f, LATE_WORDS), "long")
    return e.select(
        "query_id", F.concat(F.lit("e"), (F.col("__at") + 1).cast("string")).alias("event_id"), (F.col("__at") + 1).alias("event_order"), "event_text",
        _named([("clip", F.lit(True)), ("ocr", ocr), ("asr", asr), ("attribute", color.isNotNull()), ("object", thing.isNotNull())]).alias("modalities"),
        color.alias("color"), thing.alias("object"), _first_word(f, SUBJECT_WORDS).alias("subject"), _first_word(f, ACTION_WORDS).alias("action"), _first_word(f, LOCATION_WORDS).alias("location"),
        F.when(ocr | asr, F.array_distinct(quoted_phrases(F.col("event_text")))).otherwise(F.array().cast("array<string>")).alias("terms"), query_variants(F.col("event_text")).alias("variants"),
        F.when(follows, F.col("__wait")).alias("max_gap_seconds"), F.coalesce(said, F.when(follows, gap_class(F.col("__wait")))).alias("gap_class"), "global_context", "confidence",
        _named([(REVIEW_WARNING, F.col("review")), (LOW_CONFIDENCE_WARNING, F.col("confidence") < 0.7)]).alias("warnings"),
    )
