"""Text functions, lexical search and corpus queries over documents, ocr, asr and eval_items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidsift.functions import text as T
from vidsift.operators import corpus, lexical, ranking
from vidsift.plans import planner
from vidsift.registry import Registry
from vidsift.sources.tables import table

registry = Registry()

_TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
_D = _TOKENS.format("text")


def _tok(c: str) -> str:
    return _TOKENS.format(c)


_BM25 = f"""
WITH d AS (SELECT doc_id, 'text' AS field, coalesce({_tok('text')}, []) AS t FROM documents),
l AS (SELECT doc_id, len(t) AS dl FROM d), st AS (SELECT count(*) AS n_docs, avg(dl) AS mean_dl FROM l),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_tok('query_text')}) AS term FROM eval_items),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
i AS (SELECT term, CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM df, st),
p AS (SELECT query_id, doc_id, term, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean_dl)) AS part
      FROM q JOIN tf USING (term) JOIN i USING (term) JOIN l USING (doc_id), st),
a AS (SELECT query_id, doc_id, sum(part) AS score, count(DISTINCT term) AS matched_terms FROM p GROUP BY ALL)
"""


@registry(_BM25 + "SELECT query_id, doc_id, round(score, 6) AS score, matched_terms, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM a QUALIFY rank <= 10")
def bm25_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Every evaluation item asks the corpus."""
    q = table(spark, sf, "eval_items").select(F.col("item_id").alias("query_id"), "query_text")
    hits = lexical.bm25(table(spark, sf, "documents"), q, doc_id="doc_id", fields={"text": "text"})
    return hits.withColumn("score", F.round("score", 6))


# Words as spelled and without accents; the second form also takes đ for d.
_N = "trim(regexp_replace(lower(nfc_normalize({0})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_F = "trim(regexp_replace(replace(strip_accents(lower({0})), 'đ', 'd'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _two_column_bm25(table_name: str, key: str, query: str, form: str = "{0}", keep: str = "true", k: int = 10) -> str:
    """BM25 over text_normalized and text_folded; `query` gives query_id and term, each a phrase."""
    tok = lambda c: f"coalesce({_TOKENS.format(form.format(c))}, [])"
    return f"""
WITH d AS (SELECT {key}, confidence_, {tok('text_normalized')} AS a, {tok('text_folded')} AS b FROM (SELECT *, {keep} AS confidence_ FROM {table_name})),
l AS (SELECT {key}, len(a) + len(b) AS dl FROM d), st AS (SELECT count(*) AS n_docs, avg(dl) AS mean_dl FROM l),
q AS ({query}), w AS (SELECT query_id, {form.format('term')} AS term, count(*) AS weight FROM q WHERE term <> '' GROUP BY ALL),
tf AS (SELECT {key}, field, term, count(*) AS tf FROM (SELECT {key}, 'a' AS field, unnest(a) AS term FROM d UNION ALL SELECT {key}, 'b', unnest(b) FROM d) WHERE term IN (SELECT term FROM w) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
i AS (SELECT field, term, CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM df, st),
p AS (SELECT query_id, {key}, term, any_value(weight) AS weight, sum(weight * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean_dl))) AS part
      FROM w JOIN tf USING (term) JOIN i USING (field, term) JOIN l USING ({key}), st GROUP BY ALL),
s AS (SELECT query_id, {key}, sum(part) AS score, sum(weight)::BIGINT AS matched_terms FROM p JOIN d USING ({key}) WHERE confidence_ GROUP BY ALL)
SELECT query_id, {key}, round(score, 6) AS score, matched_terms, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {key}) AS rank FROM s QUALIFY rank <= {k}"""


_SPELLINGS = f"SELECT DISTINCT item_id AS query_id, unnest(string_split({_N.format('query_text')}, ' ') || string_split({_F.format('query_text')}, ' ')) AS term FROM eval_items"
_DATES = f"""
UNION SELECT item_id, lpad(x[1], 2, '0') || lpad(x[2], 2, '0') || x[3] FROM (SELECT item_id, regexp_extract_all(d, '\\d+') AS x FROM (
  SELECT item_id, unnest(regexp_extract_all({_F.format('query_text')}, '\\bngay\\s+\\d{{1,2}}\\s+thang\\s+\\d{{1,2}}\\s+nam\\s+\\d{{4}}\\b') || regexp_extract_all(query_text, '\\b\\d{{1,2}}[./-]\\d{{1,2}}[./-]\\d{{4}}\\b')) AS d FROM eval_items))"""


@registry(_two_column_bm25("documents", "doc_id", _SPELLINGS + _DATES, "strip_accents(lower({0}))"))
def corpus_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every evaluation item asks both stored forms of the corpus, with and without accents, and by its dates."""
    q = table(spark, sf, "eval_items").select(F.col("item_id").alias("query_id"), "query_text")
    hits = lexical.corpus_search(table(spark, sf, "documents"), q, doc_id="doc_id")
    return hits.withColumn("score", F.round("score", 6))


@registry(_two_column_bm25("ocr", "ocr_id", _SPELLINGS))
def ocr_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every evaluation item asks the on-screen texts: two columns, each term a phrase of its own in each."""
    q = table(spark, sf, "eval_items").select(F.col("item_id").alias("query_id"), "query_text")
    hits = lexical.evidence_search(table(spark, sf, "ocr"), q, doc_id="ocr_id")
    return hits.select("query_id", F.col("doc_id").alias("ocr_id"), F.round("score", 6).alias("score"), "matched_terms", "rank")


@registry(_two_column_bm25("asr", "asr_id", _SPELLINGS, keep="coalesce(confidence >= 0.6, false)"))
def asr_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every evaluation item asks the speech segments; only confident ones come out, counts cover all."""
    q = table(spark, sf, "eval_items").select(F.col("item_id").alias("query_id"), "query_text")
    hits = lexical.evidence_search(table(spark, sf, "asr"), q, doc_id="asr_id", min_confidence=0.6)
    return hits.select("query_id", F.col("doc_id").alias("asr_id"), F.round("score", 6).alias("score"), "matched_terms", "rank")


_WORDS = "regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+')"


@registry(
    f"""
WITH f AS (SELECT p_partkey, lower(p_name) AS n, lower(p_brand) AS b, lower(p_type) AS y FROM part),
d AS (SELECT p_partkey, unnest({_WORDS.format('n')}) AS term, 3.0 AS w FROM f UNION ALL SELECT p_partkey, unnest({_WORDS.format('b')}), 2.0 FROM f UNION ALL SELECT p_partkey, unnest({_WORDS.format('y')}), 1.0 FROM f),
l AS (SELECT p_partkey, sum(w) AS dl FROM d GROUP BY 1), st AS (SELECT (SELECT count(*) FROM part) AS n_docs, (SELECT sum(dl) FROM l) / (SELECT count(*) FROM part) AS mean_dl),
qs AS (SELECT row_number() OVER (ORDER BY p_type) AS query_id, lower(p_type) AS query_text FROM (SELECT DISTINCT p_type FROM part)),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_WORDS.format('query_text')}) AS term FROM qs) GROUP BY ALL),
tf AS (SELECT p_partkey, term, sum(w) AS tf FROM d GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
a AS (SELECT query_id, p_partkey, sum(qtf * (ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean_dl)) + 0.35)) AS score, count(*) AS matched_terms
      FROM q JOIN tf USING (term) JOIN df USING (term) JOIN l USING (p_partkey), st GROUP BY ALL),
z AS (SELECT query_id, p_partkey, matched_terms, score + CASE WHEN (SELECT count(*) FROM q WHERE q.query_id = a.query_id) > 1 THEN
        CASE WHEN contains(n, query_text) THEN 3.0 ELSE 0 END + CASE WHEN contains(b, query_text) THEN 2.5 ELSE 0 END + CASE WHEN contains(y, query_text) THEN 0.5 ELSE 0 END ELSE 0 END AS score
      FROM a JOIN f USING (p_partkey) JOIN qs USING (query_id))
SELECT query_id, p_partkey, round(score, 6) AS score, matched_terms, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, p_partkey) AS rank FROM z QUALIFY rank <= 10"""
)
def bm25_fielded(spark: SparkSession, sf: str) -> DataFrame:
    """Every type asks the parts: name three times, brand twice, type once, with bonuses for words and phrases as spelled."""
    part = table(spark, sf, "part")
    w = Window.orderBy("p_type")  # the distinct types, a handful
    q = part.select("p_type").distinct().select(F.row_number().over(w).cast("long").alias("query_id"), F.col("p_type").alias("query_text"))
    hits = lexical.fielded_bm25(part, q, doc_id="p_partkey", weights={"p_name": 3.0, "p_brand": 2.0, "p_type": 1.0}, roles={"p_name": "title", "p_brand": "author", "p_type": "description"})
    return hits.select("query_id", F.col("doc_id").alias("p_partkey"), F.round("score", 6).alias("score"), "matched_terms", "rank")


@registry(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({_D}) AS term FROM documents) GROUP BY 1 ORDER BY df DESC, term LIMIT 50")
def token_df_topn(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty terms of most documents: a report; terms are counted per document before anything is exchanged."""
    p = lexical.postings(table(spark, sf, "documents"), "doc_id", {"text": "text"})
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")).orderBy(F.desc("df"), "term").limit(50)


@registry(f"SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len({_D}) AS dl, unnest({_D}) AS term FROM documents) GROUP BY doc_id, term")
def postings(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.postings(table(spark, sf, "documents"), "doc_id", {"text": "text"}).select("doc_id", "term", "tf", "dl")


def _casefolded(column: str) -> str:
    """Full case folding of what the texts hold: lower case, and letters that fold to others."""
    for a, b in {"ß": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "µ": "μ", "ſ": "s", "ς": "σ"}.items():
        column = f"replace({column}, '{a}', '{b}')"
    return column


@registry(f"SELECT doc_id, trim(regexp_replace({_casefolded('lower(nfc_normalize(text))')}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS normalized FROM documents WHERE text IS NOT NULL")
def normalized_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The exact normaliser over every text; also tested on a fixture against a plain loop."""
    d = table(spark, sf, "documents").filter(F.col("text").isNotNull())
    return d.select("doc_id", T.normalize_exact(F.col("text")).alias("normalized"))


@registry("SELECT asr_id, trim(regexp_replace(replace(strip_accents(replace(lower(text_raw), 'ß', 'ss')), 'đ', 'd'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS folded FROM asr WHERE text_raw IS NOT NULL")
def folded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """fold_exact over every speech text; tested on a fixture against a plain loop."""
    d = table(spark, sf, "asr").filter(F.col("text_raw").isNotNull())
    return d.select("asr_id", T.fold_exact(F.col("text_raw")).alias("folded"))


@registry("""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', E'\\n\\n', 'g'), ' ') AS cleaned, substring(text, 1, 240) AS preview, length(text) AS n FROM documents WHERE text IS NOT NULL""")
def metadata_texts(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").filter(t.isNotNull()).select("doc_id", T.metadata_text(t).alias("cleaned"), T.preview(t).alias("preview"), F.length(t).cast("long").alias("n"))


@registry("""SELECT item_id, CASE
  WHEN regexp_matches(lower(query_text), 'red|đỏ|do') THEN 'red' WHEN regexp_matches(lower(query_text), 'blue|xanh duong|xanh dương') THEN 'blue'
  WHEN regexp_matches(lower(query_text), 'green|xanh la|xanh lá') THEN 'green' WHEN regexp_matches(lower(query_text), 'yellow|vang|vàng') THEN 'yellow'
  WHEN regexp_matches(lower(query_text), 'white|trang|trắng') THEN 'white' WHEN regexp_matches(lower(query_text), 'black|den|đen') THEN 'black'
  WHEN regexp_matches(lower(query_text), 'orange|cam') THEN 'orange' WHEN regexp_matches(lower(query_text), 'pink|hong|hồng') THEN 'pink'
  WHEN regexp_matches(lower(query_text), 'purple|tim|tím') THEN 'purple' WHEN regexp_matches(lower(query_text), 'brown|nau|nâu') THEN 'brown' END AS color FROM eval_items""")
def query_colors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_items").select("item_id", T.color_of(F.col("query_text")).alias("color"))


@registry("""SELECT item_id, array_to_string(list_filter(list_transform(regexp_extract_all(query_text, '["“”]([^"“”]+)["“”]', 1), lambda p: trim(p)), lambda p: p <> ''), '|') AS quoted,
  regexp_matches(lower(query_text), '(^|[^\\p{L}\\p{N}_\\p{M}])sign($|[^\\p{L}\\p{N}_\\p{M}])') AS has_sign FROM eval_items""")
def query_phrases(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("query_text")
    return table(spark, sf, "eval_items").select("item_id", F.array_join(T.quoted_phrases(t), "|").alias("quoted"), T.contains_phrase(T.planner_normalize(t), "sign").alias("has_sign"))


# Normalised queries, and whether one of several phrases stands between other characters than those of words; the lists are
# written out here, apart from the planner's tables, so that a word that is missing there shows.
_QUERY = "SELECT item_id, query_text, trim(regexp_replace(lower(nfc_normalize(query_text)), '\\s+', ' ', 'g')) AS t FROM eval_items"
_EDGE = "[^\\p{L}\\p{N}_\\p{M}]"


def _stands(column: str, phrases: str) -> str:
    return f"regexp_matches({column}, '(^|{_EDGE})({phrases})($|{_EDGE})')"


_SQL_TEXT = "chữ|text|biển hiệu|biển báo|logo|phụ đề|ghi|hiển thị|bảng|ký tự|con số|số mấy|địa chỉ|đường nào|màn hình|đếm ngược|written|sign|caption|countdown"
_SQL_SPEECH = "nói|phát biểu|nhắc đến|được nhắc đến|nghe|lời thoại|trò chuyện|đối thoại|trả lời|says|speaks|talks|conversation"
_SQL_METADATA = "kênh|tác giả|ngày|tiêu đề|channel|author|published"
_SQL_EXACT = "chính xác|nguyên văn|từ khóa|mã|mã số|số hiệu|con số|số mấy|số lượng|số thứ tự|bao nhiêu|chữ|ký tự|biển hiệu|biển báo|bảng|ghi|hiển thị|địa chỉ|đường nào|exact|keyword|code|written|sign"
_SQL_CONTENT = "nội dung|chủ đề|bản tin|đề cập|nhắc đến|được nhắc đến|nói|phát biểu|trò chuyện|đối thoại|trả lời|lời thoại|content|topic|report|about|mentions|says|speech|conversation"
_SQL_VISUAL = (
    "cảnh|khung hình|hình ảnh|đoạn phim|đoạn clip|người|cô gái|người đàn ông|người phụ nữ|cụ ông|cụ bà|xe|ô tô|mặc|màu|cầm|đặt|đứng|ngồi|đi|chạy|rẽ|nấu|bên cạnh|phía sau|"
    "scene|frame|image|person|man|woman|car|wearing|holding|standing|sitting|walking|driving|cooking"
)
_SQL_PLAN = f"""
WITH t AS ({_QUERY}),
f AS (SELECT item_id, query_text, t, {_stands('t', 'phone|điện thoại|smartphone')} AS phone, {_stands('t', 'car|vehicle|ô tô|xe hơi')} AS car, {_stands('t', 'person|people|người|man|woman')} AS person,
      {_stands('t', 'bicycle|bike|xe đạp')} AS bicycle, {_stands('t', 'đỏ|xanh|vàng|trắng|đen|hồng|green|red|blue|white|black')} AS attributes, {_stands('t', _SQL_TEXT)} AS said_text,
      regexp_matches(query_text, '["“”][^"“”]*[^"“” ][^"“”]*["“”]') AS quotes, {_stands('t', _SQL_SPEECH)} AS asr, {_stands('t', _SQL_METADATA)} AS metadata,
      {_stands('t', _SQL_EXACT)} AS exact, regexp_matches(t, '{_SQL_CONTENT}') AS content, {_stands('t', _SQL_VISUAL)} AS seen FROM t),
r AS (SELECT *, phone OR car OR person OR bicycle AS objects, said_text OR quotes AS ocr FROM f),
p AS (SELECT *, ocr OR metadata OR exact AS lexical, asr OR content AS semantic FROM r),
v AS (SELECT *, objects OR attributes OR seen OR NOT (lexical OR semantic) AS visual FROM p)
"""


@registry(f"""
SELECT item_id, CASE WHEN regexp_matches(t, 'channel id') THEN 'metadata' WHEN regexp_matches(t, 'channel') THEN 'metadata' WHEN regexp_matches(t, 'bao nhiêu|how many|mấy |số lượng|number of') THEN 'count'
  WHEN regexp_matches(t, 'trước|sau|tiếp theo|before|after|next') THEN 'temporal' WHEN regexp_matches(t, 'nói gì|phát biểu|nhắc đến|lời thoại|what does|say|speak') THEN 'asr'
  WHEN regexp_matches(t, 'ghi gì|viết gì|chữ|biển hiệu|logo|text|sign') THEN 'ocr' WHEN regexp_matches(t, 'kênh nào|tác giả|đăng ngày|tiêu đề|author|published|title') THEN 'metadata'
  WHEN regexp_matches(t, 'màu|color|colour') THEN 'attribute_color' WHEN regexp_matches(t, 'cầm gì|vật gì|đối tượng|what is|what object|holding') THEN 'object'
  WHEN regexp_matches(t, 'ai|ở đâu|mặc|trông|who is|where is') THEN 'visual' ELSE 'unknown' END AS question_type,
  CASE WHEN regexp_matches(t, 'channel id') THEN 'channel_id' WHEN regexp_matches(t, 'channel') THEN 'author' END AS answer_field FROM ({_QUERY})""")
def question_types(spark: SparkSession, sf: str) -> DataFrame:
    route = planner.question_route(F.col("query_text"))
    return table(spark, sf, "eval_items").select("item_id", route["question_type"].alias("question_type"), route["answer_field"].alias("answer_field"))


@registry(_SQL_PLAN + """
SELECT item_id, concat_ws(',', 'clip', CASE WHEN objects THEN 'objects' END, CASE WHEN attributes THEN 'attributes' END, CASE WHEN ocr THEN 'ocr' END, CASE WHEN asr THEN 'asr' END, CASE WHEN metadata THEN 'metadata' END) AS modalities,
  concat_ws(',', CASE WHEN visual THEN 'clip' END, CASE WHEN semantic THEN 'bge' END, CASE WHEN lexical THEN 'bm25' END) AS routes,
  CASE WHEN visual::INT + semantic::INT + lexical::INT > 1 THEN 'mixed' WHEN visual THEN 'visual' WHEN semantic THEN 'semantic_text' ELSE 'lexical_text' END AS intent,
  concat_ws(',', CASE WHEN phone THEN 'phone' END, CASE WHEN car THEN 'car' END, CASE WHEN person THEN 'person' END, CASE WHEN bicycle THEN 'bicycle' END) AS objects FROM v""")
def query_routes(spark: SparkSession, sf: str) -> DataFrame:
    p = planner.plan_queries(table(spark, sf, "eval_items"))
    return p.select("item_id", F.array_join("modalities", ",").alias("modalities"), F.array_join("routes", ",").alias("routes"), "intent", F.array_join("objects", ",").alias("objects"))


@registry(_SQL_PLAN + """
SELECT item_id, CASE WHEN semantic OR lexical THEN concat_ws(',', CASE WHEN asr THEN 'asr' END, CASE WHEN ocr AND (said_text OR NOT asr) THEN 'ocr' END, CASE WHEN metadata THEN 'metadata' END) ELSE '' END AS source_filters,
  concat_ws(',', CASE WHEN asr THEN 'ASR_PARTIAL' END, CASE WHEN ocr AND (said_text OR NOT asr) THEN 'OCR_UNAVAILABLE' END) AS warnings,
  concat_ws('_', CASE WHEN visual THEN 'clip' END, CASE WHEN semantic THEN 'bge' END, CASE WHEN lexical THEN 'bm25' END) || CASE WHEN visual::INT + semantic::INT + lexical::INT > 1 THEN '_rrf' ELSE '' END AS profile FROM v""")
def query_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of documents each query is limited to, and what a corpus with little speech and no on-screen text lacks."""
    p = planner.plan_queries(table(spark, sf, "eval_items"), coverage=planner.Coverage(asr_segments=563, asr_videos=2, total_videos=873))
    return p.select("item_id", F.array_join("source_filters", ",").alias("source_filters"), F.array_join("warnings", ",").alias("warnings"), "profile")


def _listed(column: str, phrases: str) -> str:
    return f"array_to_string(list_filter(string_split('{phrases}', '|'), lambda m: regexp_matches({column}, '(^|{_EDGE})' || m || '($|{_EDGE})')), ',')"


@registry(f"""SELECT item_id, {_listed('t', _SQL_TEXT + '|' + _SQL_SPEECH)} AS text_hints, {_listed('t', _SQL_METADATA)} AS metadata_hints,
  {_listed('t', 'trước|sau|sau đó|tiếp theo|cuối cùng|before|after|then|finally')} AS temporal_hints FROM ({_QUERY})""")
def query_hints(spark: SparkSession, sf: str) -> DataFrame:
    p = planner.plan_queries(table(spark, sf, "eval_items"))
    return p.select("item_id", *[F.array_join(c, ",").alias(c) for c in ("text_hints", "metadata_hints", "temporal_hints")])


_ENDS = f"(^|{_EDGE})(sau đó|tiếp theo|cuối cùng|rồi|then|after that|finally)($|{_EDGE})"


@registry(f"""
WITH q AS ({_QUERY}),
e AS (SELECT item_id, t, query_text, list_transform(regexp_split_to_array(regexp_replace(regexp_replace(t, '{_ENDS}', '\\1;\\3', 'g'), '{_ENDS}', '\\1;\\3', 'g'), '[.!?;]+\\s*'), lambda p: trim(regexp_replace(trim(p, ' ,.;:-'), '\\s+', ' ', 'g'))) AS p FROM q),
k AS (SELECT item_id, t, query_text, list_filter(p, lambda x: length(x) >= 8) AS p FROM e),
u AS (SELECT item_id, t, query_text, list_filter(p, lambda x, i: list_position(p, x) = i)[1:5] AS p FROM k),
s AS (SELECT *, trim(regexp_replace(trim(query_text), '(?is)(?:[.!?]\\s*)?(?:hỏi|hãy cho biết|cho biết|question).*$', ''), ' ,.;:-') AS scene FROM u)
SELECT item_id, CASE WHEN len(p) > 0 THEN array_to_string(p, ' | ') ELSE t END AS events, CASE WHEN scene <> '' THEN scene ELSE trim(query_text) END AS scene FROM s""")
def query_events(spark: SparkSession, sf: str) -> DataFrame:
    """Moments and scene of each query."""
    t = F.col("query_text")
    return table(spark, sf, "eval_items").select("item_id", F.array_join(T.split_events(T.planner_normalize(t)), " | ").alias("events"), T.question_scene(t).alias("scene"))


@registry()
def query_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Other ways to ask each query; word boundaries of all scripts and the removal of markers one by one have no exact SQL form, tested on fixtures."""
    p = planner.plan_queries(table(spark, sf, "eval_items"), max_variants=5)
    return p.select("item_id", "visual_query", F.array_join("variants", " | ").alias("variants"), F.array_join(T.query_variants(F.col("query_text")), " | ").alias("substitutions"))


@registry()
def sequence_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Moments of each query with what they need, show and do; tested on fixtures."""
    e = planner.sequence_events(table(spark, sf, "eval_items").withColumn("query_id", F.col("item_id")), default_gap=60.0)
    return e.withColumns({c: F.array_join(c, ",") for c in ("modalities", "terms", "variants", "warnings")})


@registry("""SELECT doc_id, source_type || ':' || substring(sha256('{"doc_id":"' || doc_id || '","field":' || CASE WHEN source_field IS NULL THEN 'null' ELSE '"' || source_field || '"' END || ',"video_id":' || CASE WHEN video_id IS NULL THEN 'null' ELSE '"' || video_id || '"' END || '}'), 1, 24) AS document_key FROM documents""")
def corpus_ids_sha256(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    key = corpus.document_id(F.col("source_type"), {"doc_id": F.col("doc_id"), "field": F.col("source_field"), "video_id": F.col("video_id")})
    return d.select("doc_id", key.alias("document_key"))


@registry("""SELECT video_id, keyframe_id, string_agg(text_raw, ' ' ORDER BY o) AS text, count(*) AS texts FROM (
  SELECT video_id, keyframe_id, text_raw, min(ocr_id) AS o FROM ocr WHERE keyframe_id IS NOT NULL AND trim(text_raw) <> '' GROUP BY ALL) GROUP BY ALL""")
def frame_ocr_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Per frame the distinct texts in order of first occurrence."""
    return corpus.joined_texts(table(spark, sf, "ocr").filter("keyframe_id IS NOT NULL"), ["video_id", "keyframe_id"], "text_raw", "ocr_id")


@registry("SELECT source_type, count(*) AS documents, count(DISTINCT video_id) AS videos, count(keyframe_id) AS mapped, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.corpus_stats(table(spark, sf, "documents"))


@registry("""WITH d AS (SELECT source, doc_id, text_folded AS t, video_id, row_number() OVER (PARTITION BY source ORDER BY ingested_at DESC, doc_id) AS rank FROM documents WHERE source_type = 'ocr'),
o AS (SELECT *, row_number() OVER (PARTITION BY source, video_id, CASE WHEN coalesce(t, '') = '' THEN chr(1) || rank ELSE t END ORDER BY rank) AS c FROM d),
v AS (SELECT *, row_number() OVER (PARTITION BY source, video_id ORDER BY rank) AS n FROM o WHERE c = 1)
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY rank) AS rank FROM v WHERE n <= 4""")
def suppress_dupes(spark: SparkSession, sf: str) -> DataFrame:
    """On-screen texts by recency and feed: one hit per text of a video, four per video."""
    d = table(spark, sf, "documents").filter("source_type = 'ocr'").select("source", "doc_id", "video_id", "text_folded", "ingested_at")
    hits = ranking.rank_by(d, ["source"], [F.col("ingested_at").desc(), F.col("doc_id")], "rank")
    return ranking.suppress_texts(hits, "text_folded", query="source").select("source", "doc_id", "rank")


@registry("""SELECT source, lang, source_type, count(*) AS documents, grouping(source)::INTEGER AS no_source, grouping(lang)::INTEGER AS no_lang, grouping(source_type)::INTEGER AS no_type FROM documents GROUP BY CUBE (source, lang, source_type)""")
def corpus_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """All breakdowns at once, instead of a loop over attributes."""
    d = table(spark, sf, "documents").cube("source", "lang", "source_type")
    g = lambda c: F.grouping(c).cast("int")
    return d.agg(F.count(F.lit(1)).alias("documents"), g("source").alias("no_source"), g("lang").alias("no_lang"), g("source_type").alias("no_type"))


@registry("""SELECT doc_id, regexp_matches(regexp_replace(text, '[\\n\\r\\t]', '', 'g'), '\\p{Cc}') AS control, contains(text, chr(65533)) AS replaced, n_chars <> length(text) AS wrong_length FROM documents WHERE text IS NOT NULL""")
def text_flags(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").filter(t.isNotNull()).select("doc_id", T.has_control_characters(t).alias("control"), F.contains(t, F.lit("\ufffd")).alias("replaced"), (F.col("n_chars") != F.length(t)).alias("wrong_length"))


@registry("""SELECT ocr_id, list_aggregate(list_transform(regexp_extract_all(text_raw, '\\d{1,2}[./-]\\d{1,2}[./-]\\d{4}'), lambda d: d), 'count')::BIGINT AS dates, source_keyframe_id,
  regexp_matches(video_id, '^L\\d{2}_V\\d{3}$') AS valid_id, try_cast(nullif(regexp_extract(source_keyframe_id, '_F(\\d+)$', 1), '') AS BIGINT) AS frame FROM ocr""")
def id_parsing(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "ocr")
    frame = F.expr("try_cast(nullif(regexp_extract(source_keyframe_id, '_F(\\\\d+)$', 1), '') AS BIGINT)")
    dates = F.size(F.regexp_extract_all("text_raw", F.lit(r"(\d{1,2}[./-]\d{1,2}[./-]\d{4})"), F.lit(1)))
    return o.select("ocr_id", F.when(F.col("text_raw").isNotNull(), dates).cast("long").alias("dates"), "source_keyframe_id", F.col("video_id").rlike(T.VIDEO_ID_PATTERN).alias("valid_id"), frame.alias("frame"))


_JACCARD = f"""
WITH t AS (SELECT asr_id, video_id, segment_id, list_distinct(list_filter({_tok('text_raw')}, lambda x: length(x) >= 2)) AS k FROM asr),
n AS (SELECT asr_id, k, lead(k) OVER (PARTITION BY video_id ORDER BY segment_id, asr_id) AS nk FROM t)
SELECT asr_id, round(CASE WHEN len(list_distinct(k || nk)) > 0 THEN len(list_intersect(k, nk)) / len(list_distinct(k || nk)) ELSE 0 END, 6) AS jaccard FROM n WHERE nk IS NOT NULL AND k IS NOT NULL"""


@registry(_JACCARD)
def adjacent_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Token overlap of each speech segment with the next one of its video."""
    a = table(spark, sf, "asr").select("asr_id", "video_id", "segment_id", T.scoring_tokens(F.col("text_raw")).alias("k"))
    a = ranking.following(a, ["video_id"], "segment_id", "asr_id", ["k"]).withColumn("nk", F.col("next.k")).filter("k IS NOT NULL AND nk IS NOT NULL")
    both = F.size(F.array_union("k", "nk"))
    return a.select("asr_id", F.round(F.when(both > 0, F.size(F.array_intersect("k", "nk")) / both).otherwise(0.0), 6).alias("jaccard"))


@registry("""SELECT item_id, trim(lower(expected_answer), ' .,:;!?…') AS canonical FROM eval_items WHERE expected_answer IS NOT NULL""")
def answers_canonical(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "eval_items").filter("expected_answer IS NOT NULL")
    return a.select("item_id", T.answer_canonical(F.col("expected_answer")).alias("canonical"))


@registry("SELECT doc_id, row_number() OVER (ORDER BY source_type, video_id, coalesce(keyframe_id, -1), coalesce(pts_time, -1), doc_id) AS rank FROM documents WHERE video_id IS NOT NULL AND source_type IS NOT NULL")
def corpus_order(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each document in the corpus file's order, numbered over range partitions."""
    d = table(spark, sf, "documents").filter("video_id IS NOT NULL AND source_type IS NOT NULL").select("source_type", "video_id", "keyframe_id", "pts_time", "doc_id")
    return ranking.rank_by(d, [], corpus.corpus_order(), "rank").select("doc_id", "rank")
