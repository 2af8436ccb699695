"""Lexical search: BM25 with per-column phrases, and field-weighted BM25 with bonuses for exact words and phrases."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidsift.functions.text import date_tokens, fold_exact, normalize_exact, searchable, spelled, tokens, unmarked
from vidsift.operators.ranking import ORDER_DIGITS, by_score, rank_by
from vidsift.session import spread

K1, B = 1.2, 0.75
#: Terms of all queries up to which they go to all tasks (some MB); more are joined.
BROADCAST_TERMS = 500_000
#: Documents and queries that are scored at a time.
DOC_BLOCK, QUERY_BLOCK = 2_048, 1_024
#: For terms in half of the documents or more.
LEAST_IDF = 1e-6
# Bonuses for an original word, and for the whole query as spelled, or as folded, within a field.
WORD_BONUS = 0.35
SPELLED_BONUS = {"title": 3.0, "author": 2.5, "keywords": 2.0, "description": 0.5}
FOLDED_BONUS = {"title": 0.8, "author": 0.6, "keywords": 0.5, "description": 0.1}


def _tagged(c: Column, tag: Column, name: str) -> Column:
    """The tokens of a text as structs (tag, term); none where it is null."""
    return F.transform(F.coalesce(tokens(c), F.array().cast("array<string>")), lambda t: F.struct(tag.alias(name), t.alias("term")))


def _numbered(terms: Column, i: int) -> Column:
    return F.transform(terms, lambda t: F.struct(F.lit(i).alias("field"), t.alias("term")))


def postings(docs: DataFrame, doc_id: str, fields: Mapping[str, str]) -> DataFrame:
    """doc_id, field, term, tf, dl: term counts by column; dl is the number of tokens over all columns.

    One exchange: tokens are counted within each document before anything moves, so a frequent term weighs
    no more than the documents that hold it.
    """
    each = [_tagged(F.col(c), F.lit(name), "field") for name, c in fields.items()]
    all_tokens = docs.select(F.col(doc_id).alias("doc_id"), F.concat(*each).alias("t")).withColumn("dl", F.size("t").cast("long"))
    return all_tokens.select("doc_id", "dl", F.explode("t").alias("x")).groupBy("doc_id", "dl", F.col("x.field").alias("field"), F.col("x.term").alias("term")).agg(F.count(F.lit(1)).alias("tf"))


def plain_terms(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def expanded_terms(text: Column) -> Column:
    """The words of a query as spelled and without accents, and its dates as DDMMYYYY, each once."""
    folded = fold_exact(text)
    return F.array_distinct(F.concat(F.split(normalize_exact(text), " "), F.split(folded, " "), date_tokens(text, folded)))


def _best(score: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best positive scores of each column; equal ones by `order`."""
    shown = np.round(score, ORDER_DIGITS)
    if len(shown) > k:
        least = np.partition(shown, len(shown) - k, axis=0)[len(shown) - k]
        row, col = np.nonzero((shown >= least) & (score > 0))
    else:
        row, col = np.nonzero(score > 0)
    rank = np.lexsort((order[row], -shown[row, col], col))
    row, col = row[rank], col[rank]
    first = np.searchsorted(col, col)  # where the column's rows begin
    keep = np.arange(len(col)) - first < k
    return row[keep], col[keep]


def bm25(
    docs: DataFrame,
    queries: DataFrame,
    *,
    doc_id: str,
    fields: Mapping[str, str],
    query_id: str = "query_id",
    query_text: str = "query_text",
    k: int = 10,
    terms: Callable[[Column], Column] = plain_terms,
    index_form: Callable[[Column], Column] | None = None,
    among: Column | None = None,
) -> DataFrame:
    """query_id, doc_id, score, matched_terms, rank: OR over each query's terms, a phrase per term and column.

    idf = ln((N - n + .5) / (n + .5)), LEAST_IDF where that isn't positive, n: documents with the term in that
    column; score: the sum of idf * tf * 2.2 / (tf + 1.2 * (.25 + .75 * dl / mean dl)). Ties: the smaller doc_id.
    `terms` makes a query's terms. With `index_form`, texts and terms are brought into that form before they are compared,
    as an index does that drops accents; terms that become equal count as often as there are of them.
    With `among`, only documents for which it holds come out; counts cover all.

    Two reads: one counts the documents of each asked term (combined before anything moves), one scores documents where they
    lie and keeps each task's k best of each query; only these are exchanged. Queries of more than BROADCAST_TERMS terms
    together are joined with postings instead.
    """
    form = index_form or (lambda c: c)
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(terms(F.col(query_text))).alias("term")).filter("term <> ''")
    asked = asked.withColumn("term", form(F.col("term"))).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("weight"))
    names = list(fields)
    slim = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(fields.values())], (F.lit(True) if among is None else F.coalesce(among, F.lit(False))).alias("among"))
    d = spread(slim).select("doc_id", "among", *[F.coalesce(tokens(form(F.col(f"t{i}"))), F.array().cast("array<string>")).alias(f"f{i}") for i in range(len(names))])
    d = d.withColumn("dl", sum(F.size(f"f{i}") for i in range(len(names))).cast("long"))
    rows = asked.limit(BROADCAST_TERMS + 1).toArrow()
    if rows.num_rows > BROADCAST_TERMS:
        return _joined(d, asked, names, k)
    spark, key = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    number = pc.unique(rows["term"]).to_pylist()
    # a document without a word of its own counts documents and their lengths in the same read
    known = spark.createDataFrame([("",)] + [(t,) for t in number], "term string")
    mark = F.array(F.struct(F.lit(-1).alias("field"), F.lit("").alias("term")))
    each = d.select("dl", F.explode(F.concat(mark, *[_numbered(F.array_distinct(f"f{i}"), i) for i in range(len(names))])).alias("x"))
    counted = each.select("dl", "x.field", "x.term").join(F.broadcast(known), "term").groupBy("field", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("length")).collect()
    total, mean = next(((r["n"], r["length"] / r["n"]) for r in counted if r["field"] < 0), (0, 1.0))
    place = {t: i for i, t in enumerate(number)}
    idf = np.zeros((len(names), len(number)))
    for r in counted:
        if r["field"] >= 0:
            value = np.log((total - r["n"] + 0.5) / (r["n"] + 0.5))
            idf[r["field"], place[r["term"]]] = value if value > 0 else LEAST_IDF
    asking = pc.unique(rows["query_id"])
    who = pc.index_in(rows["query_id"].combine_chunks(), value_set=asking).to_numpy(zero_copy_only=False)
    what = np.array([place[t] for t in rows["term"].to_pylist()], dtype=np.int64)
    sent = spark.sparkContext.broadcast((place, idf, mean or 1.0, asking, who, what, rows["weight"].to_numpy().astype(np.float64)))
    qkey = queries.schema[query_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, idf, mean, asking, who, what, weight = sent.value
        for big in batches:
            for at in range(0, big.num_rows, DOC_BLOCK):
                batch = big.slice(at, DOC_BLOCK)
                n, part = batch.num_rows, np.zeros((batch.num_rows, len(place)))
                length = K1 * (1 - B + B * batch.column("dl").to_numpy() / mean)
                for f in range(len(idf)):
                    lists = batch.column(f"f{f}")
                    coded = lists.flatten().dictionary_encode()
                    code = np.array([place.get(w, -1) for w in coded.dictionary.to_pylist()], dtype=np.int64)
                    if not len(code):
                        continue
                    term, row = code[coded.indices.to_numpy(zero_copy_only=False)], pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
                    cell, tf = np.unique((row * len(place) + term)[term >= 0], return_counts=True)
                    row, term = cell // len(place), cell % len(place)
                    part[row, term] += idf[f, term] * tf * (K1 + 1) / (tf + length[row])
                held = np.flatnonzero(part.any(axis=0))
                order = pc.rank(batch.column("doc_id"), sort_keys="ascending", tiebreaker="first").to_numpy()
                for b in range(0, len(asking), QUERY_BLOCK):
                    own = (who >= b) & (who < b + QUERY_BLOCK) & np.isin(what, held)
                    wide = min(QUERY_BLOCK, len(asking) - b)
                    matrix = np.zeros((len(held), wide))
                    matrix[np.searchsorted(held, what[own]), who[own] - b] = weight[own]
                    block = part[:, held]
                    score = block @ matrix
                    row, col = _best(score, order, k)
                    # a phrase counts once, in however many columns it is found
                    matched = ((block[row] > 0) * matrix[:, col].T).sum(axis=1)
                    if len(row):
                        yield pa.RecordBatch.from_arrays(
                            [asking.take(pa.array(col + b)), batch.column("doc_id").take(pa.array(row)), pa.array(score[row, col]), pa.array(matched.astype(np.int64))], ["query_id", "doc_id", "score", "matched_terms"]
                        )

    scored = d.filter("among").mapInArrow(run, f"query_id {qkey}, doc_id {key}, score double, matched_terms long")
    return rank_by(scored, ["query_id"], [by_score("score"), F.col("doc_id")], "rank", k)


def _joined(d: DataFrame, asked: DataFrame, names: list[str], k: int) -> DataFrame:
    """The same by joins, for any number of queries: one exchange of the asked postings by document, then one by query."""
    stats = d.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("mean_dl"))
    each = F.concat(*[_numbered(F.col(f"f{i}"), i) for i in range(len(names))])
    found = d.select("doc_id", "dl", F.explode(each).alias("x")).select("doc_id", "dl", "x.field", "x.term").join(asked.select("term").distinct(), "term", "left_semi")
    tf = found.groupBy("doc_id", "dl", "term", "field").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))
    raw = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = df.crossJoin(F.broadcast(stats)).withColumn("idf", F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF)))  # stats is one row
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean_dl")))
    per_term = tf.join(d.filter("among").select("doc_id"), "doc_id", "left_semi").join(idf, ["term", "field"]).groupBy("doc_id", "term").agg(F.sum(part).alias("part"))
    agg = per_term.join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("part") * F.col("weight")).alias("score"), F.sum("weight").alias("matched_terms"))
    return rank_by(agg, ["query_id"], [by_score("score"), F.col("doc_id")], "rank", k)


_WORD = re.compile(r"\w+")


class _Fields:
    """Documents of a batch: folded words by weight of their fields, original words, and both spellings of each field."""

    def __init__(self, batch: pa.RecordBatch, weights: dict[str, float]) -> None:
        self.folded: list[Counter] = [Counter() for _ in range(batch.num_rows)]
        self.original: list[set[str]] = [set() for _ in range(batch.num_rows)]
        self.texts: dict[str, tuple[list[str], list[str]]] = {}
        for name, weight in weights.items():
            own = [spelled(t or "") for t in batch.column(name).to_pylist()]
            plain = [searchable(t) for t in own]
            self.texts[name] = own, plain
            for i, (a, b) in enumerate(zip(own, plain)):
                self.original[i].update(_WORD.findall(a))
                for w in _WORD.findall(b):
                    self.folded[i][w] += weight
        self.length = [sum(c.values()) for c in self.folded]


def fielded_bm25(docs: DataFrame, queries: DataFrame, *, doc_id: str, weights: Mapping[str, float], roles: Mapping[str, str] | None = None, query_id: str = "query_id", query_text: str = "query_text", k: int = 10, min_match: int = 1) -> DataFrame:
    """query_id, doc_id, score, matched_terms, rank: metadata search over weighted fields.

    Words are compared without case and accents (đ counts as d); a word weighs as its fields do, each query word counts as
    often as it is asked: qtf * idf * tf * 2.2 / (tf + 1.2 * (.25 + .75 * dl / mean dl)), idf = ln(1 + (N - n + .5) / (n + .5)).
    WORD_BONUS * qtf is added for a word that the document spells as asked. A query of several different words earns a
    bonus for each field that holds it whole, as spelled or else folded; `roles` says which bonus a field has (title, author,
    keywords, description). Documents with fewer than `min_match` of the folded words don't count. Null fields are empty.

    Two narrow reads; each task keeps its k best of each query. The queries are a driver-side set, refused beyond BROADCAST_TERMS.
    """
    spark, key, qkey = docs.sparkSession, docs.schema[doc_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    weights, roles = dict(weights), dict(roles or {})
    asked = queries.select(F.col(query_id).alias("q"), F.col(query_text).alias("t")).limit(BROADCAST_TERMS + 1).toArrow()
    if asked.num_rows > BROADCAST_TERMS:
        raise ValueError(f"at most {BROADCAST_TERMS} queries at a time")
    texts = [spelled(t or "") for t in asked["t"].to_pylist()]
    folded = [searchable(t) for t in texts]
    wanted = [Counter(_WORD.findall(t)) for t in folded]
    exact = [Counter(_WORD.findall(t)) for t in texts]
    words = {w for c in wanted for w in c}
    slim = spread(docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c).alias(c) for c in weights]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _Fields(batch, weights)
            df = Counter(w for c in own.folded for w in c if w in words)
            df[""] = batch.num_rows  # no word is empty
            yield pa.RecordBatch.from_arrays([pa.array(list(df)), pa.array(list(df.values()), pa.int64()), pa.array([0.0] * (len(df) - 1) + [float(sum(own.length))], pa.float64())], ["term", "n", "length"])

    sums = {r["term"]: (r["n"], r["length"]) for r in slim.mapInArrow(count, "term string, n long, length double").groupBy("term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).collect()}
    total = sums.get("", (0, 0.0))[0]
    mean = sum(x for _, x in sums.values()) / max(total, 1)
    idf = {w: float(np.log(1 + (total - n + 0.5) / (n + 0.5))) for w, (n, _) in sums.items() if w}
    sent = spark.sparkContext.broadcast((asked["q"].combine_chunks(), texts, folded, wanted, exact, idf, mean or 1.0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, texts, folded, wanted, exact, idf, mean = sent.value
        holders: dict[str, list[int]] = {}
        for q, c in enumerate(wanted):
            for w in c:
                if w in idf:
                    holders.setdefault(w, []).append(q)
        for batch in batches:
            own = _Fields(batch, weights)
            out: dict[int, list[tuple]] = {}
            for i, words in enumerate(own.folded):
                norm = K1 * (1 - B + B * own.length[i] / mean)
                found: dict[int, list[float]] = {}
                for w in words.keys() & holders.keys():
                    part = idf[w] * words[w] * (K1 + 1) / (words[w] + norm)
                    for q in holders[w]:
                        found.setdefault(q, []).append(wanted[q][w] * part)
                for q, parts in found.items():
                    if len(parts) < min_match:
                        continue
                    s = sum(parts) + WORD_BONUS * sum(n for w, n in exact[q].items() if w in own.original[i])
                    if len(exact[q]) > 1:
                        for name, role in roles.items():
                            a, b = own.texts[name]
                            s += SPELLED_BONUS[role] if texts[q] in a[i] else FOLDED_BONUS[role] if folded[q] in b[i] else 0.0
                    out.setdefault(q, []).append((i, s, len(parts)))
            ids = batch.column(0).to_pylist()
            rows = [(q, *x) for q, own_rows in out.items() for x in sorted(own_rows, key=lambda x: (-round(x[1], ORDER_DIGITS), ids[x[0]]))[:k]]
            q, i, s, m = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([asking.take(pa.array(q, pa.int64())), batch.column(0).take(pa.array(i, pa.int64())), pa.array(s, pa.float64()), pa.array(m, pa.int64())], ["query_id", "doc_id", "score", "matched_terms"])

    scored = slim.mapInArrow(score, f"query_id {qkey}, doc_id {key}, score double, matched_terms long")
    return rank_by(scored, ["query_id"], [by_score("score"), F.col("doc_id")], "rank", k)


def corpus_search(docs: DataFrame, queries: DataFrame, *, doc_id: str, normalized: str = "text_normalized", folded: str = "text_folded", **more) -> DataFrame:
    """BM25 over both stored forms of a text, as an index that drops accents: `bóng` asks `bóng` and `bong`, and counts for both."""
    return bm25(docs, queries, doc_id=doc_id, fields={"normalized": normalized, "folded": folded}, terms=expanded_terms, index_form=unmarked, **more)


def evidence_search(docs: DataFrame, queries: DataFrame, *, doc_id: str, min_confidence: float | None = None, normalized: str = "text_normalized", folded: str = "text_folded", k: int = 10, **more) -> DataFrame:
    """BM25 over on-screen texts or speech segments: words as spelled and without accents, in either form. Counts cover all rows;
    rows below `min_confidence` (or without one, where it is asked for) don't come out. k is 1 to 500."""
    words = lambda c: F.array_distinct(F.concat(F.split(normalize_exact(c), " "), F.split(fold_exact(c), " ")))
    among = None if min_confidence is None else F.col("confidence") >= min_confidence
    return bm25(docs, queries, doc_id=doc_id, fields={"n": normalized, "f": folded}, terms=words, k=max(1, min(k, 500)), among=among, **more)
