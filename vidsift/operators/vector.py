"""Exact cosine search of query sets over stored vectors, and what is built on it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidsift.functions.vectors import norm
from vidsift.operators.ranking import by_score, rank_by

#: Queries that one pass holds: 4,096 vectors of 1,024 doubles are 32 MB in each task.
QUERY_BLOCK = 4_096


def _matrix(lists: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows and which rows are usable; others are zero."""
    fits = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False) == dims
    out = np.zeros((len(lists), dims))
    # a null within a vector becomes NaN
    out[fits] = lists.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    ok = fits & np.isfinite(out).all(axis=1) & out.any(axis=1)
    out[~ok] = 0.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300), ok


def _search(block, k: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = block.value
        for batch in batches:
            x, ok = _matrix(batch.column(1), dims)
            rest = [i for i in range(batch.num_columns) if i != 1]
            for a in range(0, len(ids), 512):
                s = np.where(ok[None, :], q[a : a + 512] @ x.T, -np.inf)
                if s.shape[1] > k:
                    # ties at the border go on too, the final rank decides between them
                    shown = np.round(s, 9)
                    cut = np.partition(shown, -k, axis=1)[:, -k]
                    rows, cols = np.nonzero((shown >= cut[:, None]) & np.isfinite(s))
                else:
                    rows, cols = np.nonzero(np.isfinite(s))
                if len(rows):
                    at = pa.array(cols)
                    own = [batch.column(i).take(at) for i in rest]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 512][rows]), *own, pa.array(s[rows, cols])], ["q", *[batch.schema.names[i] for i in rest], "s"])

    return run


def _blocks(queries: DataFrame, key: str, vector: str, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit rows of the usable queries, QUERY_BLOCK at a time: one small result, or, where there are more, a stream of rows."""
    q = queries.select(F.col(key).cast("long").alias("q"), F.col(vector).alias("v"))
    few = q.limit(QUERY_BLOCK + 1).toArrow()
    if few.num_rows <= QUERY_BLOCK:
        if few.num_rows:
            lists = few["v"].combine_chunks()
            unit, ok = _matrix(lists, dims)
            yield few["q"].to_numpy()[ok], unit[ok]
        return
    rows = q.toLocalIterator()
    while block := list(islice(rows, QUERY_BLOCK)):
        unit, ok = _matrix(pa.array([r["v"] for r in block], pa.list_(pa.float64())), dims)
        yield np.array([r["q"] for r in block])[ok], unit[ok]


def cosine_topk(index: DataFrame, queries: DataFrame, *, key: str, vector: str, query_key: str, query_vector: str, k: int, dims: int, carry: Sequence[str] = ()) -> DataFrame:
    """query_id, `key`, score, rank (from 1), carried columns: the k index rows with the highest cosine for each query.

    Rows and queries that are null, of another length, not finite or zero are left out. Ties: the smaller key. The
    queries pass in blocks of QUERY_BLOCK over all rows: one matrix product per Arrow batch, of which only each
    query's best k leave the task, with the columns they carry; so the exchange carries queries times k times tasks
    small rows, never vectors, and the index is read once a block.
    """
    spark = index.sparkSession
    slim = index.select(F.col(key).cast("long").alias("i"), F.col(vector).alias("v"), *[F.col(c).alias(f"c{n}") for n, c in enumerate(carry)])
    ddl = ", ".join(["q long", "i long", *[f"c{n} {index.schema[c].dataType.simpleString()}" for n, c in enumerate(carry)], "s double"])
    out = None
    for block in _blocks(queries, query_key, query_vector, dims):
        sent = spark.sparkContext.broadcast(block)
        one = slim.mapInArrow(_search(sent, k, dims), ddl)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], ddl)
    hits = rank_by(out, ["q"], [by_score("s"), F.col("i")], "rank", k)
    return hits.select(F.col("q").alias("query_id"), F.col("i").alias(key), F.col("s").alias("score"), "rank", *[F.col(f"c{n}").alias(c) for n, c in enumerate(carry)])


def _best(block, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = block.value
        for batch in batches:
            x, ok = _matrix(batch.column(1), dims)
            videos, code = np.unique(batch.column(2).to_numpy(zero_copy_only=False)[ok].astype(str), return_inverse=True)
            if not len(videos):
                continue
            pos = batch.column(0).to_numpy(zero_copy_only=False)[ok]
            order = np.lexsort((pos, code))
            x, pos, code = x[ok][order], pos[order], code[order]
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            for a in range(0, len(ids), 512):
                s = np.round(q[a : a + 512] @ x.T, 9)
                top = np.maximum.reduceat(s, starts, axis=1)
                for i, b in enumerate(starts):
                    e = starts[i + 1] if i + 1 < len(starts) else len(code)
                    # the first of equal scores has the smallest key
                    at = b + (s[:, b:e] == top[:, i : i + 1]).argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 512]), pa.array([videos[i]] * len(s)), pa.array(pos[at]), pa.array(top[:, i])], ["q", "g", "i", "s"])

    return run


def best_per_video(index: DataFrame, queries: DataFrame, *, key: str, vector: str, video: str, query_key: str, query_vector: str, dims: int) -> DataFrame:
    """query_id, `video`, `key`, score: the best row of each video for each query (ties: the smaller key), over all rows."""
    spark = index.sparkSession
    slim = index.select(F.col(key).cast("long").alias("i"), F.col(vector).alias("v"), F.col(video).alias("g"))
    out = spark.createDataFrame([], "q long, g string, i long, s double")
    for block in _blocks(queries, query_key, query_vector, dims):
        sent = spark.sparkContext.broadcast(block)
        out = out.unionByName(slim.mapInArrow(_best(sent, dims), "q long, g string, i long, s double"))
    best = out.groupBy("q", "g").agg(F.max(F.struct("s", (-F.col("i")).alias("neg"))).alias("b"))
    return best.select(F.col("q").alias("query_id"), F.col("g").alias(video), (-F.col("b.neg")).alias(key), F.col("b.s").alias("score"))


def video_scores(hits: DataFrame, mode: str = "max", best: int = 3, frames: int = 3, top: int | None = None) -> DataFrame:
    """Videos by their frames' scores: query_id, video_id, score, best_rank, frame_count, frames (its first keys), rank.

    max: the best frame's score; mean_top_n: the mean of the `best` highest (of all where there are fewer).
    Order: score, best rank, video_id.
    """
    ranked = rank_by(hits, ["query_id", "video_id"], [F.col("rank")], "__n")
    score = F.max("score") if mode == "max" else F.avg(F.when(F.col("__n") <= best, F.col("score")))
    few = F.transform(F.array_sort(F.collect_list(F.when(F.col("__n") <= frames, F.struct("__n", "frame_key")))), lambda x: x["frame_key"])
    agg = ranked.groupBy("query_id", "video_id").agg(score.alias("score"), F.min("rank").alias("best_rank"), F.count(F.lit(1)).alias("frame_count"), few.alias("frames"))
    return rank_by(agg, ["query_id"], [by_score("score"), F.col("best_rank"), F.col("video_id")], "rank", top)


def norm_stats(df: DataFrame, vector: str) -> DataFrame:
    n = norm(F.col(vector))
    finite = F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    d = df.select(n.alias("n"), finite.alias("f"))
    return d.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("f")).alias("finite_rows"), F.count_if(F.col("n") == 0).alias("zero_rows"),
        F.round(F.min("n"), 6).alias("min_norm"), F.round(F.max("n"), 6).alias("max_norm"), F.round(F.avg("n"), 6).alias("mean_norm"),
    )


VISUAL_SOURCES = ("clip", "visual")


def frame_retriever(index: DataFrame, queries: DataFrame, *, key: str, vector: str, query_key: str, query_vector: str, k: int, dims: int, sources: Sequence[str] = (), videos: Sequence[str] = (), groups: Sequence[str] = ()) -> DataFrame:
    """Frames as one retriever among several: query_id, document_id (`clip:video:frame`), source_type, video_id, keyframe_id, score, rank.

    The index (video_id, keyframe_id) is narrowed to videos and groups before the search; a filter on kinds of documents that
    names neither clip nor visual leaves nothing.
    """
    found = index
    if sources and not set(sources) & set(VISUAL_SOURCES):
        found = found.filter(F.lit(False))
    if videos:
        found = found.filter(F.col("video_id").isin(*videos))
    if groups:
        found = found.filter(F.split_part("video_id", F.lit("_"), F.lit(1)).isin(*groups))
    hits = cosine_topk(found, queries, key=key, vector=vector, query_key=query_key, query_vector=query_vector, k=k, dims=dims, carry=["video_id", "keyframe_id"])
    name = F.concat_ws(":", F.lit("clip"), "video_id", F.col("keyframe_id").cast("string"))
    return hits.select("query_id", name.alias("document_id"), F.lit("clip").alias("source_type"), "video_id", "keyframe_id", "score", "rank")
