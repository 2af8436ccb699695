"""Around the alignment of ordered events: pools, anchors, gates, windows, chain scores, linkage, compact chains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidsift.operators.ranking import by_score, following, rank_by

MODALITY_WEIGHTS = {"clip": 1.0, "object": 2.0, "attribute": 2.0, "ocr": 3.0, "asr": 3.0}
RERANK_WEIGHTS = {"semantic": 0.35, "temporal": 0.25, "linkage": 0.15, "context": 0.15, "multimodal": 0.05, "coverage": 0.05}
GATE_SHARE, LEAST_LINKAGE, CHAIN_POOL, CHAIN_SLACK = 0.85, 0.65, 6, 0.5


def weighted_mean(parts: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Over the parts that are not null, with their weights scaled anew; null if none is left."""
    top: Column = F.lit(0.0)
    low: Column = F.lit(0.0)
    for name, c in parts.items():
        w = F.when(c.isNotNull(), F.lit(float(weights[name]))).otherwise(F.lit(0.0))
        top, low = top + w * F.coalesce(c, F.lit(0.0)), low + w
    return F.when(low > 0, top / low)


def pool_size(words: Column, confidence: Column, rows: Column, margin: Column, structured: Column, least: int, default: int, most: int) -> Column:
    """How many candidates an event keeps: many where it's unclear, few where it's clear and structured."""
    unclear = (words <= 3) | (confidence < 0.7) | (rows < 2) | (margin < 0.05)
    return F.when(unclear, most).when((margin >= 0.2) & structured, least).otherwise(default)


def distinctiveness(margin: Column, concentration: Column, constraints: Column, words: Column) -> Column:
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return 0.35 * clip(margin) + 0.25 * clip(concentration) + 0.25 * clip(constraints / 4.0) + 0.15 * clip(words / 10.0)


def anchor(events: DataFrame) -> DataFrame:
    """The anchor event of each request: required, most distinct, best local score, first in order, then id."""
    return rank_by(events.filter("required"), ["request_id"], [by_score("distinctiveness"), by_score("local_score"), F.col("event_order"), F.col("event_id")], "n", 1).drop("n")


def video_coverage(candidates: DataFrame, required: Sequence[str], optional: Sequence[str] = (), anchor_event: str | None = None, top: int | None = None) -> DataFrame:
    """Videos by the events they cover: complete ones first, then more required, more optional, better anchor, better first scores, id."""
    best = candidates.groupBy("video_id", "event_id").agg(F.max("local_score").alias("s"))
    of = lambda names: F.col("event_id").isin(*names) if names else F.lit(False)
    v = best.groupBy("video_id").agg(
        F.count_if(of(required)).alias("required_found"), F.count_if(of(optional)).alias("optional_found"),
        F.coalesce(F.max(F.when(F.col("event_id") == anchor_event, F.col("s"))), F.lit(0.0)).alias("anchor_score"), F.sum("s").alias("score_sum"),
    )
    v = v.withColumn("complete", F.col("required_found") == len(required))
    order = [F.col("complete").desc(), F.col("required_found").desc(), F.col("optional_found").desc(), by_score("anchor_score"), by_score("score_sum"), F.col("video_id")]
    return rank_by(v, [], order, "rank", top)


def seed_gate(candidates: DataFrame, share: float = GATE_SHARE) -> DataFrame:
    """Candidates that reach a share of their event's best score."""
    best = candidates.groupBy("event_id").agg(F.max("local_score").alias("__best"))
    return candidates.join(best, "event_id").filter(F.col("local_score") >= F.col("__best") * share - 1e-12).drop("__best")


def windows(candidates: DataFrame, events: Sequence[str], anchor_event: str, pad: float = 2.0) -> DataFrame:
    """Per video and anchor candidate a time window: walk back, then forward from the anchor, at each event the best candidate in order.

    Back: best score, then latest; forward: best score, then earliest. An empty step rejects the anchor. Equal windows once.
    """
    at = events.index(anchor_event)
    state = candidates.filter(F.col("event_id") == anchor_event).select("video_id", F.col("candidate_id").alias("anchor_id"), F.col("t").alias("lo"), F.col("t").alias("hi"), F.col("local_score").alias("total"))
    for step, event in [*((-1, e) for e in reversed(events[:at])), *((1, e) for e in events[at + 1 :])]:
        own = candidates.filter(F.col("event_id") == event).select("video_id", F.col("candidate_id").alias("c"), F.col("t").alias("ct"), F.col("local_score").alias("cs"))
        ok = F.col("ct") < F.col("lo") if step < 0 else F.col("ct") > F.col("hi")
        order = [by_score("cs"), F.col("ct").desc() if step < 0 else F.col("ct").asc(), F.col("c")]
        state = rank_by(state.join(own, "video_id").filter(ok), ["video_id", "anchor_id"], order, "n", 1)
        state = state.select("video_id", "anchor_id", F.least("lo", "ct").alias("lo"), F.greatest("hi", "ct").alias("hi"), (F.col("total") + F.col("cs")).alias("total"))
    w = state.select("video_id", F.greatest(F.lit(0.0), F.col("lo") - pad).alias("start"), (F.col("hi") + pad).alias("end"), (F.col("total") / len(events)).alias("score"))
    return w.groupBy("video_id", "start", "end").agg(F.max("score").alias("score"))


def chain_score(required: Column, optional: Column, local: Column, provenance: Column, gaps: Column, skips: Column, repeats: Column) -> Column:
    return 2.0 * required + 0.5 * optional + local + 0.03 * provenance - 0.25 * gaps - 0.15 * skips - 1.0 * repeats


def event_score(ranks: Mapping[str, Column], usable: Mapping[str, Column], fallback: Column) -> Column:
    """Weighted mean of 1 / rank over the event's usable modalities (0 for one without a rank), clipped to 1; without any, the local score."""
    value = {m: F.when(usable[m], F.coalesce(1.0 / r, F.lit(0.0))) for m, r in ranks.items()}
    mean = weighted_mean(value, MODALITY_WEIGHTS)
    return F.round(F.coalesce(F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)), fallback), 6)


def linkage(steps: DataFrame, keys: Sequence[str], order: str, scale: float = 60.0) -> DataFrame:
    """Per chain the mean and least linkage of neighbouring steps (t, scene, tokens) by a whole-number order: time decay, same scene,
    token overlap (twice), each where known."""
    n = lambda c: F.col(f"next.{c}")
    both = F.size(F.array_union("tokens", n("tokens")))
    d = following(steps, keys, order, order, ["t", "scene", "tokens"]).filter(F.col("next").isNotNull() & n("t").isNotNull()).withColumns({
        "decay": F.exp(-F.greatest(n("t") - F.col("t"), F.lit(0.0)) / scale),
        "scene_same": F.when(F.col("scene").isNotNull() & n("scene").isNotNull(), (F.col("scene") == n("scene")).cast("double")),
        "overlap": F.when(both > 0, F.size(F.array_intersect("tokens", n("tokens"))) / both),
    })
    pair = weighted_mean({"decay": F.col("decay"), "scene": F.col("scene_same"), "overlap": F.col("overlap")}, {"decay": 1.0, "scene": 1.0, "overlap": 2.0})
    return d.withColumn("pair", pair).groupBy(*keys).agg(F.avg("pair").alias("linkage"), F.min("pair").alias("least"))


def rerank_chains(chains: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chains by the weighted mean of what is known about them; incomplete ones are dropped."""
    score = weighted_mean({c: F.col(c) for c in RERANK_WEIGHTS}, RERANK_WEIGHTS)
    return rank_by(chains.filter("complete").withColumn("final_score", score), list(keys), [by_score("final_score"), F.col("path")], "rank")


def compact_chains(hits: DataFrame, lanes: Sequence[str], k: int = 60, top: int = 16) -> DataFrame:
    """Per video the best chain of hits (lane, video_id, candidate_id, t, rank) through lanes in order, lanes may be left out.

    A hit extends a chain of an earlier lane that ends no later than CHAIN_SLACK after it; the best chain at a hit has most
    frames, then most reciprocal rank, then the shortest span, then the earliest end. Only chains of two frames or more count.
    """
    few = rank_by(hits.filter(F.col("t").isNotNull()), ["lane", "video_id"], [F.col("rank"), F.col("candidate_id")], "n", CHAIN_POOL).drop("n")
    key = [F.col("frames").desc(), by_score("score"), F.round(F.col("end") - F.col("start"), 9), F.col("end"), F.col("path")]
    done: DataFrame | None = None
    for lane in lanes:
        own = few.filter(F.col("lane") == lane).select("video_id", F.col("candidate_id").cast("string").alias("cid"), "t", (1.0 / (k + F.col("rank"))).alias("s"))
        new = own.select("video_id", "cid", F.lit(1).alias("frames"), F.col("s").alias("score"), F.col("t").alias("start"), F.col("t").alias("end"), F.col("cid").alias("path"))
        if done is not None:
            before = done.select("video_id", F.col("frames").alias("pf"), F.col("score").alias("ps"), F.col("start").alias("p0"), F.col("end").alias("p1"), F.col("path").alias("pp"))
            grown = own.join(before, "video_id").filter(F.col("p1") <= F.col("t") + CHAIN_SLACK)
            grown = grown.select("video_id", "cid", (F.col("pf") + 1).alias("frames"), (F.col("ps") + F.col("s")).alias("score"), F.least("p0", "t").alias("start"), F.greatest("p1", "t").alias("end"), F.concat_ws(">", "pp", "cid").alias("path"))
            new = rank_by(new.unionByName(grown), ["video_id", "cid"], key, "n", 1).drop("n")
        done = new if done is None else done.unionByName(new)
    best = rank_by(done.filter("frames >= 2"), ["video_id"], key, "n", 1).drop("n")
    span = F.col("end") - F.col("start")
    scored = best.withColumn("score", F.col("frames") / len(lanes) + F.col("score") + 0.05 / (1 + span / 60.0)).withColumn("span", span)
    return rank_by(scored, [], [F.col("frames").desc(), by_score("score"), F.round("span", 9), F.col("video_id")], "rank", top).select("video_id", "path", "frames", "score", "span", "rank")


def valid_paths(steps: DataFrame, keys: Sequence[str], order: str, required: Sequence[str], same_frame: bool = False) -> DataFrame:
    """Whether each chain stays in one video, moves forward in time and holds all required events."""
    w = Window.partitionBy(*keys).orderBy(order)
    gap = F.col("t") - F.lag("t").over(w)
    d = steps.withColumn("back", F.coalesce(gap < 0 if same_frame else gap <= 0, F.lit(False)))
    have = F.collect_set("event_id")
    need = F.array(*[F.lit(e) for e in required])
    return d.groupBy(*keys).agg((F.count_distinct("video_id") == 1).alias("one_video"), (~F.bool_or("back")).alias("forward"), (F.size(F.array_except(need, have)) == 0).alias("complete"))


def legacy_chains(candidates: DataFrame, events: Sequence[str], *, optional: Sequence[str] = (), beam: int = 100, top: int = 5, least_gap: float | None = None, most_gap: float | None = None, hard: bool = False, same_frame: bool = False, tolerance: float = 1.0) -> DataFrame:
    """Chains of a video by `chain_score` of what they hold so far: video_id, path, score, gap_violations, mapping_mismatch, rank.

    candidates: event_id, video_id, candidate_id, keyframe_id, t, local_score, provenance (a count), frame_seconds (the frame
    number in seconds, or null). After each event the best `beam` prefixes stay (ties: the path); `top` chains, five at most.
    A gap out of bounds ends a chain where it is `hard`, else it is counted. Optional events may be skipped; an event
    whose frame lies more than `tolerance` seconds from its time is marked.
    """
    top, beam = max(1, min(top, 5)), max(beam, top)
    zero, no = F.lit(0), F.lit(None)
    state = candidates.select("video_id").distinct().select("video_id", F.array().cast("array<string>").alias("path"), F.array().cast("array<string>").alias("frames"), no.cast("double").alias("last_t"), zero.alias("required"), zero.alias("extra"), F.lit(0.0).alias("local"), zero.alias("prov"), zero.alias("gaps"), zero.alias("skips"), F.lit(False).alias("off"))
    score = chain_score(F.col("required"), F.col("extra"), F.col("local"), F.col("prov"), F.col("gaps"), F.col("skips"), F.size("frames") - F.size(F.array_distinct("frames")))
    for step, event in enumerate(events):
        must = event not in optional
        own = candidates.filter(F.col("event_id") == event).select("video_id", F.col("candidate_id").cast("string").alias("c"), F.col("keyframe_id").cast("string").alias("f"), F.col("t").cast("double").alias("t"), F.col("local_score").alias("ls"), F.col("provenance").alias("p"), "frame_seconds")
        gap = F.col("t") - F.col("last_t")
        forward = F.coalesce((gap >= 0) if same_frame else (gap > 0), F.lit(True))
        bad = F.lit(False)
        if least_gap is not None:
            bad = bad | F.coalesce(gap < least_gap, F.lit(False))
        if most_gap is not None:
            bad = bad | F.coalesce(gap > most_gap, F.lit(False))
        ok = forward & ~bad if hard else forward
        grown = state.join(own, "video_id").filter(ok).select(
            "video_id", F.array_append("path", F.col("c")).alias("path"), F.array_append("frames", F.col("f")).alias("frames"), F.col("t").alias("last_t"), (F.col("required") + int(must)).alias("required"), (F.col("extra") + int(not must)).alias("extra"), (F.col("local") + F.col("ls")).alias("local"),
            (F.col("prov") + F.col("p")).alias("prov"), (F.col("gaps") + bad.cast("int")).alias("gaps"), "skips", (F.col("off") | F.coalesce(F.abs(F.col("frame_seconds") - F.col("t")) > tolerance, F.lit(False))).alias("off"),
        )
        if not must:
            grown = grown.unionByName(state.withColumn("path", F.array_append("path", F.lit("~skip"))).withColumn("skips", F.col("skips") + 1))
        state = rank_by(grown.withColumn("score", score), ["video_id"], [by_score("score"), F.col("path")], "rank", top if step == len(events) - 1 else beam)
        if step < len(events) - 1:
            state = state.drop("score", "rank")
    return state.select("video_id", F.array_join("path", ">").alias("path"), "score", F.col("gaps").alias("gap_violations"), F.col("off").alias("mapping_mismatch"), "rank")


def best_videos(chains: DataFrame, top: int = 20) -> DataFrame:
    """Videos by their best chain (video_id, path, score, rank): video_id, path, score, video_rank."""
    return rank_by(chains.filter("rank = 1").select("video_id", "path", "score"), [], [by_score("score"), F.col("video_id")], "video_rank", top)


def chosen_chain(coverage: DataFrame, status: DataFrame, chains: DataFrame) -> DataFrame:
    """One video and one chain of it: the first complete video by coverage (video_id, complete, rank) whose status is FEASIBLE."""
    one = coverage.filter("complete").join(status.filter("status = 'FEASIBLE'").select("video_id"), "video_id").orderBy("rank").limit(1).select("video_id")
    return chains.filter("rank = 1").join(F.broadcast(one), "video_id").select("video_id", "path", "score")  # one row
