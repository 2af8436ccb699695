"""Object predicates over detections: suppression, position, count, tri-state status, proximity, label rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidsift.functions.vectors import horizontal_region, kept_boxes, vertical_region
from vidsift.operators.ranking import by_score, rank_by
from vidsift.session import cut

FRAME = ["video_id", "keyframe_id"]
#: Boxes of a frame that decide about its first ones, as a rule.
PREFIX_BOXES = 2_000


def valid_confidence(c: str = "confidence"):
    return F.col(c).isNotNull() & ~F.isnan(c) & F.col(c).between(0.0, 1.0)


def _folded(d: DataFrame, threshold: float) -> DataFrame:
    """Greedy suppression by a fold over each frame's ordered boxes of a label."""
    box = F.struct((-F.col("confidence")).alias("neg"), "y1", "x1", "y2", "x2")
    per = d.groupBy(*FRAME, "label_normalized").agg(kept_boxes(F.array_sort(F.collect_list(box)), threshold).alias("kept"))
    return per.select(*FRAME, "label_normalized", F.explode("kept").alias("b")).select(*FRAME, "label_normalized", "b.y1", "b.x1", "b.y2", "b.x2", (-F.col("b.neg")).alias("confidence"))


def suppressed(detections: DataFrame, min_confidence: float, threshold: float = 0.5, keep: int | None = None, prefix: int = PREFIX_BOXES) -> DataFrame:
    """Boxes kept by greedy suppression per frame and label, in order of confidence, then label, then box: frame, label, box, confidence.

    A fold over each frame's ordered boxes of a label; rows that agree in all but their id count once, so redelivered rows
    don't lengthen it. With `keep`, the first boxes of a frame: whether a box is kept depends only on those before it, so a
    frame's `prefix` best boxes decide, taken before the exchange, unless fewer than `keep` of them are kept; such
    frames are folded whole. So a frame that holds a large share of all rows is rarely seen whole by one task.
    """
    d = detections.filter(valid_confidence() & (F.col("confidence") >= min_confidence) & F.col("label_normalized").isNotNull())
    d = d.select(*FRAME, "label_normalized", *[F.col(f"bbox_{c}").alias(c) for c in ("y1", "x1", "y2", "x2")], "confidence")
    if not keep:
        return _folded(d.distinct(), threshold)
    order = [F.col("confidence").desc(), *[F.col(c) for c in ("label_normalized", "y1", "x1", "y2", "x2")]]
    first = rank_by(d.distinct(), FRAME, order, "__n", prefix + 1)
    long = first.filter(F.col("__n") > prefix).select(*FRAME)
    begun = cut(rank_by(_folded(first.filter(F.col("__n") <= prefix), threshold), FRAME, order, "box_rank", keep).join(long.withColumn("long", F.lit(True)), FRAME, "left"))
    short = begun.filter("long").groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < keep).select(*FRAME)
    if short.isEmpty():
        return begun.drop("long")
    whole = rank_by(_folded(d.join(short, FRAME, "left_semi").distinct(), threshold), FRAME, order, "box_rank", keep)
    return begun.join(short, FRAME, "left_anti").drop("long").unionByName(whole)


def label_counts(frames: DataFrame, boxes: DataFrame, labels: Sequence[str], horizontal: str = "any", vertical: str = "any") -> DataFrame:
    """Per available frame the number and the highest confidence of boxes with one of the labels in the region; frames without any have 0."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    hit = boxes.filter(F.col("label_normalized").isin(*labels))
    if horizontal != "any":
        hit = hit.filter(horizontal_region(cx) == horizontal)
    if vertical != "any":
        hit = hit.filter(vertical_region(cy) == vertical)
    counted = hit.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("best"))
    ready = frames.filter(F.col("object_status") == "AVAILABLE").select(*FRAME).distinct()
    return ready.join(counted, FRAME, "left").select(*FRAME, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("best", F.lit(0.0)).alias("score"))


def object_search(frames: DataFrame, boxes: DataFrame, labels: Sequence[str], operator: str = ">=", count: int = 1, horizontal: str = "any", vertical: str = "any", top: int | None = None) -> DataFrame:
    """Frames whose count satisfies the predicate, ranked by confidence. A tested frame without a hit can match `<=`."""
    n = F.col("n")
    ok = {"=": n == count, ">=": n >= count, "<=": n <= count}[operator]
    return rank_by(label_counts(frames, boxes, labels, horizontal, vertical).filter(ok), [], [by_score("score"), F.col("video_id"), F.col("keyframe_id")], "rank", top)


def tri_state(frames: DataFrame) -> DataFrame:
    """Per video: AVAILABLE if all frames have object data, UNKNOWN if none has, else PARTIAL_UNKNOWN. Unknown is never a negative."""
    once = frames.select("video_id", "keyframe_id", "object_status").distinct()
    a, n = F.count_if(F.col("object_status") == "AVAILABLE"), F.count(F.lit(1))
    return once.groupBy("video_id").agg(n.alias("frames"), a.alias("available"), F.when(a == n, "AVAILABLE").when(a == 0, "UNKNOWN").otherwise("PARTIAL_UNKNOWN").alias("status"))


def proximity(detections: DataFrame, first: Sequence[str], second: Sequence[str], min_confidence: float, reach: float = 0.35) -> DataFrame:
    """Per frame the best pair of a box of the first and one of the second kind: score = (1 - distance / reach) * sqrt(c1 * c2).

    Each frame's boxes are binned by centre on a grid of `reach`, so pairs form only between neighbouring cells;
    of boxes of one kind with the same centre only the most confident can be in the best pair.
    """
    d = detections.filter(valid_confidence() & (F.col("confidence") >= min_confidence))
    side = lambda names: d.filter(F.col("label_normalized").isin(*names)).groupBy(*FRAME, F.col("center_x").alias("x"), F.col("center_y").alias("y")).agg(F.max("confidence").alias("c"))
    cell = lambda c: F.floor(F.col(c) / reach).cast("int")
    a = side(first).withColumnsRenamed({"x": "ax", "y": "ay", "c": "ac"}).withColumns({"gx": cell("ax"), "gy": cell("ay")})
    near = lambda g: F.explode(F.sequence(F.col(g) - 1, F.col(g) + 1))
    b = side(second).withColumnsRenamed({"x": "bx", "y": "by", "c": "bc"}).withColumns({"gx": cell("bx"), "gy": cell("by")}).withColumn("gx", near("gx")).withColumn("gy", near("gy"))
    pairs = a.join(b, [*FRAME, "gx", "gy"])
    dist = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    near_pairs = pairs.withColumn("distance", dist).filter(F.col("distance") <= reach).withColumn("score", F.round(F.greatest(F.lit(0.0), 1 - F.col("distance") / reach) * F.sqrt(F.col("ac") * F.col("bc")), 9))
    best = near_pairs.groupBy(*FRAME).agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("pairs"))
    return rank_by(best, [], [by_score("score"), *[F.col(c) for c in FRAME]], "rank")


def rule_scores(detections: DataFrame, weights: Mapping[str, float], most: float = 1.0) -> DataFrame:
    """Per frame the weighted sum of the confidences of the rule's entities, capped at `most`, with the entities that matched."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    d = detections.filter(valid_confidence() & F.col("label_raw").isin(*weights))
    part = F.col("confidence") * table[F.col("label_raw")]
    return d.groupBy(*FRAME).agg(F.least(F.sum(part), F.lit(most)).alias("object_score"), F.array_join(F.array_sort(F.collect_set("label_raw")), ",").alias("entities"))


def top_labels(detections: DataFrame, min_confidence: float, keep: int = 20) -> DataFrame:
    """Per frame the labels with their highest confidence, the first `keep` joined in order: the frame's object text."""
    d = detections.filter(valid_confidence() & (F.col("confidence") >= min_confidence) & F.col("label_normalized").isNotNull())
    best = d.groupBy(*FRAME, "label_normalized").agg(F.max("confidence").alias("c"))
    ranked = rank_by(best, FRAME, [F.col("c").desc(), F.col("label_normalized")], "n", keep)
    return ranked.groupBy(*FRAME).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "label_normalized"))), lambda x: x["label_normalized"]), " ").alias("text"), F.max("c").alias("confidence"))


def threshold_counts(detections: DataFrame, thresholds: Sequence[float] = (0.1, 0.2, 0.3, 0.5)) -> DataFrame:
    d = detections.filter(valid_confidence())
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("confidence") >= t).alias(f"at_{int(t * 100):02d}") for t in thresholds])
