"""Colours of decoded images as a pixel table (keys, y, x, height, width, red, green, blue: 0 to 255)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidsift.operators.ranking import by_score, rank_by

LEAST_RATIO = 0.04
#: The part of an image where clothing is looked for (top, bottom, left, right).
CLOTHING_CROP = (0.20, 0.88, 0.18, 0.82)


def is_color(color: str, r: Column, g: Column, b: Column) -> Column:
    """Whether a pixel counts as the colour."""
    # Thresholds of each colour.
    rules = {
        "red": (r > 95) & (r > g * 1.35) & (r > b * 1.35),
        "blue": (b > 85) & (b > r * 1.25) & (b > g * 1.15),
        "green": (g > 80) & (g > r * 1.15) & (g > b * 1.15),
        "yellow": (r > 120) & (g > 105) & (b < 110) & (F.abs(r - g) < 80),
        "white": (r > 190) & (g > 190) & (b > 190),
        "black": (r + g + b) < 135,
        "orange": (r > 130) & (g > 55) & (g < 170) & (b < 100) & (r > g * 1.15),
        "pink": (r > 150) & (b > 95) & (g < 150) & (r > g * 1.2),
        "purple": (r > 80) & (b > 100) & (g < 120),
        "brown": (r > 70) & (g > 35) & (b < 95) & (r > b * 1.3) & (g > b * 1.1),
    }
    return rules.get(color, F.lit(False))


def color_search(pixels: DataFrame, keys: Sequence[str], color: str, target: str = "any", least: float = LEAST_RATIO) -> DataFrame:
    """Images whose share of the colour reaches `least`: keys, color_ratio, attribute_score, rank. Shares are counted map-side."""
    p = pixels
    if target == "clothing":
        top, bottom, left, right = CLOTHING_CROP
        inside = lambda c, size, a, z: (F.col(c) >= F.floor(F.col(size) * a)) & (F.col(c) < F.floor(F.col(size) * z))
        p = p.filter(inside("y", "height", top, bottom) & inside("x", "width", left, right))
    ratio = p.groupBy(*keys).agg(F.avg(is_color(color, F.col("red"), F.col("green"), F.col("blue")).cast("double")).alias("color_ratio"))
    hit = ratio.filter(F.col("color_ratio") >= least).withColumn("attribute_score", F.least(F.lit(1.0), F.col("color_ratio") / max(least, 0.001)))
    return rank_by(hit, [], [by_score("attribute_score"), by_score("color_ratio"), *[F.col(k) for k in keys]], "rank")


def signatures(pixels: DataFrame, keys: Sequence[str], bins: int = 8) -> DataFrame:
    """keys, signature: density histograms of the three channels, joined and scaled to length one."""
    width = 255.0 / bins
    cell = lambda c: F.least(F.floor(F.col(c) / width), F.lit(bins - 1))
    counts = [F.count_if(cell(c) == i) / F.count(F.lit(1)) / width for c in ("red", "green", "blue") for i in range(bins)]
    h = pixels.groupBy(*keys).agg(F.array(*counts).alias("h"))
    n = F.sqrt(F.aggregate("h", F.lit(0.0), lambda s, x: s + x * x))
    return h.select(*keys, F.when(n > 0, F.transform("h", lambda x: x / n)).alias("signature"))
