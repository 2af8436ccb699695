"""Metadata constraints with evidence: every constraint that is asked for must hold, and says how it was met."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidsift.operators.ranking import rank_by

EXACT, NORMALIZED = "exact_original_phrase", "normalized_accent_insensitive_phrase"


@dataclass(frozen=True)
class Constraints:
    groups: Sequence[str] = ()
    video_ids: Sequence[str] = ()
    author: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    number_min: float | None = None
    number_max: float | None = None
    title: str | None = None
    keywords: Sequence[str] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise ValueError("date_from must not be after date_to")
        if self.number_min is not None and self.number_max is not None and self.number_min > self.number_max:
            raise ValueError("number_min must not exceed number_max")


def match_kind(phrase: str, folded_phrase: str, text: Column, folded: Column) -> Column:
    """How a phrase occurs: as written (without case), without accents, or not at all (null)."""
    return F.when(F.contains(F.lower(text), F.lit(phrase.lower())), F.lit(EXACT)).when(F.contains(folded, F.lit(folded_phrase)), F.lit(NORMALIZED))


def constrained(docs: DataFrame, want: Constraints, fold, columns: dict[str, str]) -> DataFrame:
    """Rows that meet all constraints with evidence (joined `field=kind`), ranked by exact matches, then fewest normalized ones, then key.

    columns names key, group, author, author_folded, title, title_folded, date, number; fold gives a phrase's folded form.
    """
    c = {k: F.col(v) for k, v in columns.items()}
    checks: list[tuple[str, Column]] = []
    if want.groups:
        checks.append(("group", F.when(c["group"].isin(*want.groups), "exact")))
    if want.video_ids:
        checks.append(("video_id", F.when(c["key"].isin(*want.video_ids), "exact")))
    if want.author:
        checks.append(("author", match_kind(want.author, fold(want.author), c["author"], c["author_folded"])))
    if want.date_from or want.date_to:
        ok = (c["date"] >= F.lit(want.date_from or "0001-01-01").cast("date")) & (c["date"] <= F.lit(want.date_to or "9999-12-31").cast("date"))
        checks.append(("publish_date", F.when(ok, "range")))
    if want.number_min is not None or want.number_max is not None:
        ok = (c["number"] >= (want.number_min if want.number_min is not None else float("-inf"))) & (c["number"] <= (want.number_max if want.number_max is not None else float("inf")))
        checks.append(("number", F.when(ok, "range")))
    if want.title:
        checks.append(("title", match_kind(want.title, fold(want.title), c["title"], c["title_folded"])))
    for word in want.keywords:
        checks.append(("keywords", match_kind(word, fold(word), c["title"], c["title_folded"])))
    out = docs
    for _, kind in checks:
        out = out.filter(kind.isNotNull())
    kinds = F.array(*[kind for _, kind in checks])
    count = lambda names: F.size(F.filter(kinds, lambda k: k.isin(*names))).cast("long")
    out = out.withColumns({
        "evidence": F.concat_ws(";", *[F.concat(F.lit(f"{name}="), kind) for name, kind in checks]) if checks else F.lit(""),
        "exact_count": count(["exact", EXACT]) if checks else F.lit(0).cast("long"),
        "normalized_count": count([NORMALIZED]) if checks else F.lit(0).cast("long"),
    })
    return rank_by(out, [], [F.col("exact_count").desc(), F.col("normalized_count"), c["key"]], "rank")
