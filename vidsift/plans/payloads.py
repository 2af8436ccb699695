"""JSON that comes from elsewhere: fences stripped, allowlisted, nested texts found. Arrow UDFs; a value that doesn't parse is null."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidsift.plans.planner import routes

ROUTES = ("clip", "bge", "bm25")
PLAN_FIELDS = ("clip_query", "clip_queries", "semantic_query", "lexical_query", "intent", "routes", "reasons", "structured_filters")
MOST_QUERIES, MOST_REASONS = 6, 3


_PLAN = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if n in ("clip_queries", "routes", "reasons") else T.StringType()) for n in ("clip_query", "clip_queries", "semantic_query", "lexical_query", "intent", "routes", "reasons", "error")])


def _texts(value: Any) -> list[str]:
    if isinstance(value, str):
        return [value]
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [t for v in inner for t in _texts(v)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def nested_texts(s: pd.Series) -> pd.Series:
    """All strings within a JSON value, in order, at any depth; keys aren't texts."""
    def one(x: str) -> list[str] | None:
        try:
            return _texts(json.loads(x))
        except ValueError:
            return None

    return s.map(one, na_action="ignore")


def unfenced(c: Column) -> Column:
    """A JSON text without the code fence around it."""
    return F.regexp_replace(F.trim(c), r"(?i)^```(?:json)?\s*|\s*```$", "")


def _distinct(values: list[str], most: int) -> list[str]:
    """Texts with single blanks, each once whatever its case, `most` at most."""
    out: dict[str, str] = {}
    for v in (" ".join(x.split()) for x in values):
        if v:
            out.setdefault(v.casefold(), v)
    return list(out.values())[:most]


@F.pandas_udf(_PLAN)
def _external_plan(s: pd.Series) -> pd.DataFrame:
    def one(text: str | None) -> dict[str, Any]:
        try:
            raw = json.loads(text or "")
        except ValueError:
            return {"error": "NOT_JSON"}
        if not isinstance(raw, dict):
            return {"error": "NOT_AN_OBJECT"}
        raw = {k: v for k, v in raw.items() if k in PLAN_FIELDS}
        asked = raw.get("routes")
        if not isinstance(asked, list) or not asked or any(r not in ROUTES for r in asked) or len(set(asked)) < len(asked):
            return {"error": "INVALID_ROUTES"}
        more = raw.get("clip_queries") or []
        if not isinstance(more, list) or len(more) > MOST_QUERIES or any(not isinstance(x, str) for x in more):
            return {"error": "INVALID_QUERIES"}
        primary = str(raw.get("clip_query") or "").strip()
        reasons = raw.get("reasons")
        named = [str(r).strip() for r in reasons if str(r).strip()] if isinstance(reasons, list) else []
        return {
            "clip_query": primary, "clip_queries": _distinct([primary, *more], MOST_QUERIES), "semantic_query": str(raw.get("semantic_query") or "").strip() or None,
            "lexical_query": str(raw.get("lexical_query") or "").strip() or None, "intent": str(raw.get("intent") or "mixed"), "routes": [r for r in ROUTES if r in asked], "reasons": named[:MOST_REASONS],
        }

    return pd.DataFrame([{**dict.fromkeys(_PLAN.names), **one(x)} for x in s], columns=_PLAN.names)


def guarded_plan(answer: Column, query: Column) -> Column:
    """A plan that a model wrote for a query, within local rules: its texts and reasons count, its routes are replaced by those the
    rules give; a plan that doesn't parse or names anything unknown falls back to the query itself (error says why).
    Struct: clip_queries, semantic_query, lexical_query, routes, intent, reasons, error."""
    plan, own = _external_plan(unfenced(answer)), routes(query)
    lone = F.create_map(F.lit("clip"), F.lit("visual"), F.lit("bge"), F.lit("semantic_text"), F.lit("bm25"), F.lit("lexical_text"))
    asked = F.when(F.size(plan["clip_queries"]) > 0, plan["clip_queries"]).otherwise(F.array(query))
    reasons = F.slice(F.array_distinct(F.concat(F.coalesce(plan["reasons"], F.array().cast("array<string>")), F.array(F.lit("routes follow local rules")))), 1, MOST_REASONS)
    return F.struct(
        asked.alias("clip_queries"), F.coalesce(plan["semantic_query"], query).alias("semantic_query"), F.coalesce(plan["lexical_query"], query).alias("lexical_query"), own.alias("routes"),
        F.when(F.size(own) > 1, "mixed").otherwise(lone[F.get(own, F.lit(0))]).alias("intent"), reasons.alias("reasons"), plan["error"].alias("error"),
    )
