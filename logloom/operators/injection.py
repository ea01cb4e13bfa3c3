"""Signs of prompt injection in text that tools return, one finding of each kind a text at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases, patterns and code points that results must agree on.
IMPERATIVE = [
    "you must", "you should", "always do", "never do", "ignore previous", "ignore above", "ignore all", "instead you should", "override", "disregard",
    "do not follow", "forget your", "new instructions", "from now on", "act as", "pretend to be", "your new role", "system prompt",
]
SYSTEM_LIKE = [r"<system[^>]*>", r"<system-reminder[^>]*>", r"\[SYSTEM\]", r"\[INST\]", r"<\|im_start\|>system"]
ROLE_CONFUSION = [r"as (?:the|a) (?:system|assistant|user|admin)", r"speaking as (?:system|assistant|user)", r"role:\s*(?:system|assistant|user)"]
DIRECTIVE = [r'"instruction"\s*:', r"DIRECTIVE\s*:", r"(?:NOTE|IMPORTANT|WARNING)\s*:\s*(?:you must|you should|always|never|ignore|override|disregard)"]
ZERO_WIDTH = ["\\u200B", "\\u200C", "\\u200D", "\\uFEFF", "\\u200E", "\\u200F", "\\u2060", "\\u2061", "\\u2062", "\\u2063", "\\u2064"]
WEIGHTS = {"critical": 25, "high": 10, "medium": 5, "low": 1}

COMMENT = r"<!--\s*(.*?)\s*-->"
COMMENTS = 10


def _first(text: Column, patterns: list[str]) -> Column:
    """What the first pattern of the list that matches matches first; null if none does."""
    found = F.lit(None).cast("string")
    for p in reversed(patterns):
        found = F.when(F.regexp_like(text, F.lit(f"(?i){p}")), F.regexp_extract(text, f"(?i){p}", 0)).otherwise(found)
    return found


def _phrase(text: Column, phrases: list[str]) -> Column:
    found = F.lit(None).cast("string")
    for p in reversed(phrases):
        found = F.when(F.lower(text).contains(p), F.lit(p)).otherwise(found)
    return found


def findings(text: Column, phrases: list[str] | None = None) -> Column:
    """Array of (kind, severity, pattern)."""
    phrases = IMPERATIVE if phrases is None else phrases
    comments = F.slice(F.regexp_extract_all(text, F.lit(COMMENT), F.lit(0)), 1, COMMENTS)
    told = F.element_at(F.filter(comments, lambda c: _phrase(c, phrases).isNotNull()), 1)
    told = F.when(F.size(F.filter(comments, lambda c: _phrase(c, phrases).isNotNull())) > 0, told)
    zero = F.regexp_extract(text, "[" + "".join(ZERO_WIDTH) + "]", 0)
    kinds = [
        ("zero_width", "critical", F.when(zero != "", zero)),
        ("system_like", "high", _first(text, SYSTEM_LIKE)),
        ("imperative", "high", _phrase(text, phrases)),
        ("html_comment", "medium", told),
        ("embedded_directive", "medium", _first(text, DIRECTIVE)),
        ("role_confusion", "high", _first(text, ROLE_CONFUSION)),
    ]
    made = [F.when(p.isNotNull(), F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), p.alias("pattern"))) for k, s, p in kinds]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def injection_scan(rows: DataFrame, key: str, text: str, phrases: list[str] | None = None) -> DataFrame:
    """key, kind, severity, pattern."""
    return rows.select(key, F.explode(findings(F.coalesce(text, F.lit("")), phrases)).alias("f")).select(key, "f.*")


def injection_risk(found: DataFrame, key: str) -> DataFrame:
    """key, findings, risk (100 at most), highest severity."""
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("severity")]
    per = found.withColumn("w", weight).groupBy(key).agg(F.count("*").alias("findings"), F.least(F.sum("w"), F.lit(100)).alias("risk"), F.max_by("severity", "w").alias("highest"))
    return per
