"""Checks over text columns: injected instructions, active SVG content, block-list lines, file names, Markdown and spreadsheet escapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Instruction-like text aimed at automated readers, case-insensitive.
INJECTION_PATTERNS = [
    r"ignore\s+(all\s+|any\s+|the\s+)?(previous|prior|above|earlier)\s+(instructions|rules|prompts?)",
    r"disregard\s+.{0,40}(instructions|rules|guidelines)",
    r"(classify|mark|label|report|treat)\s+(this|the)\s+(image|photo|picture|file|audio|recording|clip|video)\s+as\s+(authentic|real|genuine|safe|human)",
    r"you\s+are\s+now\s+(a|an|in)\b",
    r"system\s+prompt",
    r"do\s+not\s+(flag|report|detect)\s+this",
]

# Active content in SVG documents, case-insensitive.
SVG_PATTERNS = {
    "script": r"<\s*script",
    "event_handler": r"[\s\"'/]on[a-z]{3,}\s*=",
    "entity": r"<!ENTITY",
    "javascript_uri": r"javascript\s*:",
    "foreign_object": r"<\s*foreignObject",
}

# Leading characters that a spreadsheet runs as a formula.
FORMULA_STARTS = ["=", "+", "-", "@", "\t", "\r"]


def injection_matches(fields: DataFrame) -> DataFrame:
    """(media_id, field, pattern, snippet): one row per text field and matching pattern, with 20 characters either side, at most 160.

    The patterns are part of the projection, so a field is read once and only matches leave the map side.
    """
    hits = []
    for n, pattern in enumerate(INJECTION_PATTERNS):
        rx = F.lit("(?iU)" + pattern)
        start = F.regexp_instr("text", rx)
        length = F.length(F.regexp_substr("text", rx))
        begin = F.greatest(F.lit(1), start - 20)
        cut = F.substr(F.col("text"), begin, F.least(F.lit(160), start + length + 20 - begin))
        hits.append(F.when(start > 0, F.struct(F.lit(n).alias("pattern"), cut.alias("snippet"))))
    # One pass decides whether a field matches at all. explode_outer keeps Spark from evaluating the whole array once more as a filter.
    any_hit = F.col("text").rlike("(?iU)" + "|".join(f"(?:{p})" for p in INJECTION_PATTERNS))
    rows = fields.where(any_hit).select("media_id", "field", F.explode_outer(F.array(*hits)).alias("m"))
    return rows.where("m IS NOT NULL").select("media_id", "field", "m.pattern", "m.snippet")


def injection_findings(fields: DataFrame) -> DataFrame:
    """One WARN (HIGH) or PASS row per media with the number of fields scanned and of matches."""
    found = F.lit(0)
    for pattern in INJECTION_PATTERNS:
        found = found + F.col("text").rlike("(?iU)" + pattern).cast("int")
    agg = fields.groupBy("media_id").agg(F.count(F.lit(1)).alias("fields"), F.sum(found).alias("matches"))
    hit = F.col("matches") > 0
    return agg.select("media_id", "fields", "matches", F.when(hit, "WARN").otherwise("PASS").alias("status"), F.when(hit, "HIGH").otherwise("NONE").alias("severity"))


def svg_active_content(text: Column, is_svg: Column) -> Column:
    """struct(status, indicators): FAIL on any pattern, PASS on none, NOT_APPLICABLE when it is no SVG document."""
    hits = F.array_compact(F.array(*[F.when(text.rlike("(?i)" + rx), F.lit(name)) for name, rx in SVG_PATTERNS.items()]))
    kept = F.when(is_svg, hits).otherwise(F.array().cast("array<string>"))
    status = F.when(~is_svg, "NOT_APPLICABLE").when(F.size(hits) > 0, "FAIL").otherwise("PASS")
    return F.struct(status.alias("status"), kept.alias("indicators"))


def blocklist_entry(line: Column) -> Column:
    """The first 64-digit hex token of a block-list line, lower-cased; NULL for blank lines, comments and lines without one."""
    text = F.trim(F.regexp_replace(line, r"[\s﻿]+", " "))
    tokens = F.transform(F.split(F.lower(text), r"[\s,;]+"), lambda t: F.regexp_replace(t, r"^(?:sha256:)?(?:sha-256:)?", ""))
    valid = F.filter(tokens, lambda t: t.rlike(r"^[0-9a-f]{64}$"))
    return F.when((text != "") & ~text.startswith("#"), F.get(valid, F.lit(0)))


def sanitise_filename(name: Column, limit: int = 90) -> Column:
    """An injection-safe base name; a long one is shortened in the middle so that the extension stays."""
    base = F.element_at(F.split(F.regexp_replace(name, r"[/\\]+$", ""), r"[/\\]"), -1)
    clean = F.regexp_replace(F.regexp_replace(base, r"[^a-zA-Z0-9_\-.]", "_"), r"^[._]+|[._]+$", "")
    safe = F.when(F.coalesce(name, F.lit("")) == "", "unnamed_file").when(clean == "", "sanitized_media").otherwise(clean)
    suffix = F.substring(F.regexp_extract(safe, r"[^.](\.[^.]+)$", 1), 1, 12)
    short = F.concat(F.substr(safe, F.lit(1), F.lit(limit) - F.length(suffix)), suffix)
    return F.when(F.length(safe) > limit, short).otherwise(safe)


def escape_markdown(text: Column) -> Column:
    """Text with control characters dropped and every Markdown, HTML and LaTeX special backslash-escaped."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b-\x1f\x7f]", "")
    return F.regexp_replace(plain, r"([\\`*_{}\[\]()#+!|<>~$:&-])", r"\\$1")


def formula_safe(df: DataFrame) -> DataFrame:
    """Every string cell that a spreadsheet would run gets a leading apostrophe."""
    def cell(c: str) -> Column:
        return F.when(F.substring(c, 1, 1).isin(FORMULA_STARTS), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c)

    return df.select(*[cell(c) if t == "string" else F.col(c) for c, t in df.dtypes])
