"""Expressions that read run logs and grader output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright import fixed
from tablewright.functions.strings import contains_any, first_rule


def first_match(col: Column, patterns, number: bool) -> Column:
    """Group 1 of the first pattern whose match can be used; matching ignores case."""
    found = []
    for p in patterns:
        hit = F.nullif(F.regexp_extract(col, "(?i)" + p, 1), F.lit(""))
        found.append(hit.try_cast("double") if number else hit)
    return F.coalesce(*found)


def log_metrics(col: Column) -> dict[str, Column]:
    out = {k: first_match(col, p, k != "best_model") for k, p in fixed.LOG_PATTERNS.items()}
    out["completed"] = contains_any(col, fixed.COMPLETION_KEYWORDS)
    return out


def error_class(col: Column) -> Column:
    return first_rule(col, [(words, label) for label, words in fixed.ERROR_KEYWORDS], "unknown")


def error_action(label: Column, col: Column) -> Column:
    """struct(action, priority) of the first rule for this class whose keywords occur."""
    out = None
    for cls, words, action, priority in fixed.ERROR_ACTIONS:
        hit = (label == cls) if not words else (label == cls) & contains_any(col, words)
        val = F.struct(F.lit(action).alias("action"), F.lit(priority).alias("priority"))
        out = F.when(hit, val) if out is None else out.when(hit, val)
    return out


def critical_error(exit_code: Column, stderr: Column) -> Column:
    return (exit_code != 0) | contains_any(stderr, fixed.CRITICAL_KEYWORDS)


def stack_trace(col: Column) -> Column:
    """From the line that holds the first 'Traceback' to the end; null without one."""
    return F.nullif(F.regexp_extract(col, r"(?s)([^\n]*Traceback.*)", 1), F.lit(""))


def tail(col: Column, n: int) -> Column:
    return F.right(col, F.lit(n))


def fenced_block(col: Column, language: str) -> Column:
    """Text inside the first fence of this language, else inside the first plain fence; null without one."""
    named = F.regexp_extract(col, rf"(?s)```{language}(.*?)```", 1)
    plain = F.regexp_extract(col, r"(?s)```(.*?)```", 1)
    block = F.when(col.contains(f"```{language}"), named).otherwise(plain)
    return F.nullif(F.trim(F.regexp_replace(block, r"^\s+|\s+$", "")), F.lit(""))


def grader_result(col: Column) -> Column:
    """struct(score, medal): from the first flat JSON object that parses, else from keywords and score patterns."""
    obj = F.regexp_extract(col, r"\{[^{}]+\}", 0)
    parsed = F.from_json(obj, "score double, medal string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    valid = (obj != "") & parsed.isNotNull() & parsed["_bad"].isNull()
    low = F.lower(col)
    medal = (
        F.when(low.contains("gold"), "gold").when(low.contains("silver"), "silver")
        .when(low.contains("bronze"), "bronze").otherwise("none")
    )
    score = F.coalesce(first_match(low, fixed.GRADER_SCORE_PATTERNS, True), F.lit(0.0))
    return F.struct(
        F.when(valid, F.coalesce(parsed["score"], F.lit(0.0))).otherwise(score).alias("score"),
        F.when(valid, F.lower(F.coalesce(parsed["medal"], F.lit("none")))).otherwise(medal).alias("medal"),
    )
