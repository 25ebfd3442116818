"""String, path and character expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright import fixed


def any_keyword(words) -> str:
    """A regular expression that finds any of the words as a substring."""
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


def contains_any(col: Column, words) -> Column:
    return F.lower(col).rlike(any_keyword(words))


def char_position(col: Column, i: int, upper: bool = True) -> Column:
    """Ordinal of the i-th character (0-based) counted from 'A'; -1 where there is no letter."""
    ch = F.substring(F.upper(col) if upper else col, i + 1, 1)
    return F.when(ch.rlike(r"^\p{L}$"), F.ascii(ch) - 65).otherwise(-1)


def unique_chars(col: Column) -> Column:
    """Number of distinct characters; 0 for null and ''."""
    return F.when(F.coalesce(F.length(col), F.lit(0)) == 0, 0).otherwise(F.size(F.array_distinct(F.split(col, ""))))


def fill_text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def clean_text(col: Column) -> Column:
    """Lower case, everything but letters, digits and blanks removed, runs of blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def words(col: Column) -> Column:
    return F.filter(F.split(clean_text(col), " "), lambda w: w != "")


def normalize_path(col: Column) -> Column:
    return F.replace(col, F.lit("\\"), F.lit("/"))


def stem(col: Column) -> Column:
    """The path without its last extension (whole path when there is none)."""
    return F.when(col.contains("."), F.regexp_extract(col, r"^(.*)\.[^.]*$", 1)).otherwise(col)


def extension(col: Column) -> Column:
    return F.when(col.contains("."), F.regexp_extract(col, r"\.([^.]*)$", 1)).otherwise("")


def path_like(col: Column, extensions) -> Column:
    return contains_any(col, extensions)


def first_rule(col: Column, rules, default) -> Column:
    """The label of the first (keywords, label) rule that matches the lower-cased text."""
    out = None
    for keywords, label in rules:
        hit = contains_any(col, keywords)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def described_metric(col: Column) -> Column:
    return first_rule(col, fixed.DESCRIPTION_METRICS, F.lit(None).cast("string"))


def described_task(col: Column) -> Column:
    return first_rule(col, fixed.DESCRIPTION_TASKS, F.lit(None).cast("string"))
