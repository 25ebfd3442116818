"""CSV, JSON and event-log sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.sources.readers import CSV_OPTIONS


def submission_name(stamp: str, strategy: str | None = None, seed: int | None = None) -> str:
    """submission[_strategy][_seedN]_stamp"""
    parts = ["submission", strategy, None if seed is None else f"seed{seed}", stamp]
    return "_".join(p for p in parts if p is not None)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.options(header="true", quote=CSV_OPTIONS["quote"], escape=CSV_OPTIONS["escape"]).csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.json(path)
    return path


def trace_entries(df: DataFrame, kind: str, at, **parts) -> DataFrame:
    """Log entries of one kind: the timestamp as ISO text and the remaining parts as one JSON payload."""
    payload = F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]))
    return df.select(
        F.lit(kind).alias("type"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        payload.alias("payload"),
    )


def append_trace(entries: DataFrame, path: str) -> str:
    entries.write.mode("append").json(path)
    return path
