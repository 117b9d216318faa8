"""File names, video names and output formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackweave.functions.geometry import col


def frame_no_from_file(frame_file) -> Column:
    """Number in `frame_000123.jpg` (or .png); null when the rest is not a number."""
    bare = F.regexp_replace(col(frame_file), r"frame_|\.jpg|\.png", "")
    return F.when(bare.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(bare)).cast("long")


def short_name(video) -> Column:
    """Part after the first double underscore, at most 45 characters; else the first 40 of the name."""
    v = col(video)
    at = F.instr(v, "__")
    return F.when(at > 0, F.substr(v, at + 2, F.lit(45))).otherwise(F.substr(v, F.lit(1), F.lit(40)))


def field(video, index: int, fallback: int = 30) -> Column:
    """Underscore-separated field of a name, or its first characters when there are too few."""
    parts = F.split(col(video), "_")
    return F.when(F.size(parts) > index, F.get(parts, F.lit(index))).otherwise(F.substr(col(video), F.lit(1), F.lit(fallback)))


def score_from_name(stem) -> Column:
    """Third underscore field as a number; null when absent or not a number."""
    return F.get(F.split(col(stem), "_"), F.lit(2)).try_cast("double")


def one_decimal(value) -> Column:
    return F.format_string("%.1f", col(value))
