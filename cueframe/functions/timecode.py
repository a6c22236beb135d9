"""Times of captions as text and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(ms: Column, unit: int, of: int | None = None) -> Column:
    whole = F.floor(ms / unit)
    return whole % of if of else whole


def srt(ms: Column, comma: str = ",") -> Column:
    return F.format_string(f"%02d:%02d:%02d{comma}%03d", _part(ms, 3_600_000), _part(ms, 60_000, 60), _part(ms, 1000, 60), ms % 1000)


def ass(ms: Column) -> Column:
    return F.format_string("%01d:%02d:%02d.%02d", _part(ms, 3_600_000), _part(ms, 60_000, 60), _part(ms, 1000, 60), _part(ms, 10, 100))


def lrc(ms: Column) -> Column:
    return F.format_string("%02d:%02d.%02d", _part(ms, 60_000), _part(ms, 1000, 60), _part(ms, 10, 100))


def parse(text: Column) -> Column:
    """Milliseconds of [hours:]minutes:seconds with 1 to 3 decimals after a point or comma; null for anything else."""
    pattern = r"^\s*(?:([0-9]+):)?([0-9]{1,2}):([0-9]{1,2})[,.]([0-9]{1,3})\s*$"
    at = lambda k: F.regexp_extract(text, pattern, k)
    hours = F.when(at(1) == "", 0).otherwise(at(1).try_cast("long"))
    ms = F.rpad(at(4), 3, "0").try_cast("long")
    return F.when(text.rlike(pattern), ((hours * 60 + at(2).try_cast("long")) * 60 + at(3).try_cast("long")) * 1000 + ms)
