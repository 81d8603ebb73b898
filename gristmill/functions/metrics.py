"""Sizes and what a conversion saves."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_count(content: Column) -> Column:
    """Bytes of a file or a text."""
    return F.octet_length(content).cast("long")


def savings_ratio(original: Column, converted: Column) -> Column:
    """The share of bytes saved, not rounded; null for an empty original."""
    return F.when(original != 0, F.lit(1.0) - converted.cast("double") / original.cast("double"))


def guarded_savings(original: Column, converted: Column) -> Column:
    """The same; null as well unless both sizes make sense."""
    return F.when((original > 0) & (converted >= 0), savings_ratio(original, converted))


def shown(value: float, digits: int) -> str:
    """A number with so many decimals, half away from zero on its exact value."""
    return str(Decimal(value).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def savings_line(name: str, original: int, converted: int) -> str:
    """A line for the log: sizes in KB and the share saved."""
    saved = f"{shown((1 - converted / original) * 100, 1)} %" if original > 0 and converted >= 0 else "n/a"
    return f"{name}: {shown(original / 1024, 2)} KB -> {shown(converted / 1024, 2)} KB, saved {saved}"
