"""Semantic-version numbers of package versions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from findrisk.functions.text import strip, text_or_blank


def version_parts(column: Column) -> Column:
    """Dot-separated parts without leading "v" and without any pre-release suffix."""
    plain = F.ltrim(strip(text_or_blank(column)), F.lit("vV"))
    return F.split(F.substring_index(F.translate(plain, "-+_", "   "), " ", 1), r"\.")


def version_number(parts: Column, position: int) -> Column:
    """One part as a number; missing or non-numeric parts are 0."""
    return F.coalesce(F.get(parts, F.lit(position)).try_cast("bigint"), F.lit(0).cast("bigint"))
