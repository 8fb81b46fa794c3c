"""CVSS v3 vectors as 22 indicator columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from findrisk.functions.numbers import flag
from findrisk.functions.text import lower_strip, strip

# Metric code, column prefix, JSON-derived column, value codes and words.
METRICS = (
    ("AV", "attack_vector", "cvss_attack_vector", (("N", "network"), ("L", "local"), ("A", "adjacent"), ("P", "physical"))),
    ("AC", "attack_complexity", "cvss_attack_complexity", (("L", "low"), ("H", "high"))),
    ("PR", "privileges_required", "cvss_privileges_required", (("N", "none"), ("L", "low"), ("H", "high"))),
    ("UI", "user_interaction", "cvss_user_interaction", (("R", "required"), ("N", "none"))),
    ("S", "scope", "cvss_scope", (("C", "changed"), ("U", "unchanged"))),
    ("C", "confidentiality", "cvss_confidentiality", (("N", "none"), ("L", "low"), ("H", "high"))),
    ("I", "integrity", "cvss_integrity", (("N", "none"), ("L", "low"), ("H", "high"))),
    ("A", "availability", "cvss_availability", (("N", "none"), ("L", "low"), ("H", "high"))),
)

FLAG_NAMES = tuple(f"{prefix}_{word}" for _, prefix, _, values in METRICS for _, word in values)


def normal_vector(column: Column) -> Column:
    """Vector in upper case between slashes, blanks around separators removed.

    Every segment then reads ``/KEY:VALUE/``, so a flag is a substring test. A
    version prefix is just one more segment that matches nothing.
    """
    text = F.upper(strip(F.coalesce(column, F.lit(""))))
    tidy = F.when(text.rlike(r"\s"), F.regexp_replace(text, r"\s*([/:])\s*", "$1")).otherwise(text)
    return F.concat(F.lit("/"), tidy, F.lit("/"))


def vector_flags(normal: Column) -> dict[str, Column]:
    """Flags from a column prepared by :func:`normal_vector`."""
    return {
        f"{prefix}_{word}": normal.contains(f"/{key}:{code}/").cast("int")
        for key, prefix, _, values in METRICS
        for code, word in values
    }


def metric_flags(available: set[str]) -> dict[str, Column]:
    """The same flags from the eight metric word columns of JSON input."""
    return {
        f"{prefix}_{word}": flag(lower_strip(F.col(source)) == word) if source in available else F.lit(0)
        for _, prefix, source, values in METRICS
        for _, word in values
    }
