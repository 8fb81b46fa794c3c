"""The seven feature blocks as column expressions over canonical findings.

Row-local blocks (severity and CVSS, weaknesses, dependency, time, text) are
plain projections. Grouped blocks come from one fused aggregate per key, see
``profiles``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from findrisk.functions import cvss, cwe
from findrisk.functions.dates import elapsed_days, moment
from findrisk.functions.numbers import clip, flag, number, whole
from findrisk.functions.text import list_head, list_size, lower_strip, mentions, strip, text_or_blank
from findrisk.functions.versions import version_number, version_parts
from findrisk.operators.canonical import field, severity_rank

# Ecosystems with an indicator column.
ECOSYSTEMS = ("npm", "pypi", "maven", "go", "nuget", "rubygems", "cargo", "composer")

CVE_CORE_NAMES = (
    "severity_numeric", "cvss_score", "epss_score", "epss_percentile",
    "days_since_published", "days_since_modified", "is_withdrawn", "has_patch",
    "num_references", "num_sources", *cvss.FLAG_NAMES,
)
CWE_NAMES = (
    "cwe_count", *[f"is_cwe_{number_}" for number_ in cwe.INDICATOR_IDS], *cwe.FAMILIES,
    "cwe_historical_exploit_rate", "cwe_global_frequency", "cwe_primary_encoded",
)
DEPENDENCY_ROW_NAMES = (
    "dependency_depth", "is_direct_dependency", "is_transitive_dependency", "transitive_dep_count",
    "version_gap_major", "version_gap_minor", "version_gap_patch", "is_major_upgrade",
    "num_fix_versions", "num_affected_ranges", "has_fix_available",
    *[f"package_ecosystem_{name}" for name in ECOSYSTEMS],
)
TIME_NAMES = (
    "detection_delay_days", "cve_age_days", "days_since_detection", "patch_available_delay",
    "exposure_window_days", "is_recent_cve", "is_old_cve", "is_exploit_known", "patch_age_days",
    "time_to_patch_ratio", "epss_cvss_ratio", "risk_acceleration", "severity_age_interaction",
    "source_diversity", "reference_density",
)
TEXT_NAMES = (
    "description_length", "description_word_count", "description_has_exploit_mention",
    "description_has_rce_mention", "description_has_dos_mention",
)

Expressions = dict[str, Column]


def exploit_known(df: DataFrame) -> Column:
    """References that speak of an exploit, or more than five of them."""
    return flag(mentions(field(df, "references", ""), "exploit") | (whole(field(df, "num_references", 0)) > 5))


def cve_core(df: DataFrame, as_of: str | datetime, vector: Column) -> Expressions:
    """32 columns; ``vector`` is the normalised CVSS vector."""
    now = moment(as_of)
    severity = F.upper(F.coalesce(field(df, "severity", ""), F.lit("")))
    return {
        "severity_numeric": severity_rank(severity),
        "cvss_score": number(field(df, "cvss_score", 0.0)),
        "epss_score": number(field(df, "epss_score", 0.0)),
        "epss_percentile": number(field(df, "epss_percentile", 0.0)),
        "days_since_published": elapsed_days(now, F.col("published_date")),
        "days_since_modified": elapsed_days(now, F.col("modified_date")),
        "is_withdrawn": whole(field(df, "is_withdrawn", 0)),
        "has_patch": whole(field(df, "has_patch", 0)),
        "num_references": whole(field(df, "num_references", 0)),
        "num_sources": whole(field(df, "num_sources", 0)),
        **cvss.vector_flags(vector),
    }


def cwe_intelligence(df: DataFrame, ids: Column) -> Expressions:
    """20 columns; ``ids`` is the parsed id list."""
    return {
        "cwe_count": F.size(ids),
        **{f"is_cwe_{wanted}": cwe.has_any(ids, (wanted,)) for wanted in cwe.INDICATOR_IDS},
        **{name: cwe.has_any(ids, family) for name, family in cwe.FAMILIES.items()},
        "cwe_historical_exploit_rate": cwe.highest(ids, cwe.EXPLOIT_RATE),
        "cwe_global_frequency": cwe.highest(ids, cwe.GLOBAL_FREQUENCY),
        "cwe_primary_encoded": cwe.label_code(field(df, "primary_cwe", "")),
    }


def dependency(df: DataFrame, current: Column, fix: Column, has_fix: Column) -> Expressions:
    """19 row-local columns; ``current`` and ``fix`` are parsed version parts."""
    depth = whole(field(df, "transitive_dep_count", 0))
    fixes = text_or_blank(field(df, "fix_versions", ""))
    zero = F.lit(0).cast("bigint")

    def gap(position: int) -> Column:
        ahead = version_number(fix, position) - version_number(current, position)
        return F.when(has_fix, F.greatest(ahead, zero)).otherwise(zero)

    ecosystem = lower_strip(F.coalesce(field(df, "ecosystem", ""), F.lit("")))
    return {
        "dependency_depth": depth,
        "is_direct_dependency": (depth == 0).cast("int"),
        "is_transitive_dependency": (depth > 0).cast("int"),
        "transitive_dep_count": depth,
        "version_gap_major": gap(0),
        "version_gap_minor": gap(1),
        "version_gap_patch": gap(2),
        "is_major_upgrade": (gap(0) > 0).cast("int"),
        "num_fix_versions": list_size(fixes),
        "num_affected_ranges": whole(field(df, "num_affected_ranges", 0)),
        "has_fix_available": (strip(fixes) != "").cast("int"),
        **{f"package_ecosystem_{name}": (ecosystem == name).cast("int") for name in ECOSYSTEMS},
    }


def time_exposure(df: DataFrame, as_of: str | datetime) -> Expressions:
    """15 columns of ages, delays and their ratios."""
    now = moment(as_of)
    published, modified, detected = F.col("published_date"), F.col("modified_date"), F.col("detection_time")
    delay, age = elapsed_days(detected, published), elapsed_days(now, published)
    patched = whole(field(df, "has_patch", 0)) > 0
    epss, cvss_score = number(field(df, "epss_score", 0.0)), number(field(df, "cvss_score", 0.0))
    references = number(field(df, "num_references", 0))
    return {
        "detection_delay_days": delay,
        "cve_age_days": age,
        "days_since_detection": elapsed_days(now, detected),
        "patch_available_delay": F.when(patched, delay).otherwise(0),
        "exposure_window_days": F.when(patched, 0).otherwise(age),
        "is_recent_cve": (age <= 30).cast("int"),
        "is_old_cve": (age > 365).cast("int"),
        "is_exploit_known": exploit_known(df),
        "patch_age_days": F.when(patched, elapsed_days(now, modified)).otherwise(0),
        "time_to_patch_ratio": clip(delay.cast("double") / F.greatest(age, F.lit(1)), 0, 10),
        "epss_cvss_ratio": clip(epss / (cvss_score / 10.0 + 0.001), 0, 100),
        "risk_acceleration": epss * (F.lit(1.0) / (age + 1)),
        "severity_age_interaction": whole(field(df, "severity_numeric", 0)) * age,
        "source_diversity": clip(number(field(df, "num_sources", 0)) / 4.0, 0, 1),
        "reference_density": references / (age + 1),
    }


def text_signals(description: Column) -> Expressions:
    """5 columns from a description of any length."""
    text = F.coalesce(description, F.lit(""))
    lowered = F.lower(text)

    def about(phrase: str, word: str) -> Column:
        return (lowered.contains(phrase) | lowered.rlike(rf"(?U)\b{word}\b")).cast("int")

    return {
        "description_length": F.length(text),
        "description_word_count": F.regexp_count(text, F.lit(r"(?U)\S+")),
        "description_has_exploit_mention": lowered.contains("exploit").cast("int"),
        "description_has_rce_mention": about("remote code execution", "rce"),
        "description_has_dos_mention": about("denial of service", "dos"),
    }


def _prepared(df: DataFrame, blocks: Sequence[str]) -> DataFrame:
    """Add the parsed intermediates a block reads many times, so each is computed once per row."""
    extra: Expressions = {}
    if "cve_core" in blocks:
        extra["_vector"] = cvss.normal_vector(field(df, "cvss_vector", ""))
    if "cwe" in blocks:
        extra["_cwe_ids"] = cwe.cwe_ids(field(df, "cwes", ""))
    if "dependency" in blocks:
        first_fix = list_head(field(df, "fix_versions", ""))
        extra["_current"] = version_parts(field(df, "package_version", ""))
        extra["_fix"] = version_parts(first_fix)
        extra["_has_fix"] = first_fix != ""
    return df.withColumns(extra) if extra else df


def row_expressions(df: DataFrame, as_of: str | datetime, block: str) -> Expressions:
    """Expressions of one row-local block over a frame made by :func:`_prepared`."""
    if block == "cve_core":
        return cve_core(df, as_of, F.col("_vector"))
    if block == "cwe":
        return cwe_intelligence(df, F.col("_cwe_ids"))
    if block == "dependency":
        return dependency(df, F.col("_current"), F.col("_fix"), F.col("_has_fix"))
    if block == "time":
        return time_exposure(df, as_of)
    if block == "text":
        return text_signals(field(df, "cve_description", ""))
    raise ValueError(f"unknown row-local block: {block}")


ROW_BLOCKS = ("cve_core", "cwe", "dependency", "time", "text")

# Short canonical columns each block reads; long texts are read by :func:`text_readings`.
ROW_INPUTS = {
    "cve_core": (
        "severity", "cvss_score", "epss_score", "epss_percentile", "published_date", "modified_date",
        "is_withdrawn", "has_patch", "num_references", "num_sources", "cvss_vector",
    ),
    "cwe": ("cwes", "primary_cwe"),
    "dependency": ("transitive_dep_count", "fix_versions", "package_version", "num_affected_ranges", "ecosystem"),
    "time": (
        "published_date", "modified_date", "detection_time", "has_patch", "epss_score", "cvss_score",
        "num_references", "severity_numeric", "num_sources",
    ),
    "text": (),
}


def text_readings(canonical: DataFrame, as_of: str | datetime, blocks: Sequence[str]) -> Expressions:
    """The features read from texts of any length, each under its name behind an underscore."""
    found: Expressions = {}
    if "time" in blocks:
        found["_is_exploit_known"] = exploit_known(canonical)
    if "text" in blocks:
        found.update({f"_{name}": column for name, column in row_expressions(canonical, as_of, "text").items()})
    return found


def row_features(
    canonical: DataFrame,
    as_of: str | datetime,
    blocks: Sequence[str] = ROW_BLOCKS,
    keep: Sequence[str] = ("finding_id",),
    ready: Sequence[str] = (),
) -> DataFrame:
    """Kept columns plus the features of the given row-local blocks, in block order.

    A feature named like a kept column replaces it. ``ready`` names the columns
    that :func:`text_readings` has already made.
    """
    prepared = _prepared(canonical, blocks)
    features: Expressions = {}
    for block in blocks:
        features.update(row_expressions(canonical, as_of, block))
    features.update({name[1:]: F.col(name) for name in ready})
    kept = [F.col(name) for name in keep if name not in features]
    return prepared.select(*kept, *[column.alias(name) for name, column in features.items()])


def metric_word_features(df: DataFrame, keep: Sequence[str] = ("finding_id",)) -> DataFrame:
    """CVSS flags from the metric words of JSON input instead of the vector."""
    flags = cvss.metric_flags(set(df.columns))
    return df.select(*keep, *[column.alias(name) for name, column in flags.items()])


def text_features(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """Text signals of any text column."""
    return df.select(*keep, *[value.alias(name) for name, value in text_signals(F.col(column)).items()])
