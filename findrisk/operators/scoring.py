"""Risk score: a model probability blended with business rules, and its tier."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from findrisk.functions.numbers import clip, flag, number, round4, round4_half_up
from findrisk.functions.text import strip
from findrisk.operators.canonical import field

# Weights of the blend, tier bounds, overrides and fallbacks.
WEIGHTS = {"ml": 0.45, "cvss": 0.20, "epss": 0.15, "exposure": 0.10, "repo_criticality": 0.10}
PARTS = {
    "ml": "ml_score", "cvss": "normalized_cvss", "epss": "normalized_epss",
    "exposure": "exposure_score", "repo_criticality": "repo_criticality",
}
TIER_BOUNDS = (("CRITICAL", 0.8), ("HIGH", 0.6), ("MEDIUM", 0.4))
TIERS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
EXPOSURE_WEIGHTS = {"attack_vector_network": 0.4, "privileges_required_none": 0.3, "is_exploit_known": 0.3}
WITHDRAWN_CAP = 0.1
CRITICAL_FLOOR = 0.85
CRITICAL_CVSS = 9.0
CRITICAL_EXPOSURE = 0.5
DEFAULT_CRITICALITY = 0.5
DEFAULT_EXPOSURE = 0.5
FALLBACK_ML_SCORE = 0.5

RANKED_COLUMNS = (
    "finding_id", "cve_id", "severity", "package_name", "repo", "cvss_score", "epss_score",
    "ml_score", "risk_score", "tier", "cve_description", "primary_cwe", "user_action", "release", "has_patch",
)


def classify_tier(score: Column) -> Column:
    """Tier of an unrounded score; a bound itself belongs to the tier below."""
    tier = F.lit("LOW")
    for name, bound in reversed(TIER_BOUNDS):
        tier = F.when(score > bound, name).otherwise(tier)
    return tier


def exposure_score(df: DataFrame) -> Column:
    """Weighted sum of the three exposure flags that are present."""
    total = F.lit(0.0)
    for name, weight in EXPOSURE_WEIGHTS.items():
        if name in df.columns:
            total = total + F.col(name) * weight
    return clip(total, 0, 1)


def _blend(parts: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    total = None
    for name in WEIGHTS:
        term = F.lit(float(weights[name])) * parts[name]
        total = term if total is None else total + term
    return total


def hybrid_score(df: DataFrame, *, ml_score: str = "ml_score", weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Add ml_score, the normalised components, risk_score and tier.

    A withdrawn finding is capped first; the floor for critical and exposed ones
    comes after and so wins over the cap.
    """
    # Components first, so that later expressions refer to finished columns.
    parts = df.withColumns(
        {
            "ml_score": F.col(ml_score).cast("double"),
            "normalized_cvss": clip(number(field(df, "cvss_score", 0.0)), 0, 10) / 10.0,
            "normalized_epss": clip(number(field(df, "epss_percentile", 0.0)), 0, 1),
            "exposure_score": exposure_score(df),
            "repo_criticality": number(field(df, "repo_criticality", DEFAULT_CRITICALITY), DEFAULT_CRITICALITY),
        }
    )
    blended = parts.withColumn("risk_score", _blend({part: F.col(name) for part, name in PARTS.items()}, weights))
    # least and greatest skip nulls, so an override that does not apply drops out;
    # each step refers to the score once, which keeps pushed-down filters small.
    critical = (number(field(df, "cvss_score", 0.0)) >= CRITICAL_CVSS) & (F.col("exposure_score") > CRITICAL_EXPOSURE)
    capped = F.least(F.col("risk_score"), F.when(field(df, "is_withdrawn", 0) == 1, WITHDRAWN_CAP))
    final = clip(F.greatest(capped, F.when(critical, CRITICAL_FLOOR)), 0, 1)
    return blended.withColumn("risk_score", final).withColumn("tier", classify_tier(F.col("risk_score")))


def score_terms(weights: Mapping[str, float] = WEIGHTS) -> dict[str, Column]:
    """The weighted terms of a scored table by part."""
    return {part: F.lit(float(weights[part])) * F.col(name) for part, name in PARTS.items()}


def score_components(scored: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """The five weighted terms of each score, the blend before overrides and the score."""
    return scored.select(
        "finding_id",
        *[term.alias(f"{part}_term") for part, term in score_terms(weights).items()],
        _blend({part: F.col(name) for part, name in PARTS.items()}, weights).alias("blended_score"),
        "risk_score",
        "tier",
    )


def service_score(df: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Score of the request service.

    Differs from :func:`hybrid_score`: EPSS score instead of percentile, nothing
    clipped before the blend, exposure and criticality given by the caller, the
    critical floor only where no cap applied, four decimals with ties upward.
    A missing model score falls back to 0.5 and says so.
    """
    parts = df.select(
        *[name for name in ("finding_id", "cve_id") if name in df.columns],
        F.coalesce(F.col("ml_score").cast("double"), F.lit(FALLBACK_ML_SCORE)).alias("ml"),
        F.col("ml_score").isNull().alias("fallback"),
        (F.col("cvss_score") / 10.0).alias("cvss"),
        F.col("epss_score").alias("epss"),
        F.coalesce(F.col("exposure_score"), F.lit(DEFAULT_EXPOSURE)).alias("exposure"),
        F.coalesce(F.col("repo_criticality"), F.lit(DEFAULT_CRITICALITY)).alias("repo_criticality"),
        flag(F.col("is_withdrawn").cast("int") == 1).alias("withdrawn"),
        flag((F.col("cvss_score") >= CRITICAL_CVSS) & (F.col("has_known_exploit").cast("int") == 1)).alias("critical"),
    )
    raw = _blend({name: F.col(name) for name in WEIGHTS}, weights)
    overridden = (
        F.when(F.col("withdrawn") == 1, F.least(raw, F.lit(WITHDRAWN_CAP)))
        .when(F.col("critical") == 1, F.greatest(raw, F.lit(CRITICAL_FLOOR)))
        .otherwise(raw)
    )
    override = F.when(F.col("withdrawn") == 1, "withdrawn_cap").when(F.col("critical") == 1, "critical_exploit_floor")
    scored = parts.withColumn("score", clip(overridden, 0, 1))
    return scored.select(
        *[name for name in ("finding_id", "cve_id") if name in df.columns],
        round4_half_up(F.col("score")).alias("risk_score"),
        classify_tier(F.col("score")).alias("tier"),
        round4_half_up(F.col("ml")).alias("ml_score"),
        round4_half_up(F.col("cvss")).alias("cvss_normalized"),
        round4_half_up(F.col("epss")).alias("epss_score"),
        round4_half_up(F.col("exposure")).alias("exposure_score"),
        round4_half_up(F.col("repo_criticality")).alias("repo_criticality"),
        F.col("fallback").cast("int").alias("ml_fallback_used"),
        override.otherwise("none").alias("overrides_applied"),
    )


def validate_requests(df: DataFrame) -> DataFrame:
    """Add ``reject_reason``: null for a valid request, else the broken rules joined by "; "."""

    def outside(name: str, high: int, required: bool) -> Column:
        value = F.col(name)
        bad = (value < 0) | (value > high) | F.isnan(value)
        broken = F.coalesce(bad, F.lit(required))
        return F.when(broken, f"{name} must be between 0 and {high}")

    blank_id = F.when(strip(F.coalesce(F.col("cve_id"), F.lit(""))) == "", "cve_id is required")
    reasons = F.concat_ws(
        "; ",
        blank_id,
        outside("cvss_score", 10, True),
        outside("epss_score", 1, True),
        outside("exposure_score", 1, False),
        outside("repo_criticality", 1, False),
    )
    return df.withColumn("reject_reason", F.when(reasons != "", reasons))


def accepted_requests(df: DataFrame) -> DataFrame:
    return validate_requests(df).filter("reject_reason is null").drop("reject_reason")


def rejected_requests(df: DataFrame) -> DataFrame:
    return validate_requests(df).filter("reject_reason is not null")


def tier_summary(scored: DataFrame) -> DataFrame:
    """One row: total, count per tier, and the shares of the two upper tiers in percent."""
    counts = scored.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("tier") == tier).alias(tier.lower()) for tier in TIERS],
    )
    base = F.greatest(F.col("total"), F.lit(1))
    return counts.withColumns(
        {"critical_pct": F.col("critical") / base * 100.0, "high_pct": F.col("high") / base * 100.0}
    )


def ranked_table(scored: DataFrame) -> DataFrame:
    """The scored table readers use: scores to four decimals, tier from the exact score."""
    return scored.withColumns({"ml_score": round4(F.col("ml_score")), "risk_score": round4(F.col("risk_score"))}).select(
        *[name for name in RANKED_COLUMNS if name in scored.columns]
    )


def by_risk(ranked: DataFrame) -> DataFrame:
    """Highest risk first, equal scores by finding."""
    return ranked.orderBy(F.desc("risk_score"), "finding_id")


def top_findings(ranked: DataFrame, n: int = 10) -> DataFrame:
    return by_risk(ranked).limit(n)
