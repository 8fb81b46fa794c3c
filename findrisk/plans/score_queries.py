"""Scores, tiers and the ranked table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from findrisk.operators import scoring
from findrisk.plans.findings import findings, on, scored
from findrisk.plans.registry import query, settle_sql, settled

_PARTS = ("ml_score", "normalized_cvss", "normalized_epss", "exposure_score", "repo_criticality")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table all dashboard queries read."""
    return scoring.ranked_table(scored(spark, sf_dir))


@query(
    "hybrid_score",
    on("scored", f"SELECT finding_id, {', '.join(f'{settle_sql(c)} AS {c}' for c in (*_PARTS, 'risk_score'))}, tier FROM scored"),
)
def hybrid_score_query(spark, sf_dir):
    return settled(scored(spark, sf_dir).select("finding_id", *_PARTS, "risk_score", "tier"))


_ML_ONLY = {"ml": 0.7, "cvss": 0.3, "epss": 0.0, "exposure": 0.0, "repo_criticality": 0.0}


@query(
    "hybrid_score_weights",
    on("scored", f"""raw AS (SELECT finding_id, is_withdrawn, cvss_score, exposure_score, 0.7::DOUBLE * ml_score + 0.3::DOUBLE * normalized_cvss AS raw FROM scored),
done AS (SELECT finding_id, least(greatest(CASE WHEN cvss_score >= 9 AND exposure_score > 0.5 THEN greatest(CASE WHEN is_withdrawn = 1 THEN least(raw, 0.1::DOUBLE) ELSE raw END, 0.85::DOUBLE)
  WHEN is_withdrawn = 1 THEN least(raw, 0.1::DOUBLE) ELSE raw END, 0), 1) AS score FROM raw)
SELECT finding_id, {settle_sql('score')} AS risk_score, CASE WHEN score > 0.8::DOUBLE THEN 'CRITICAL' WHEN score > 0.6::DOUBLE THEN 'HIGH' WHEN score > 0.4::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM done"""),
)
def hybrid_score_weights_query(spark, sf_dir):
    """The blend with weights of the caller's choice."""
    table = scored(spark, sf_dir).drop("risk_score", "tier")
    return settled(scoring.hybrid_score(table, weights=_ML_ONLY).select("finding_id", "risk_score", "tier"))


_TERMS = {"ml": (0.45, "ml_score"), "cvss": (0.2, "normalized_cvss"), "epss": (0.15, "normalized_epss"), "exposure": (0.1, "exposure_score"), "repo_criticality": (0.1, "repo_criticality")}


@query(
    "score_components",
    on("scored", "SELECT finding_id, {}, {} AS blended_score, {} AS risk_score, tier FROM scored".format(
        ", ".join(f"{settle_sql(f'{weight}::DOUBLE * {column}')} AS {name}_term" for name, (weight, column) in _TERMS.items()),
        settle_sql("blended"), settle_sql("risk_score"))),
)
def score_components_query(spark, sf_dir):
    return settled(scoring.score_components(scored(spark, sf_dir)))


# ------------------------------------------------------------ request service

# Requests as callers send them; some break a rule.
_REQUEST_COLUMNS = {
    "finding_id": "finding_id",
    "cve_id": "case when num_references = 7 then '  ' else cve_id end",
    "cvss_score": "case when cvss_score is null then cast(11 as double) else cvss_score end",
    "epss_score": "case when transitive_dep_count = 4 and num_references = 2 then cast(-0.5 as double) else epss_score end",
    "has_known_exploit": "num_references > 4",
    "is_withdrawn": "title like 'Withdrawn%'",
    "exposure_score": "case when num_affected_ranges = 0 then null when num_affected_ranges = 1 then cast(1.5 as double) else epss_percentile end",
    "repo_criticality": "repo_criticality",
    "ml_score": "case when num_affected_ranges = 2 then null else model_score end",
}
_REQUESTS_SQL = "requests AS (SELECT {} FROM findings)".format(", ".join(f"{rule} AS {name}" for name, rule in _REQUEST_COLUMNS.items()))
_REASON_SQL = """reasons AS (SELECT *, concat_ws('; ',
  CASE WHEN trim(cve_id) = '' THEN 'cve_id is required' END,
  CASE WHEN cvss_score < 0 OR cvss_score > 10 THEN 'cvss_score must be between 0 and 10' END,
  CASE WHEN epss_score < 0 OR epss_score > 1 THEN 'epss_score must be between 0 and 1' END,
  CASE WHEN exposure_score < 0 OR exposure_score > 1 THEN 'exposure_score must be between 0 and 1' END,
  CASE WHEN repo_criticality < 0 OR repo_criticality > 1 THEN 'repo_criticality must be between 0 and 1' END) AS why FROM requests)"""


def requests(spark, sf_dir):
    return findings(spark, sf_dir).selectExpr(*[f"{rule} as {name}" for name, rule in _REQUEST_COLUMNS.items()])


def _up4(expression: str) -> str:
    return f"(floor(({expression}) * 10000 + 0.5) / 10000)"


@query(
    "score_service_variant",
    on("findings", f"""{_REQUESTS_SQL}, {_REASON_SQL},
p AS (SELECT finding_id, cve_id, coalesce(ml_score, 0.5::DOUBLE) AS ml, CASE WHEN ml_score IS NULL THEN 1 ELSE 0 END AS fb, cvss_score / 10::DOUBLE AS cvss,
  epss_score AS epss, coalesce(exposure_score, 0.5::DOUBLE) AS ex, coalesce(repo_criticality, 0.5::DOUBLE) AS rc, is_withdrawn AS w,
  cvss_score >= 9 AND has_known_exploit AS crit FROM reasons WHERE why = ''),
r AS (SELECT *, 0.45::DOUBLE * ml + 0.2::DOUBLE * cvss + 0.15::DOUBLE * epss + 0.1::DOUBLE * ex + 0.1::DOUBLE * rc AS raw FROM p),
s AS (SELECT *, least(greatest(CASE WHEN w THEN least(raw, 0.1::DOUBLE) WHEN crit THEN greatest(raw, 0.85::DOUBLE) ELSE raw END, 0), 1) AS score FROM r)
SELECT finding_id, cve_id, {_up4('score')} AS risk_score,
  CASE WHEN score > 0.8::DOUBLE THEN 'CRITICAL' WHEN score > 0.6::DOUBLE THEN 'HIGH' WHEN score > 0.4::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS tier,
  {_up4('ml')} AS ml_score, {_up4('cvss')} AS cvss_normalized, {_up4('epss')} AS epss_score, {_up4('ex')} AS exposure_score, {_up4('rc')} AS repo_criticality,
  fb AS ml_fallback_used, CASE WHEN w THEN 'withdrawn_cap' WHEN crit THEN 'critical_exploit_floor' ELSE 'none' END AS overrides_applied FROM s"""),
)
def score_service_variant_query(spark, sf_dir):
    return scoring.service_score(scoring.accepted_requests(requests(spark, sf_dir)))


@query(
    "validate_requests",
    on("findings", f"{_REQUESTS_SQL}, {_REASON_SQL} SELECT finding_id, CASE WHEN why = '' THEN 'accepted' ELSE why END AS outcome FROM reasons"),
)
def validate_requests_query(spark, sf_dir):
    checked = scoring.validate_requests(requests(spark, sf_dir))
    return checked.select("finding_id", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"))


@query(
    "validate_counts",
    on("findings", f"{_REQUESTS_SQL}, {_REASON_SQL} SELECT count(*) FILTER (why = '') AS accepted, count(*) FILTER (why <> '') AS failed FROM reasons"),
)
def validate_counts_query(spark, sf_dir):
    checked = scoring.validate_requests(requests(spark, sf_dir))
    return checked.agg(
        F.count_if(F.col("reject_reason").isNull()).alias("accepted"), F.count_if(F.col("reject_reason").isNotNull()).alias("failed")
    )


@query(
    "tier_summary",
    on("scored", f"""SELECT count(*) AS total, {', '.join(f"count(*) FILTER (tier = '{t}') AS {t.lower()}" for t in scoring.TIERS)},
  {settle_sql("count(*) FILTER (tier = 'CRITICAL')::DOUBLE / greatest(count(*), 1) * 100")} AS critical_pct,
  {settle_sql("count(*) FILTER (tier = 'HIGH')::DOUBLE / greatest(count(*), 1) * 100")} AS high_pct FROM scored"""),
)
def tier_summary_query(spark, sf_dir):
    return settled(scoring.tier_summary(scored(spark, sf_dir)))


_RANKED_LIST = ", ".join(scoring.RANKED_COLUMNS)


@query("ranked_results", on("ranked", f"SELECT {_RANKED_LIST} FROM ranked"))
def ranked_results_query(spark, sf_dir):
    return scoring.by_risk(ranked(spark, sf_dir))


@query("top_n_riskiest", on("ranked", f"SELECT {_RANKED_LIST} FROM ranked ORDER BY risk_score DESC, finding_id LIMIT 20"))
def top_n_riskiest_query(spark, sf_dir):
    return scoring.top_findings(ranked(spark, sf_dir), 20)
