"""Release comparison queries, for all repos at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from findrisk.operators import releases
from findrisk.operators.scoring import TIERS
from findrisk.plans.findings import on
from findrisk.plans.registry import query, settle_sql, settled
from findrisk.plans.score_queries import ranked

_MEAN = "sum(CAST(round_even(risk_score * 10000, 0) AS BIGINT))::DOUBLE / count(*) / 10000"
_PAIRS_SQL = """per_release AS (SELECT DISTINCT repo, release FROM ranked),
placed AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY release DESC) AS k, count(*) OVER (PARTITION BY repo) AS n_releases FROM per_release),
pairs AS (SELECT a.repo, a.release AS current_release, b.release AS previous_release, a.n_releases
  FROM placed a JOIN placed b ON a.repo = b.repo AND a.k = 1 AND b.k = 2)"""


@query("release_pairs", on("ranked", f"{_PAIRS_SQL} SELECT * FROM pairs"))
def release_pairs_query(spark, sf_dir):
    return releases.release_pairs(ranked(spark, sf_dir))


@query(
    "release_pairs_named",
    on("ranked", """per_release AS (SELECT DISTINCT repo, release FROM ranked),
placed AS (SELECT *, lag(release) OVER (PARTITION BY repo ORDER BY release) AS before, count(*) OVER (PARTITION BY repo) AS n_releases FROM per_release)
SELECT repo, release AS current_release, coalesce(before, release) AS previous_release, n_releases FROM placed WHERE release = 'v3.0.0' AND n_releases >= 2"""),
)
def release_pairs_named_query(spark, sf_dir):
    """A named release against the one before it."""
    return releases.release_pairs(ranked(spark, sf_dir), current="v3.0.0")


# Release numbers that text order and number order see differently.
_LONG_RELEASE = "case when release in ('v1.0.0', 'v2.0.0') then concat(substr(release, 1, 2), '0.0.0') else release end"


@query(
    "release_pairs_version",
    on("ranked", f"""per_release AS (SELECT DISTINCT repo, {_LONG_RELEASE} AS release FROM ranked),
placed AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY CAST(split_part(substr(release, 2), '.', 1) AS INTEGER) DESC) AS k, count(*) OVER (PARTITION BY repo) AS n_releases FROM per_release)
SELECT a.repo, a.release AS current_release, b.release AS previous_release, a.n_releases FROM placed a JOIN placed b ON a.repo = b.repo AND a.k = 1 AND b.k = 2"""),
)
def release_pairs_version_query(spark, sf_dir):
    """Pairs by version number instead of text."""
    return releases.release_pairs(ranked(spark, sf_dir).withColumn("release", F.expr(_LONG_RELEASE)), order="version")


# Some repos lose their releases and some keep one, so that each reason occurs.
_THINNED = "case when repo like '%3' then null when repo like '%7' then 'v1.0.0' else release end"


@query(
    "release_eligibility",
    on("ranked", f"""thin AS (SELECT repo, {_THINNED} AS release FROM ranked),
counts AS (SELECT repo, count(DISTINCT release) AS n_releases FROM thin GROUP BY repo)
SELECT repo, n_releases, CASE WHEN n_releases = 0 THEN 'no release data' WHEN n_releases < 2 THEN 'needs at least two releases' END AS reject_reason FROM counts"""),
)
def release_eligibility_query(spark, sf_dir):
    thinned = ranked(spark, sf_dir).withColumn("release", F.expr(_THINNED))
    return releases.release_eligibility(thinned)


_STATS_SQL = f"""stats AS (SELECT repo, release, count(*) AS total_vulns, {_MEAN} AS avg_risk_score, max(risk_score) AS max_risk_score,
  {', '.join(f"count(*) FILTER (tier = '{t}') AS {t.lower()}_count" for t in TIERS)}, count(DISTINCT package_name) AS unique_packages,
  count(*) FILTER (has_patch <> 0)::DOUBLE / count(*) AS patch_rate, count(*) FILTER (user_action = 'fixed')::DOUBLE / count(*) AS fix_rate
  FROM ranked GROUP BY repo, release)"""
_DOUBLES = ("avg_risk_score", "max_risk_score", "patch_rate", "fix_rate")


@query(
    "release_stats",
    on("ranked", f"{_STATS_SQL} SELECT * REPLACE ({', '.join(f'{settle_sql(c)} AS {c}' for c in _DOUBLES)}) FROM stats"),
)
def release_stats_query(spark, sf_dir):
    return settled(releases.release_stats(ranked(spark, sf_dir)))


@query(
    "release_top_cves",
    on("ranked", """SELECT repo, release, CAST(k AS INTEGER) AS rank, finding_id, cve_id, risk_score, tier, package_name, primary_cwe FROM
(SELECT *, row_number() OVER (PARTITION BY repo, release ORDER BY risk_score DESC, finding_id) AS k FROM ranked) WHERE k <= 5"""),
)
def release_top_cves_query(spark, sf_dir):
    return releases.release_top_cves(ranked(spark, sf_dir))


@query(
    "release_top_cwes",
    on("ranked", """c AS (SELECT repo, release, primary_cwe AS cwe, count(cve_id) AS "count" FROM ranked GROUP BY ALL)
SELECT repo, release, cwe, "count", CAST(k AS INTEGER) AS rank FROM
(SELECT *, row_number() OVER (PARTITION BY repo, release ORDER BY "count" DESC, cwe) AS k FROM c) WHERE k <= 5"""),
)
def release_top_cwes_query(spark, sf_dir):
    return releases.release_top_cwes(ranked(spark, sf_dir))


@query(
    "release_top_packages",
    on("ranked", f"""c AS (SELECT repo, release, package_name AS package, count(cve_id) AS "count", {settle_sql(_MEAN)} AS avg_risk FROM ranked GROUP BY repo, release, package_name)
SELECT repo, release, package, "count", avg_risk, CAST(k AS INTEGER) AS rank FROM
(SELECT *, row_number() OVER (PARTITION BY repo, release ORDER BY "count" DESC, package) AS k FROM c) WHERE k <= 5"""),
)
def release_top_packages_query(spark, sf_dir):
    return settled(releases.release_top_packages(ranked(spark, sf_dir)))


_SIDES_SQL = f"""{_PAIRS_SQL},
cur AS (SELECT r.* FROM ranked r JOIN pairs p ON r.repo = p.repo AND r.release = p.current_release),
prev AS (SELECT r.* FROM ranked r JOIN pairs p ON r.repo = p.repo AND r.release = p.previous_release)"""


def _changed_sql(mine: str, other: str) -> str:
    return on("ranked", f"""{_SIDES_SQL},
gone AS (SELECT * FROM {mine} m WHERE NOT EXISTS (SELECT 1 FROM {other} o WHERE o.repo = m.repo AND o.cve_id = m.cve_id))
SELECT repo, release, CAST(k AS INTEGER) AS rank, finding_id, cve_id, risk_score, tier, package_name FROM
(SELECT *, row_number() OVER (PARTITION BY repo ORDER BY risk_score DESC, finding_id) AS k FROM gone) WHERE k <= 10""")


@query("new_cves", _changed_sql("cur", "prev"))
def new_cves_query(spark, sf_dir):
    return releases.new_cves(ranked(spark, sf_dir))


# Some findings have no CVE, and some repos none at all.
_GAPS = "case when finding_id like '%7' or repo like '%4' then null else cve_id end"


def _with_gaps(sql: str) -> str:
    """The same SQL over the ranked table with gaps."""
    head, body = sql.split("per_release AS", 1)
    return f"{head}gapped AS (SELECT * REPLACE ({_GAPS} AS cve_id) FROM ranked),\nper_release AS{body.replace('FROM ranked', 'FROM gapped')}"


def gapped(spark, sf_dir):
    return ranked(spark, sf_dir).withColumn("cve_id", F.expr(_GAPS))


@query("new_cves_gaps", _with_gaps(_changed_sql("cur", "prev")).replace("WHERE NOT EXISTS", "WHERE m.cve_id IS NOT NULL AND NOT EXISTS"))
def new_cves_gaps_query(spark, sf_dir):
    """Rows without a CVE are neither new nor resolved."""
    return releases.new_cves(gapped(spark, sf_dir))


@query("resolved_cves", _changed_sql("prev", "cur"))
def resolved_cves_query(spark, sf_dir):
    return releases.resolved_cves(ranked(spark, sf_dir))


# Weaknesses named as finely as CVE numbers, so that releases differ in them.
_FINE_CWE = "concat('CWE-', right(cve_id, 3))"


def _cwes_sql(mine: str, other: str) -> str:
    return on("ranked", f"{_SIDES_SQL} SELECT repo, {_FINE_CWE} AS cwe FROM {mine} EXCEPT SELECT repo, {_FINE_CWE} FROM {other}")


@query("new_cwes", _cwes_sql("cur", "prev"))
def new_cwes_query(spark, sf_dir):
    return releases.new_cwes(ranked(spark, sf_dir).withColumn("primary_cwe", F.expr(_FINE_CWE)))


@query("resolved_cwes", _cwes_sql("prev", "cur"))
def resolved_cwes_query(spark, sf_dir):
    return releases.resolved_cwes(ranked(spark, sf_dir).withColumn("primary_cwe", F.expr(_FINE_CWE)))


def _delta_sql(sides: str) -> str:
    return on("ranked", f"""{sides}, {_STATS_SQL},
came AS (SELECT repo, count(*) AS n FROM (SELECT repo, cve_id FROM cur EXCEPT SELECT repo, cve_id FROM prev) GROUP BY repo),
went AS (SELECT repo, count(*) AS n FROM (SELECT repo, cve_id FROM prev EXCEPT SELECT repo, cve_id FROM cur) GROUP BY repo)
SELECT p.repo, current_release, previous_release, c.total_vulns - v.total_vulns AS vuln_count_change,
  {settle_sql("(c.total_vulns - v.total_vulns)::DOUBLE / greatest(v.total_vulns, 1)")} AS vuln_count_change_pct,
  {settle_sql("c.avg_risk_score - v.avg_risk_score")} AS avg_risk_change, c.critical_count - v.critical_count AS critical_change,
  c.high_count - v.high_count AS high_change, {settle_sql("c.patch_rate - v.patch_rate")} AS patch_rate_change,
  coalesce(came.n, 0) AS new_cve_count, coalesce(went.n, 0) AS resolved_cve_count
FROM pairs p JOIN stats c ON c.repo = p.repo AND c.release = current_release JOIN stats v ON v.repo = p.repo AND v.release = previous_release
LEFT JOIN came ON came.repo = p.repo LEFT JOIN went ON went.repo = p.repo""")


@query("release_delta", _delta_sql(_SIDES_SQL))
def release_delta_query(spark, sf_dir):
    return settled(releases.release_delta(ranked(spark, sf_dir)))


@query("release_delta_gaps", _with_gaps(_delta_sql(_SIDES_SQL)).replace("count(*) AS n FROM (SELECT", "count(cve_id) AS n FROM (SELECT"))
def release_delta_gaps_query(spark, sf_dir):
    """Counts agree with the lists where CVEs are missing."""
    return settled(releases.release_delta(gapped(spark, sf_dir)))


_NAMED_SQL = _SIDES_SQL.replace("a.k = 1 AND b.k = 2", "a.release = 'v5.0.0' AND b.release = 'v2.0.0'")


@query("release_delta_named", _delta_sql(_NAMED_SQL))
def release_delta_named_query(spark, sf_dir):
    """Any two releases by name."""
    table = ranked(spark, sf_dir)
    return settled(releases.release_delta(table, releases.release_pairs(table, current="v5.0.0", previous="v2.0.0")))


_CHURN_SQL = f"""{{values}},
placed AS (SELECT repo, release, lag(release) OVER (PARTITION BY repo ORDER BY release) AS before FROM (SELECT DISTINCT repo, release FROM {{table}}))
SELECT p.repo, p.release, p.before, count(v.value) FILTER (v.release = p.release) AS held,
  count(v.value) FILTER (v.release = p.release AND NOT EXISTS (SELECT 1 FROM held_values o WHERE o.repo = p.repo AND o.release = p.before AND o.value = v.value)) AS "new",
  count(v.value) FILTER (v.release = p.before AND NOT EXISTS (SELECT 1 FROM held_values o WHERE o.repo = p.repo AND o.release = p.release AND o.value = v.value)) AS resolved
FROM placed p LEFT JOIN held_values v ON v.repo = p.repo AND (v.release = p.release OR v.release = p.before)
WHERE p.before IS NOT NULL GROUP BY p.repo, p.release, p.before"""


def _churn_sql(column: str, table: str = "ranked") -> str:
    return _CHURN_SQL.format(values=f"held_values AS (SELECT DISTINCT repo, release, {column} AS value FROM {table} WHERE {column} IS NOT NULL)", table=table)


@query("release_churn_cves", on("ranked", f"gapped AS (SELECT * REPLACE ({_GAPS} AS cve_id) FROM ranked), {_churn_sql('cve_id', 'gapped')}"))
def release_churn_cves_query(spark, sf_dir):
    """CVEs that came and went with every release, from the bit sets."""
    return releases.release_churn(releases.release_sets(gapped(spark, sf_dir), "cve_id"))


@query("release_churn_cwes", on("ranked", _churn_sql(_FINE_CWE)))
def release_churn_cwes_query(spark, sf_dir):
    return releases.release_churn(releases.release_sets(ranked(spark, sf_dir).withColumn("primary_cwe", F.expr(_FINE_CWE)), "primary_cwe"))
