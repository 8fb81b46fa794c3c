"""Dashboard, portfolio and catalogue queries over the ranked table."""

from __future__ import annotations

from pyspark.sql import functions as F

from findrisk.operators import dashboard, pages
from findrisk.operators.portfolio_context import portfolio_context
from findrisk.operators.scoring import RANKED_COLUMNS, TIERS, score_components, top_findings
from findrisk.plans.findings import on, printed_sql, round4_sql, scored
from findrisk.plans.registry import query, settle_sql, settled
from findrisk.plans.score_queries import ranked

_COLUMNS = ", ".join(RANKED_COLUMNS)
_MEAN = "sum(CAST(round_even(risk_score * 10000, 0) AS BIGINT))::DOUBLE / count(*) / 10000"
_CRITICAL = "count(*) FILTER (tier = 'CRITICAL')"
_FIX = "count(*) FILTER (user_action = 'fixed')::DOUBLE / count(*)"


@query(
    "summary_kpis",
    on("ranked", f"""SELECT count(*) AS total_vulnerabilities, {printed_sql(_MEAN, 4)} AS avg_risk_score, {printed_sql('max(risk_score)', 4)} AS max_risk_score,
  count(DISTINCT repo) AS unique_repos, count(DISTINCT package_name) AS unique_packages FROM ranked"""),
)
def summary_kpis_query(spark, sf_dir):
    return dashboard.summary_kpis(ranked(spark, sf_dir))


@query(
    "tier_distribution",
    on("ranked", """names(name) AS (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')),
counts AS (SELECT tier, count(*) AS n FROM ranked GROUP BY tier), total AS (SELECT count(*) AS total FROM ranked)
SELECT name, coalesce(n, 0) AS value, printf('%.1f', coalesce(n, 0)::DOUBLE / greatest(total, 1) * 100)::DOUBLE AS percentage
FROM names LEFT JOIN counts ON name = tier, total"""),
)
def tier_distribution_query(spark, sf_dir):
    return dashboard.tier_distribution(ranked(spark, sf_dir))


@query(
    "severity_distribution",
    on("ranked", """names(name) AS (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'))
SELECT name, (SELECT count(*) FROM ranked WHERE severity = name) AS value FROM names"""),
)
def severity_distribution_query(spark, sf_dir):
    return dashboard.severity_distribution(ranked(spark, sf_dir))


@query(
    "risk_histogram",
    on("ranked", """buckets AS (SELECT i, printf('%.1f-%.1f', i / 10.0, (i + 1) / 10.0) AS "range" FROM generate_series(0, 9) t(i)),
placed AS (SELECT least(CAST(round_even(risk_score * 10000, 0) AS BIGINT) // 1000, 9) AS b, count(*) AS n FROM ranked GROUP BY 1)
SELECT "range", coalesce(n, 0) AS "count" FROM buckets LEFT JOIN placed ON i = b"""),
)
def risk_histogram_query(spark, sf_dir):
    return dashboard.risk_histogram(ranked(spark, sf_dir))


@query(
    "risk_histogram_float_bounds",
    on("ranked", """buckets AS (SELECT i, printf('%.1f-%.1f', i / 10.0, (i + 1) / 10.0) AS "range", i * 0.1::DOUBLE AS low FROM generate_series(0, 9) t(i))
SELECT "range", count(risk_score) AS "count" FROM buckets LEFT JOIN ranked ON risk_score >= low AND risk_score < low + 0.1::DOUBLE GROUP BY "range" """),
)
def risk_histogram_float_bounds_query(spark, sf_dir):
    return dashboard.risk_histogram(ranked(spark, sf_dir), float_bounds=True)


@query(
    "top_repos",
    on("ranked", f"""SELECT repo, {_MEAN} AS avg_risk, max(risk_score) AS max_risk, count(cve_id) AS total_vulns, {_CRITICAL} AS critical_count
FROM ranked GROUP BY repo ORDER BY avg_risk DESC, repo LIMIT 10"""),
)
def top_repos_query(spark, sf_dir):
    return dashboard.top_repos(ranked(spark, sf_dir))


@query(
    "top_packages",
    on("ranked", f"""SELECT package_name, count(cve_id) AS total_vulns, {_MEAN} AS avg_risk, {_CRITICAL} AS critical_count
FROM ranked GROUP BY package_name ORDER BY total_vulns DESC, package_name LIMIT 10"""),
)
def top_packages_query(spark, sf_dir):
    return dashboard.top_packages(ranked(spark, sf_dir))


@query("severity_tier_heatmap", on("ranked", 'SELECT severity, tier, count(*) AS "count" FROM ranked GROUP BY severity, tier'))
def severity_tier_heatmap_query(spark, sf_dir):
    return dashboard.severity_tier_heatmap(ranked(spark, sf_dir))


@query("top_vulnerabilities", on("ranked", f"SELECT {_COLUMNS} FROM ranked ORDER BY risk_score DESC, finding_id LIMIT 10"))
def top_vulnerabilities_query(spark, sf_dir):
    return top_findings(ranked(spark, sf_dir), 10)


@query("table_filter", on("ranked", f"SELECT {_COLUMNS} FROM ranked WHERE tier = 'HIGH' AND severity = 'CRITICAL'"))
def table_filter_query(spark, sf_dir):
    return dashboard.table_filter(ranked(spark, sf_dir), tier="high", severity="Critical")


_SEARCH = "CVE-20(19|22)-.*7$|repo-1$"


@query(
    "table_search",
    on("ranked", f"""SELECT {_COLUMNS} FROM ranked WHERE regexp_matches(cve_id, '{_SEARCH}', 'i')
  OR regexp_matches(package_name, '{_SEARCH}', 'i') OR regexp_matches(repo, '{_SEARCH}', 'i')"""),
)
def table_search_query(spark, sf_dir):
    return dashboard.table_filter(ranked(spark, sf_dir), search=_SEARCH)


@query(
    "table_sort",
    on("ranked", f"SELECT {_COLUMNS} FROM ranked WHERE tier = 'MEDIUM' ORDER BY cvss_score, finding_id LIMIT 50"),
)
def table_sort_query(spark, sf_dir):
    return dashboard.table_sort(dashboard.table_filter(ranked(spark, sf_dir), tier="MEDIUM"), "cvss_score", "asc").limit(50)


@query(
    "table_page",
    on("ranked", f"""SELECT {_COLUMNS}, (SELECT count(*) FROM ranked) AS total,
  (SELECT CAST(greatest(ceil(count(*) / 25.0), 1) AS BIGINT) FROM ranked) AS total_pages
FROM ranked ORDER BY epss_score DESC, finding_id LIMIT 25 OFFSET 50"""),
)
def table_page_query(spark, sf_dir):
    table = ranked(spark, sf_dir)
    counts = dashboard.page_counts(table).select(F.struct("total", "total_pages")).scalar()
    page = dashboard.table_page(table, page=3, sort_by="epss_score").withColumn("_counts", counts)
    return page.select(*RANKED_COLUMNS, F.col("_counts.total").alias("total"), F.col("_counts.total_pages").alias("total_pages"))


@query("table_page_deep", on("ranked", f"SELECT {_COLUMNS} FROM ranked ORDER BY epss_score DESC NULLS LAST, finding_id LIMIT 5 OFFSET 49995"))
def table_page_deep_query(spark, sf_dir):
    """Page 10,000 from the staged ranges of the order."""
    index = pages.page_index(ranked(spark, sf_dir), "epss_score", range_rows=4000)
    return pages.page(index, 10_000, 5).select(*RANKED_COLUMNS)


@query(
    "table_page_after",
    on("ranked", f"""SELECT {_COLUMNS} FROM ranked WHERE risk_score < 0.5 OR (risk_score = 0.5 AND finding_id > '5')
ORDER BY risk_score DESC, finding_id LIMIT 25"""),
)
def table_page_after_query(spark, sf_dir):
    """The page that follows a known row, however deep it lies."""
    return dashboard.page_after(ranked(spark, sf_dir), 0.5, "5")


@query(
    "table_page_after_sorted",
    on("ranked", f"""SELECT {_COLUMNS} FROM ranked WHERE epss_score > 0.3 OR (epss_score = 0.3 AND finding_id > '5') OR epss_score IS NULL
ORDER BY epss_score NULLS LAST, finding_id LIMIT 25"""),
)
def table_page_after_sorted_query(spark, sf_dir):
    """The same in another order."""
    return dashboard.page_after(ranked(spark, sf_dir), 0.3, "5", sort_by="epss_score", sort_order="asc")


@query(
    "table_search_literal",
    on("ranked", f"SELECT {_COLUMNS} FROM ranked WHERE contains(lower(concat_ws(chr(10), cve_id, package_name, repo)), '-10.1')"
       " OR contains(lower(concat_ws(chr(10), cve_id, package_name, repo)), 'cve-2021-1000')"),
)
def table_search_literal_query(spark, sf_dir):
    """Plain-text search: a dot is a dot. Two searches, stacked."""
    table = ranked(spark, sf_dir)
    dotted = dashboard.table_filter(table, search="-10.1", literal=True)
    return dotted.unionByName(dashboard.table_filter(table, search="cve-2021-1000", literal=True))


_CVE = "CVE-2020-10001"


@query(
    "finding_detail",
    on("scored", f"""ranked AS (SELECT finding_id, cve_id, severity, package_name, repo, cvss_score, epss_score, {round4_sql('ml_score')} AS ml_score,
  {round4_sql('exact_score')} AS risk_score, tier, cve_description, primary_cwe, user_action, release, has_patch FROM scored),
importance AS (SELECT * FROM (UNPIVOT (SELECT avg(abs(0.45 * ml_score)) AS ml_term, avg(abs(0.2 * normalized_cvss)) AS cvss_term, avg(abs(0.15 * normalized_epss)) AS epss_term,
  avg(abs(0.1 * exposure_score)) AS exposure_term, avg(abs(0.1 * repo_criticality)) AS repo_criticality_term FROM scored)
  ON COLUMNS(*) INTO NAME feature VALUE importance))
SELECT {_COLUMNS}, (SELECT string_agg(feature, ', ' ORDER BY importance DESC, feature) FROM importance) AS top_features
FROM ranked WHERE cve_id = '{_CVE}' ORDER BY risk_score DESC, finding_id LIMIT 1"""),
)
def finding_detail_query(spark, sf_dir):
    """Importance here is the mean size of the score terms; a trained model gives its own."""
    table = scored(spark, sf_dir)
    terms = [f"{name}_term" for name in ("ml", "cvss", "epss", "exposure", "repo_criticality")]
    means = score_components(table).agg(*[F.avg(F.abs(term)).alias(term) for term in terms])
    importance = means.unpivot([], terms, "feature", "importance")
    return dashboard.finding_detail(ranked(spark, sf_dir), _CVE, importance)


# ------------------------------------------------------------------ portfolio


@query(
    "repo_stats",
    on("ranked", f"""SELECT repo, count(*) AS repo_total_cves, count(*) AS repo_cve_count_30d, {settle_sql(_FIX)} AS repo_fix_rate,
  {settle_sql("count(*) FILTER (user_action = 'false_positive')::DOUBLE / count(*)")} AS repo_false_positive_rate,
  {settle_sql('sum(cvss_score::DECIMAL(18,8))::DOUBLE / count(cvss_score)')} AS repo_avg_cvss, {_CRITICAL} AS repo_critical_count,
  count(DISTINCT package_name) AS repo_unique_packages, count(DISTINCT primary_cwe) AS repo_unique_cwes FROM ranked GROUP BY repo"""),
)
def repo_stats_query(spark, sf_dir):
    return settled(dashboard.repo_stats(ranked(spark, sf_dir)))


@query(
    "portfolio_context",
    on("ranked", f"""t AS (SELECT count(*) AS total_vulnerabilities, {settle_sql(_MEAN)} AS avg_risk_score, {_CRITICAL} AS critical_count,
  count(*) FILTER (tier = 'HIGH') AS high_count FROM ranked),
c AS (SELECT primary_cwe, count(*) AS same_cwe_count FROM ranked WHERE primary_cwe <> '' GROUP BY primary_cwe),
p AS (SELECT package_name, count(*) AS same_pkg_count FROM ranked GROUP BY package_name)
SELECT finding_id, total_vulnerabilities, avg_risk_score, critical_count, high_count, same_cwe_count, same_pkg_count
FROM ranked LEFT JOIN c USING (primary_cwe) LEFT JOIN p USING (package_name), t"""),
)
def portfolio_context_query(spark, sf_dir):
    return settled(portfolio_context(ranked(spark, sf_dir)))


@query(
    "portfolio_repos",
    on("ranked", f"""SELECT repo, {settle_sql(_MEAN)} AS avg_risk, count(cve_id) AS cve_count, {_CRITICAL} AS critical_count, {settle_sql(_FIX)} AS fix_rate
FROM ranked GROUP BY repo ORDER BY {_MEAN} DESC, repo LIMIT 10"""),
)
def portfolio_repos_query(spark, sf_dir):
    return settled(dashboard.portfolio_repos(ranked(spark, sf_dir)))


@query(
    "portfolio_cwes",
    on("ranked", f"""SELECT primary_cwe AS cwe, count(cve_id) AS "count", {settle_sql(_FIX)} AS fix_rate
FROM ranked GROUP BY primary_cwe ORDER BY 2 DESC, primary_cwe LIMIT 10"""),
)
def portfolio_cwes_query(spark, sf_dir):
    return settled(dashboard.portfolio_cwes(ranked(spark, sf_dir)))


@query(
    "portfolio_packages",
    on("ranked", f"""SELECT package_name AS package, count(cve_id) AS "count", {settle_sql(_MEAN)} AS avg_risk
FROM ranked GROUP BY package_name ORDER BY 2 DESC, package_name LIMIT 10"""),
)
def portfolio_packages_query(spark, sf_dir):
    return settled(dashboard.portfolio_packages(ranked(spark, sf_dir)))


@query(
    "portfolio_totals",
    on("ranked", f"""SELECT count(*) AS total_vulnerabilities, {settle_sql(_MEAN)} AS avg_risk_score,
  {', '.join(f"count(*) FILTER (tier = '{t}') AS {t.lower()}_count" for t in TIERS)},
  count(DISTINCT repo) AS unique_repos, count(DISTINCT package_name) AS unique_packages FROM ranked"""),
)
def portfolio_totals_query(spark, sf_dir):
    return settled(dashboard.portfolio_totals(ranked(spark, sf_dir)))


@query(
    "portfolio_top_cves",
    on("ranked", "SELECT finding_id, cve_id, risk_score, tier, package_name, primary_cwe FROM ranked ORDER BY risk_score DESC, finding_id LIMIT 10"),
)
def portfolio_top_cves_query(spark, sf_dir):
    return dashboard.portfolio_top_cves(ranked(spark, sf_dir))


def _r3(expression: str) -> str:
    return printed_sql(expression, 3)


@query(
    "portfolio_compact",
    on("ranked", f"""SELECT 'repo' AS section, repo AS item, {_r3('m')} AS measure, n AS "count"
  FROM (SELECT repo, {_MEAN} AS m, count(cve_id) AS n FROM ranked GROUP BY repo ORDER BY m DESC, repo LIMIT 3)
UNION ALL SELECT 'cve', cve_id || ' ' || finding_id, {_r3('risk_score')}, 1
  FROM (SELECT * FROM ranked ORDER BY risk_score DESC, finding_id LIMIT 5)
UNION ALL SELECT 'cwe', primary_cwe, NULL, n
  FROM (SELECT primary_cwe, count(cve_id) AS n FROM ranked GROUP BY primary_cwe ORDER BY n DESC, primary_cwe LIMIT 5)"""),
)
def portfolio_compact_query(spark, sf_dir):
    return dashboard.portfolio_compact(ranked(spark, sf_dir))


@query(
    "repo_catalogue",
    on("ranked", f"""r AS (SELECT repo, count(*) AS total_vulns, {_CRITICAL} AS critical_count, {printed_sql(_MEAN, 4)} AS avg_risk FROM ranked GROUP BY repo)
SELECT repo, r.total_vulns, r.critical_count, r.avg_risk, release, count(*) AS release_total_vulns, {_CRITICAL} AS release_critical_count,
  {printed_sql(_MEAN, 4)} AS release_avg_risk FROM ranked JOIN r USING (repo) GROUP BY repo, r.total_vulns, r.critical_count, r.avg_risk, release"""),
)
def repo_catalogue_query(spark, sf_dir):
    return dashboard.repo_catalogue(ranked(spark, sf_dir))
