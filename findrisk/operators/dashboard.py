"""Answers over the ranked table: summaries, distributions, top lists, table pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from findrisk.functions.numbers import exact_mean, exact_round, mean4, sum4
from findrisk.operators.scoring import TIERS, by_risk
from findrisk.storage import stage

# Severities shown, and actions the dashboards count.
SHOWN_SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
FIXED = "fixed"
FALSE_POSITIVE = "false_positive"


def _critical() -> Column:
    return F.count_if(F.col("tier") == "CRITICAL")


def _share(action: str) -> Column:
    return F.count_if(F.col("user_action") == action) / F.count(F.lit(1))


def summary_kpis(ranked: DataFrame) -> DataFrame:
    """Total, mean and highest risk, distinct repos and packages, in one row."""
    return ranked.agg(
        F.count(F.lit(1)).alias("total_vulnerabilities"),
        exact_round(mean4(F.col("risk_score")), 4).alias("avg_risk_score"),
        exact_round(F.max("risk_score"), 4).alias("max_risk_score"),
        F.countDistinct("repo").alias("unique_repos"),
        F.countDistinct("package_name").alias("unique_packages"),
    )


def _fixed_counts(df: DataFrame, conditions: dict[str, Column], label: str, value: str) -> DataFrame:
    """One row per condition with its count, zeros included, from a single one-row aggregate."""
    counts = df.agg(
        *[F.count_if(condition).alias(name) for name, condition in conditions.items()],
        F.count(F.lit(1)).alias("_total"),
    )
    return counts.unpivot("_total", [F.col(f"`{name}`") for name in conditions], label, value)


def tier_distribution(ranked: DataFrame) -> DataFrame:
    """Count and percentage (one decimal) of each of the four tiers."""
    counts = _fixed_counts(ranked, {tier: F.col("tier") == tier for tier in TIERS}, "name", "value")
    share = F.col("value") / F.greatest(F.col("_total"), F.lit(1)) * 100.0
    return counts.select("name", "value", exact_round(share, 1).alias("percentage"))


def severity_distribution(ranked: DataFrame) -> DataFrame:
    """Counts of the four known severities; UNKNOWN is left out."""
    return _fixed_counts(ranked, {name: F.col("severity") == name for name in SHOWN_SEVERITIES}, "name", "value").drop("_total")


def risk_histogram(ranked: DataFrame, *, float_bounds: bool = False) -> DataFrame:
    """Ten buckets of risk.

    By default a score belongs to the bucket its decimals say, and 1.0 to the
    last one. With ``float_bounds`` the bounds are sums of binary doubles: 0.6
    and 1.0 then fall in no bucket, and 0.3 and 0.7 land one bucket lower.
    """
    risk = F.col("risk_score")
    tenth = F.least(F.floor(F.rint(risk * 10000.0) / 1000.0), F.lit(9))
    conditions = {}
    for i in range(10):
        label = f"{i / 10:.1f}-{(i + 1) / 10:.1f}"
        low = i * 0.1
        conditions[label] = (risk >= low) & (risk < low + 0.1) if float_bounds else tenth == i
    return _fixed_counts(ranked, conditions, "range", "count").drop("_total")


def top_repos(ranked: DataFrame, n: int = 10) -> DataFrame:
    """Repos by mean risk; rows without a repo belong to none."""
    stats = ranked.filter("repo is not null").groupBy("repo").agg(
        mean4(F.col("risk_score")).alias("avg_risk"),
        F.max("risk_score").alias("max_risk"),
        F.count("cve_id").alias("total_vulns"),
        _critical().alias("critical_count"),
    )
    return stats.orderBy(F.desc("avg_risk"), "repo").limit(n)


def top_packages(ranked: DataFrame, n: int = 10) -> DataFrame:
    """Packages by number of findings."""
    stats = ranked.filter("package_name is not null").groupBy("package_name").agg(
        F.count("cve_id").alias("total_vulns"),
        mean4(F.col("risk_score")).alias("avg_risk"),
        _critical().alias("critical_count"),
    )
    return stats.orderBy(F.desc("total_vulns"), "package_name").limit(n)


def severity_tier_heatmap(ranked: DataFrame) -> DataFrame:
    """Findings per observed pair of severity and tier."""
    return ranked.groupBy("severity", "tier").agg(F.count(F.lit(1)).alias("count"))


# ----------------------------------------------------------------- table view


def table_filter(
    ranked: DataFrame,
    *,
    tier: str | None = None,
    severity: str | None = None,
    search: str | None = None,
    literal: bool = False,
) -> DataFrame:
    """Rows of a tier and a severity whose CVE, package or repo matches ``search``.

    ``search`` is a case-insensitive regular expression, or plain text with ``literal``.
    """
    table = ranked
    if tier:
        table = table.filter(F.col("tier") == tier.upper())
    if severity:
        table = table.filter(F.col("severity") == severity.upper())
    if search:
        hit = F.lit(False)
        for name in ("cve_id", "package_name", "repo"):
            column = F.col(name)
            found = F.lower(column).contains(search.lower()) if literal else column.rlike(f"(?iu){search}")
            hit = hit | F.coalesce(found, F.lit(False))
        table = table.filter(hit)
    return table


def order_columns(table: DataFrame, sort_by: str, sort_order: str) -> list[Column]:
    """Sort keys with the finding as last one; an unknown column leaves the order by risk."""
    if sort_by not in table.columns:
        return [F.desc("risk_score"), F.asc("finding_id")]
    column = F.col(sort_by)
    return [column.asc_nulls_last() if sort_order == "asc" else column.desc_nulls_last(), F.asc("finding_id")]


def table_sort(table: DataFrame, sort_by: str = "risk_score", sort_order: str = "desc") -> DataFrame:
    return table.orderBy(*order_columns(table, sort_by, sort_order))


def page_counts(table: DataFrame, page_size: int = 25) -> DataFrame:
    """Total rows and pages of a filtered table; an empty table has one page."""
    return table.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "total_pages", F.greatest(F.ceil(F.col("total") / page_size), F.lit(1)).cast("bigint")
    )


def table_page(
    table: DataFrame, page: int = 1, page_size: int = 25, sort_by: str = "risk_score", sort_order: str = "desc"
) -> DataFrame:
    """One page of the sorted table; a page past the end is empty.

    Every task keeps only the first ``page * page_size`` rows. For deep pages use
    :func:`page_after`, which keeps one page, or an index (:mod:`findrisk.operators.pages`).
    """
    return table_sort(table, sort_by, sort_order).offset((page - 1) * page_size).limit(page_size)


def page_after(
    table: DataFrame, value, finding_id: str, page_size: int = 25, sort_by: str = "risk_score", sort_order: str = "desc"
) -> DataFrame:
    """The page that follows a given row, told by its sort value and id, in any order of ``table_sort``."""
    if sort_by not in table.columns:
        sort_by, sort_order = "risk_score", "desc"
    column, behind = F.col(sort_by), F.col("finding_id") > finding_id
    if value is None:
        later = column.isNull() & behind
    else:
        beyond = column > F.lit(value) if sort_order == "asc" else column < F.lit(value)
        later = beyond | ((column == F.lit(value)) & behind) | column.isNull()
    return table_sort(table.filter(later), sort_by, sort_order).limit(page_size)


def finding_detail(ranked: DataFrame, cve_id: str, importance: DataFrame | None = None, top: int = 10) -> DataFrame:
    """Highest-ranked row of one CVE, with the most important features as text if given."""
    row = by_risk(ranked.filter(F.col("cve_id") == cve_id)).limit(1)
    if importance is None:
        return row
    best = importance.orderBy(F.desc("importance"), "feature").limit(top)
    entries = F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("o"), "feature")))
    names = best.agg(F.array_join(F.transform(entries, lambda e: e["feature"]), ", ")).scalar()
    return row.withColumn("top_features", names)


# ------------------------------------------------------------------ portfolio


def repo_stats(ranked: DataFrame) -> DataFrame:
    """Statistics of every repo; the 30-day count is the plain count, as no window is applied."""
    return ranked.filter("repo is not null").groupBy("repo").agg(
        F.count(F.lit(1)).alias("repo_total_cves"),
        F.count(F.lit(1)).alias("repo_cve_count_30d"),
        _share(FIXED).alias("repo_fix_rate"),
        _share(FALSE_POSITIVE).alias("repo_false_positive_rate"),
        exact_mean(F.col("cvss_score")).alias("repo_avg_cvss"),
        _critical().alias("repo_critical_count"),
        F.countDistinct("package_name").alias("repo_unique_packages"),
        F.countDistinct("primary_cwe").alias("repo_unique_cwes"),
    )


def portfolio_totals(ranked: DataFrame) -> DataFrame:
    """Size, mean risk, tier counts and distinct repos and packages in one row."""
    return ranked.agg(
        F.count(F.lit(1)).alias("total_vulnerabilities"),
        mean4(F.col("risk_score")).alias("avg_risk_score"),
        *[F.count_if(F.col("tier") == tier).alias(f"{tier.lower()}_count") for tier in TIERS],
        F.countDistinct("repo").alias("unique_repos"),
        F.countDistinct("package_name").alias("unique_packages"),
    )


def portfolio_repos(ranked: DataFrame, n: int = 10) -> DataFrame:
    stats = ranked.filter("repo is not null").groupBy("repo").agg(
        mean4(F.col("risk_score")).alias("avg_risk"),
        F.count("cve_id").alias("cve_count"),
        _critical().alias("critical_count"),
        _share(FIXED).alias("fix_rate"),
    )
    return stats.orderBy(F.desc("avg_risk"), "repo").limit(n)


def portfolio_cwes(ranked: DataFrame, n: int = 10) -> DataFrame:
    """Weaknesses by number of findings; findings without one form the blank group."""
    stats = ranked.filter("primary_cwe is not null").groupBy("primary_cwe").agg(
        F.count("cve_id").alias("count"), _share(FIXED).alias("fix_rate")
    )
    return stats.orderBy(F.desc("count"), "primary_cwe").limit(n).withColumnRenamed("primary_cwe", "cwe")


def portfolio_packages(ranked: DataFrame, n: int = 10) -> DataFrame:
    stats = ranked.filter("package_name is not null").groupBy("package_name").agg(
        F.count("cve_id").alias("count"), mean4(F.col("risk_score")).alias("avg_risk")
    )
    return stats.orderBy(F.desc("count"), "package_name").limit(n).withColumnRenamed("package_name", "package")


def portfolio_top_cves(ranked: DataFrame, n: int = 10) -> DataFrame:
    return by_risk(ranked).limit(n).select("finding_id", "cve_id", "risk_score", "tier", "package_name", "primary_cwe")


def portfolio_compact(ranked: DataFrame) -> DataFrame:
    """The short form as one long table (section, item, measure, tier).

    Three repos by mean risk, five findings by risk, five weaknesses by count;
    scores to three decimals. The columns they need are staged once.
    """
    names = ("finding_id", "cve_id", "repo", "risk_score", "tier", "package_name", "primary_cwe", "user_action")
    ranked = stage(ranked.select(*names), "compact")
    repos = portfolio_repos(ranked, 3).select(
        F.lit("repo").alias("section"), F.col("repo").alias("item"), _round3("avg_risk").alias("measure"), F.col("cve_count").alias("count")
    )
    cves = portfolio_top_cves(ranked, 5).select(
        F.lit("cve"), F.concat_ws(" ", "cve_id", "finding_id"), _round3("risk_score"), F.lit(1).cast("bigint")
    )
    cwes = portfolio_cwes(ranked, 5).select(F.lit("cwe"), "cwe", F.lit(None).cast("double"), "count")
    return repos.union(cves).union(cwes)


def _round3(name: str) -> Column:
    return exact_round(F.col(name), 3)


def repo_catalogue(ranked: DataFrame) -> DataFrame:
    """Every release of every repo beside the totals of the repo.

    One aggregate over (repo, release); the totals are summed from its few rows
    per repo. A repo without releases keeps one row with a null release.
    """
    per_release = ranked.filter("repo is not null").groupBy("repo", "release").agg(
        F.count(F.lit(1)).alias("n"), _critical().alias("critical"), sum4(F.col("risk_score")).alias("risk")
    )
    totals = per_release.groupBy("repo").agg(
        F.sum("n").alias("total_vulns"),
        F.sum("critical").alias("critical_count"),
        exact_round(F.sum("risk") / F.sum("n") / 10000.0, 4).alias("avg_risk"),
        F.count("release").alias("n_releases"),
    )
    joined = per_release.join(totals, "repo").filter("release is not null or n_releases = 0")
    in_release = F.col("release").isNotNull()
    return joined.select(
        "repo",
        "total_vulns",
        "critical_count",
        "avg_risk",
        "release",
        F.when(in_release, F.col("n")).alias("release_total_vulns"),
        F.when(in_release, F.col("critical")).alias("release_critical_count"),
        F.when(in_release, exact_round(F.col("risk") / F.col("n") / 10000.0, 4)).alias("release_avg_risk"),
    ).orderBy("repo", F.desc("release"))
