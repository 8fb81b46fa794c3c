"""Prompt texts assembled from findings, portfolio, releases and model patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from findrisk.functions.numbers import fixed
from findrisk.operators import dashboard, releases
from findrisk.operators.lookup import attach
from findrisk.operators.portfolio_context import attach_portfolio
from findrisk.operators.scoring import TIERS
from findrisk.storage import stage

# Bounds of the divergence between EPSS and CVSS.
EPSS_FAR_ABOVE = 1.5
EPSS_FAR_BELOW = 0.3
HIGH_CVSS = 7.0

NO_VALUE = "N/A"


def percent(column: Column) -> Column:
    """Share as a percentage with one decimal; null reads N/A."""
    return F.coalesce(F.concat(fixed(column * 100.0, 1), F.lit("%")), F.lit(NO_VALUE))


def decimal3(column: Column) -> Column:
    """Three decimals; null reads N/A."""
    return F.coalesce(fixed(column.cast("double"), 3), F.lit(NO_VALUE))


def plain(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(NO_VALUE))


def signed(column: Column) -> Column:
    """Whole number with its sign."""
    return F.format_string("%+d", column.cast("bigint"))


def divergence(cvss: Column, epss: Column) -> Column:
    """"high" if EPSS is far above what CVSS suggests, "low" if far below for a high CVSS, else "none"."""
    scaled = cvss / 10.0
    above = (cvss > 0) & (epss > scaled * EPSS_FAR_ABOVE)
    below = (cvss > 0) & (epss < scaled * EPSS_FAR_BELOW) & (cvss >= HIGH_CVSS)
    return F.when(above, "high").when(below, "low").otherwise("none")


def _lines(*parts: Column | str) -> Column:
    """Lines joined by line breaks; a null line is left out."""
    return F.concat_ws("\n", *[F.lit(part) if isinstance(part, str) else part for part in parts])


def _item(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value)


def _listing(df: DataFrame, order: Sequence[Column], line: Column) -> Column:
    """All lines of a short table (a top list) in order, as one scalar text; "  none" if there are none."""
    entries = df.select(F.struct(*[key.alias(f"k{i}") for i, key in enumerate(order)], line.alias("line")).alias("entry"))
    ordered = F.sort_array(F.collect_list("entry"))
    text = F.array_join(F.transform(ordered, lambda e: e["line"]), "\n")
    return entries.agg(F.coalesce(F.nullif(text, F.lit("")), F.lit("  none"))).scalar()


FINDING_TASK = (
    "Answer under three headings and use only the figures above.",
    "## I. Context: what the weakness is, why the tier may differ from the severity, whether it recurs.",
    "## II. Impact: how easily it is exploited, how old it is, how healthy the repository is.",
    "## III. Remedy: the upgrade to take, its urgency, and what else would reduce the risk.",
)
PORTFOLIO_TASK = (
    "Answer under three headings and use only the figures above.",
    "## I. Context: the overall state, recurring weaknesses, where the risk sits.",
    "## II. Impact: the share of upper tiers, the repositories and packages that matter most.",
    "## III. Remedy: three to five actions in order of the risk they remove.",
)
RELEASE_TASK = (
    "Answer under three headings and use only the figures above.",
    "## I. Context: how the release changed the picture and which weaknesses stayed.",
    "## II. Impact: net change in risk, the worst new findings, the trend of patches and fixes.",
    "## III. Remedy: what to do before the release ships and what to require of the next one.",
)
PATTERN_TASK = ("Say what the leading features tell about risk, what to do about it, and what to doubt in the model.",)


# What a prompt and its figures read of a finding, scores, tier, days and factors apart.
FINDING_COLUMNS = (
    "finding_id", "cve_id", "title", "severity", "cvss_score", "epss_score", "epss_percentile", "primary_cwe", "package_name",
    "package_version", "ecosystem", "repo", "published_date", "transitive_dep_count", "has_patch", "fix_versions", "cve_description", "user_action",
)


_REPO_LABELS = (
    "Findings", "Findings in 30 days", "Fix rate", "False positive rate", "Mean CVSS", "Critical findings", "Packages", "Weaknesses",
)


def _repo_figures(stats: DataFrame) -> DataFrame:
    """The figures of a repository as printed, in one text of a line each: printed once per repository, not once per finding."""
    printed = (
        plain(F.col("repo_total_cves")), plain(F.col("repo_cve_count_30d")), percent(F.col("repo_fix_rate")),
        percent(F.col("repo_false_positive_rate")), decimal3(F.col("repo_avg_cvss")), plain(F.col("repo_critical_count")),
        plain(F.col("repo_unique_packages")), plain(F.col("repo_unique_cwes")),
    )
    return stats.select("repo", F.col("repo_total_cves").alias("_rows"), _lines(*printed).alias("_repo"))


def finding_prompts(findings: DataFrame, ranked: DataFrame) -> DataFrame:
    """One prompt per finding.

    ``findings`` holds the canonical columns, scores, tier and
    ``days_since_published``, and may hold ``factors``, an array of (name,
    value); ``ranked`` is the table the repository and portfolio figures come
    from, read once per figure, so pass a staged table. The figures are attached by key; the findings are not shuffled unless
    there are too many keys to broadcast.
    """
    names = ("finding_id", "repo", "risk_score", "tier", "primary_cwe", "package_name", "user_action", "cvss_score")
    ranked = ranked.select(*names)
    facts = attach(findings, _repo_figures(dashboard.repo_stats(ranked)), "repo", weight="_rows", spread_by=F.col("finding_id"))
    facts = attach_portfolio(facts, ranked).withColumn("_figures", F.split("_repo", "\n"))

    kind = divergence(F.col("cvss_score"), F.col("epss_score"))
    note = (
        F.when(kind == "high", "Note: exploitation is far more likely than the severity suggests.")
        .when(kind == "low", "Note: the severity is high, yet exploitation is rare.")
    )
    factor_lines: Column = F.lit("  (none given)")
    if "factors" in findings.columns:
        listed = F.transform(
            "factors",
            lambda p: F.concat(
                F.lit("  - "), p["name"], F.lit(": "), fixed(p["value"], 4, sign=True),
                F.when(p["value"] > 0, " (increases risk)").otherwise(" (decreases risk)"),
            ),
        )
        factor_lines = F.coalesce(F.array_join(listed, "\n"), factor_lines)
    direct = F.when(F.col("transitive_dep_count") == 0, "direct").otherwise("transitive")
    fixes = F.when(F.coalesce(F.col("fix_versions"), F.lit("")) != "", F.col("fix_versions")).otherwise("none known")
    prompt = _lines(
        "# Finding",
        _item("CVE", plain(F.col("cve_id"))),
        _item("Title", plain(F.col("title"))),
        _item("Severity", plain(F.col("severity"))),
        _item("CVSS score", fixed(F.col("cvss_score"), 1)),
        _item("EPSS score", fixed(F.col("epss_score"), 4)),
        _item("EPSS percentile", fixed(F.col("epss_percentile"), 4)),
        _item("Weakness", plain(F.col("primary_cwe"))),
        F.concat(F.lit("Package: "), plain(F.col("package_name")), F.lit(" "), plain(F.col("package_version")), F.lit(" ("), plain(F.col("ecosystem")), F.lit(")")),
        _item("Repository", plain(F.col("repo"))),
        _item("Published", F.coalesce(F.date_format("published_date", "yyyy-MM-dd"), F.lit(NO_VALUE))),
        _item("Days since published", plain(F.col("days_since_published"))),
        note,
        "# Model",
        _item("Risk score", decimal3(F.col("risk_score"))),
        _item("Tier", plain(F.col("tier"))),
        _item("Model probability", decimal3(F.col("ml_score"))),
        "Largest factors:",
        factor_lines,
        "# Dependency",
        F.concat(_item("Transitive dependencies", plain(F.col("transitive_dep_count"))), F.lit(" ("), direct, F.lit(")")),
        _item("Patch available", F.when(F.col("has_patch") != 0, "yes").otherwise("no")),
        _item("Fixed in", fixes),
        "# Repository",
        *[_item(label, plain(F.get("_figures", F.lit(i)))) for i, label in enumerate(_REPO_LABELS)],
        "# Portfolio",
        _item("Findings", plain(F.col("total_vulnerabilities"))),
        _item("Mean risk", decimal3(F.col("avg_risk_score"))),
        _item("CRITICAL", plain(F.col("critical_count"))),
        _item("HIGH", plain(F.col("high_count"))),
        _item("Same weakness", plain(F.col("same_cwe_count"))),
        _item("Same package", plain(F.col("same_pkg_count"))),
        "# Description",
        F.when(F.coalesce(F.col("cve_description"), F.lit("")) != "", F.col("cve_description")).otherwise("No description."),
        "# Task",
        *FINDING_TASK,
    )
    return facts.select("finding_id", prompt.alias("prompt"))


def portfolio_prompt(ranked: DataFrame) -> DataFrame:
    """One prompt about the whole portfolio: totals and four top-ten lists."""
    ranked = stage(ranked, "ranked")
    repos = dashboard.portfolio_repos(ranked)
    cves = dashboard.portfolio_top_cves(ranked)
    cwes = dashboard.portfolio_cwes(ranked)
    packages = dashboard.portfolio_packages(ranked)
    repo_line = F.concat(
        F.lit("  - "), "repo", F.lit(": mean risk "), decimal3(F.col("avg_risk")), F.lit(", findings "), F.col("cve_count").cast("string"),
        F.lit(", critical "), F.col("critical_count").cast("string"), F.lit(", fix rate "), percent(F.col("fix_rate")),
    )
    cve_line = F.concat(
        F.lit("  - "), "cve_id", F.lit(": "), decimal3(F.col("risk_score")), F.lit(" ("), "tier", F.lit("), package "),
        plain(F.col("package_name")), F.lit(", weakness "), plain(F.col("primary_cwe")),
    )
    cwe_line = F.concat(F.lit("  - "), "cwe", F.lit(": "), F.col("count").cast("string"), F.lit(" findings, fix rate "), percent(F.col("fix_rate")))
    package_line = F.concat(
        F.lit("  - "), "package", F.lit(": "), F.col("count").cast("string"), F.lit(" findings, mean risk "), decimal3(F.col("avg_risk"))
    )
    totals = dashboard.portfolio_totals(ranked)
    prompt = _lines(
        "# Portfolio",
        _item("Findings", plain(F.col("total_vulnerabilities"))),
        _item("Mean risk", decimal3(F.col("avg_risk_score"))),
        *[_item(tier, plain(F.col(f"{tier.lower()}_count"))) for tier in TIERS],
        _item("Repositories", plain(F.col("unique_repos"))),
        _item("Packages", plain(F.col("unique_packages"))),
        "# Riskiest repositories",
        _listing(repos, [-F.col("avg_risk"), F.col("repo")], repo_line),
        "# Riskiest findings",
        _listing(cves, [-F.col("risk_score"), F.col("finding_id")], cve_line),
        "# Frequent weaknesses",
        _listing(cwes, [-F.col("count"), F.col("cwe")], cwe_line),
        "# Most affected packages",
        _listing(packages, [-F.col("count"), F.col("package")], package_line),
        "# Task",
        *PORTFOLIO_TASK,
    )
    return totals.select(prompt.alias("prompt"))


def _per_group(df: DataFrame, keys: Sequence[str], line: Column, name: str) -> DataFrame:
    """Lines of a table already cut to a few ranked rows per group, joined in rank order."""
    entries = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(entries, lambda e: e["line"]), "\n").alias(name))


def _cwe_names(df: DataFrame, name: str) -> DataFrame:
    """All weaknesses of a repo in one line, in order; ``df`` holds each once per repo."""
    return df.groupBy("repo").agg(F.array_join(F.sort_array(F.collect_list("cwe")), ", ").alias(name))


def release_prompts(ranked: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One prompt per comparable repo: both releases, the change, and what came and went."""
    rows = releases.compared_rows(ranked, pairs)
    keys = ["repo", "release"]
    cve_line = F.concat(
        F.lit("  - "), "cve_id", F.lit(": "), decimal3(F.col("risk_score")), F.lit(" ("), "tier", F.lit("), package "),
        plain(F.col("package_name")), F.lit(", weakness "), plain(F.col("primary_cwe")),
    )
    cwe_line = F.concat(F.lit("  - "), "cwe", F.lit(": "), F.col("count").cast("string"))
    package_line = F.concat(
        F.lit("  - "), "package", F.lit(": "), F.col("count").cast("string"), F.lit(", mean risk "), decimal3(F.col("avg_risk"))
    )
    # read by both blocks of a repo and by the change
    stats = stage(releases.compared_stats(rows), "release-stats")
    blocks = (
        stats
        .join(_per_group(releases.release_top_cves(rows), keys, cve_line, "cves"), keys, "left")
        .join(_per_group(releases.release_top_cwes(rows), keys, cwe_line, "cwes"), keys, "left")
        .join(_per_group(releases.release_top_packages(rows), keys, package_line, "packages"), keys, "left")
    )
    block = _lines(
        _item("Findings", plain(F.col("total_vulns"))),
        _item("Mean risk", decimal3(F.col("avg_risk_score"))),
        _item("Highest risk", decimal3(F.col("max_risk_score"))),
        *[_item(tier, plain(F.col(f"{tier.lower()}_count"))) for tier in TIERS],
        _item("Patch rate", percent(F.col("patch_rate"))),
        _item("Fix rate", percent(F.col("fix_rate"))),
        _item("Packages", plain(F.col("unique_packages"))),
        "Riskiest findings:", F.coalesce("cves", F.lit("  none")),
        "Frequent weaknesses:", F.coalesce("cwes", F.lit("  none")),
        "Most affected packages:", F.coalesce("packages", F.lit("  none")),
    )
    texts = blocks.select("repo", "release", block.alias("block"), "avg_risk_score")
    change_line = F.concat(
        F.lit("  - "), "cve_id", F.lit(": "), decimal3(F.col("risk_score")), F.lit(" ("), "tier", F.lit("), package "), plain(F.col("package_name"))
    )
    current = texts.select("repo", F.col("release").alias("current_release"), F.col("block").alias("now_block"), F.col("avg_risk_score").alias("now_risk"))
    previous = texts.select("repo", F.col("release").alias("previous_release"), F.col("block").alias("then_block"), F.col("avg_risk_score").alias("then_risk"))
    whole = (
        releases.release_delta(rows, stats=stats)
        .join(current, ["repo", "current_release"], "left")
        .join(previous, ["repo", "previous_release"], "left")
        .join(_per_group(releases.new_cves(rows), ["repo"], change_line, "new_lines"), "repo", "left")
        .join(_per_group(releases.resolved_cves(rows), ["repo"], change_line, "resolved_lines"), "repo", "left")
        .join(_cwe_names(releases.new_cwes(rows), "new_cwe_names"), "repo", "left")
        .join(_cwe_names(releases.resolved_cwes(rows), "resolved_cwe_names"), "repo", "left")
    )
    prompt = _lines(
        _item("# Repository", F.col("repo")),
        _item("# Current release", F.col("current_release")),
        F.col("now_block"),
        _item("# Previous release", F.col("previous_release")),
        F.col("then_block"),
        "# Change",
        F.concat(_item("Findings", signed(F.col("vuln_count_change"))), F.lit(" ("), percent(F.col("vuln_count_change_pct")), F.lit(")")),
        F.concat(
            _item("Mean risk", decimal3(F.col("avg_risk_change"))), F.lit(" (from "), decimal3(F.col("then_risk")), F.lit(" to "), decimal3(F.col("now_risk")), F.lit(")")
        ),
        _item("CRITICAL", signed(F.col("critical_change"))),
        _item("HIGH", signed(F.col("high_change"))),
        _item("Patch rate", percent(F.col("patch_rate_change"))),
        _item("New CVEs", plain(F.col("new_cve_count"))),
        F.coalesce("new_lines", F.lit("  none")),
        _item("Resolved CVEs", plain(F.col("resolved_cve_count"))),
        F.coalesce("resolved_lines", F.lit("  none")),
        _item("New weaknesses", F.coalesce("new_cwe_names", F.lit("none"))),
        _item("Resolved weaknesses", F.coalesce("resolved_cwe_names", F.lit("none"))),
        "# Task",
        *RELEASE_TASK,
    )
    return whole.select("repo", "current_release", "previous_release", prompt.alias("prompt"))


def pattern_prompt(importance: DataFrame, n: int = 15) -> DataFrame:
    """One prompt about the most important features of a model."""
    top = importance.orderBy(F.desc("importance"), "feature").limit(n)
    entries = F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("order"), "feature")))
    lines = F.transform(
        entries, lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e["feature"], F.lit(": "), fixed(-e["order"], 4))
    )
    return top.agg(_lines("# Feature importance", F.array_join(lines, "\n"), "# Task", *PATTERN_TASK).alias("prompt"))
