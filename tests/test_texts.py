import pytest
from pyspark.sql import functions as F

from findrisk.operators import prompts
from findrisk.operators.responses import section_responses


@pytest.mark.parametrize("cvss, epss, kind", [(5.0, 0.8, "high"), (8.0, 0.1, "low"), (6.9, 0.1, "none"), (0.0, 0.9, "none"), (5.0, 0.75, "none")])
def test_divergence(one, cvss, epss, kind):
    assert one(c=cvss, e=epss).select(prompts.divergence(F.col("c"), F.col("e")).alias("k")).first().k == kind


def test_number_formats(spark):
    row = spark.sql("select 0.12345D a, cast(null as double) b, 3 n").select(
        prompts.percent(F.col("a")), prompts.decimal3(F.col("a")), prompts.percent(F.col("b")), prompts.decimal3(F.col("b")), prompts.signed(F.col("n")), prompts.signed(-F.col("n"))
    ).first()
    assert tuple(row) == ("12.3%", "0.123", "N/A", "N/A", "+3", "-3")


def sections(one, text):
    row = section_responses(one(answer=text), "answer", ("finding_id",)).first()
    return row.context, row.impact, row.remedy


def test_three_sections(one):
    text = "intro\n## I. Context\na\n\nb\n## II. Impact\nc\n**III. Remedy**\n  d\n"
    assert sections(one, text) == ("a\n\nb", "c", "d")


def test_repeated_section_is_continued(one):
    assert sections(one, "# Remedy\nx\n# Impact\ny\n## remedy\nz") == ("", "y", "x\nz")


@pytest.mark.parametrize("text", ["plain text\nof two lines", "## I. Context"])
def test_without_sections_all_is_context(one, text):
    assert sections(one, text) == (text, "", "")


def test_pattern_prompt_lists_the_first_features_in_order(spark):
    table = spark.createDataFrame([(f"f{i:02d}", i / 100) for i in range(20)], "feature string, importance double")
    lines = prompts.pattern_prompt(table).first().prompt.split("\n")
    assert lines[1] == "1. f19: 0.1900" and lines[15] == "15. f05: 0.0500" and lines[16] == "# Task"


def test_portfolio_prompt_of_an_empty_table(spark):
    schema = "finding_id string, cve_id string, repo string, package_name string, primary_cwe string, tier string, risk_score double, user_action string"
    text = prompts.portfolio_prompt(spark.createDataFrame([], schema)).first().prompt
    assert "Mean risk: N/A" in text and "  none" in text


def test_finding_prompt(spark):
    findings = spark.sql(
        "select 'f1' finding_id, 'CVE-1' cve_id, 'T' title, 'HIGH' severity, 8.0D cvss_score, 0.1D epss_score, 0.2D epss_percentile, '' primary_cwe,"
        " 'p' package_name, '1.0' package_version, 'npm' ecosystem, 'r' repo, timestamp'2024-01-01' published_date, 12 days_since_published, 0.5D risk_score,"
        " 'MEDIUM' tier, 0.25D ml_score, 0 transitive_dep_count, 1 has_patch, '' fix_versions, cast(null as string) cve_description, 'fixed' user_action,"
        " array(named_struct('name', 'a', 'value', -0.5D)) factors"
    )
    text = prompts.finding_prompts(findings, findings).first().prompt
    for line in (
        "CVE: CVE-1", "Package: p 1.0 (npm)", "Published: 2024-01-01", "Note: the severity is high, yet exploitation is rare.", "  - a: -0.5000 (decreases risk)",
        "Transitive dependencies: 0 (direct)", "Fixed in: none known", "Fix rate: 100.0%", "Same weakness: N/A", "Same package: 1", "No description.",
    ):
        assert line in text.split("\n"), line


def test_finding_prompt_prints_repository_figures_once_per_repository(spark, monkeypatch):
    rows = (
        "select * from values ('f1', 'r', 6.0D), ('f2', 'r', 8.0D), ('f3', cast(null as string), 2.0D) as t(finding_id, repo, cvss_score)"
    )
    findings = spark.sql(
        "select *, 'CVE-1' cve_id, 'T' title, 'HIGH' severity, 0.1D epss_score, 0.2D epss_percentile, 'CWE-1' primary_cwe, 'p' package_name,"
        " '1.0' package_version, 'npm' ecosystem, timestamp'2024-01-01' published_date, 12 days_since_published, 0.5D risk_score, 'MEDIUM' tier,"
        f" 0.25D ml_score, 0 transitive_dep_count, 1 has_patch, '' fix_versions, '' cve_description, 'fixed' user_action from ({rows})"
    )
    attached = {}
    monkeypatch.setattr(
        prompts, "attach", lambda facts, stats, key, f=prompts.attach, **k: attached.update({key: stats.dtypes}) or f(facts, stats, key, **k)
    )
    found = {row.finding_id: row.prompt.split("\n") for row in prompts.finding_prompts(findings, findings).collect()}
    assert attached["repo"] == [("repo", "string"), ("_rows", "bigint"), ("_repo", "string")]
    part = lambda lines: lines[lines.index("# Repository") + 1 : lines.index("# Portfolio")]
    assert part(found["f1"]) == part(found["f2"]) == [
        "Findings: 2", "Findings in 30 days: 2", "Fix rate: 100.0%", "False positive rate: 0.0%", "Mean CVSS: 7.000",
        "Critical findings: 0", "Packages: 1", "Weaknesses: 1",
    ]
    assert all(line.endswith(": N/A") for line in part(found["f3"])) and len(part(found["f3"])) == 8
