"""Prompt texts and answer sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from findrisk.functions.dates import elapsed_days, moment
from findrisk.operators import prompts
from findrisk.operators.responses import section_responses
from findrisk.operators.scoring import PARTS, TIERS, ranked_table, score_terms
from findrisk.plans.findings import AS_OF, on, scored
from findrisk.plans.registry import query
from findrisk.plans.release_queries import _SIDES_SQL, _STATS_SQL
from findrisk.plans.score_queries import ranked
from findrisk.storage import stage

_KIND_SQL = """CASE WHEN cvss_score > 0 AND epss_score > cvss_score / 10.0::DOUBLE * 1.5::DOUBLE THEN 'high'
  WHEN cvss_score > 0 AND epss_score < cvss_score / 10.0::DOUBLE * 0.3::DOUBLE AND cvss_score >= 7 THEN 'low' ELSE 'none' END"""


@query("divergence_flags", on("canonical", f"SELECT finding_id, {_KIND_SQL} AS divergence FROM canonical"))
def divergence_flags_query(spark, sf_dir):
    table = ranked(spark, sf_dir)
    return table.select("finding_id", prompts.divergence(F.col("cvss_score"), F.col("epss_score")).alias("divergence"))


# ------------------------------------------------- prompts as SQL, line by line

_MEAN = "sum(CAST(round_even(risk_score * 10000, 0) AS BIGINT))::DOUBLE / count(*) / 10000"
_FIX = "count(*) FILTER (user_action = 'fixed')::DOUBLE / count(*)"
_CRITICAL = "count(*) FILTER (tier = 'CRITICAL')"


def _f(expression: str, digits: int = 3) -> str:
    return f"coalesce(printf('%.{digits}f', {expression}), 'N/A')"


def _pct(expression: str) -> str:
    return f"coalesce(printf('%.1f%%', ({expression}) * 100), 'N/A')"


def _num(expression: str) -> str:
    return f"coalesce(CAST({expression} AS VARCHAR), 'N/A')"


def _text(*lines: str) -> str:
    """Lines joined by line breaks; a line that is no expression of its own is given in quotes."""
    return f"concat_ws(chr(10), {', '.join(lines)})"


def _labelled(label: str, expression: str) -> str:
    return f"'{label}: ' || {expression}"


def _quoted(lines) -> list[str]:
    return ["'" + line.replace("'", "''") + "'" for line in lines]


_FACTORS = " || chr(10) || ".join(
    f"'  - {name}: ' || printf('%+.4f', {weight}::DOUBLE * {column}) || CASE WHEN {column} > 0 THEN ' (increases risk)' ELSE ' (decreases risk)' END"
    for name, weight, column in (
        ("ml", 0.45, "ml_score"), ("cvss", 0.2, "normalized_cvss"), ("epss", 0.15, "normalized_epss"),
        ("exposure", 0.1, "exposure_score"), ("repo_criticality", 0.1, "repo_criticality"),
    )
)
_FINDING_SQL = _text(
    "'# Finding'",
    _labelled("CVE", "cve_id"), _labelled("Title", "title"), _labelled("Severity", "severity"),
    _labelled("CVSS score", _f("cvss_score", 1)), _labelled("EPSS score", _f("epss_score", 4)), _labelled("EPSS percentile", _f("epss_percentile", 4)),
    _labelled("Weakness", "primary_cwe"),
    "'Package: ' || package_name || ' ' || package_version || ' (' || ecosystem || ')'",
    _labelled("Repository", "s.repo"),
    _labelled("Published", "coalesce(strftime(published_date, '%Y-%m-%d'), 'N/A')"),
    _labelled("Days since published", f"greatest(coalesce(date_sub('day', published_date, TIMESTAMP '{AS_OF}'), 0), 0)"),
    f"CASE {_KIND_SQL} WHEN 'high' THEN 'Note: exploitation is far more likely than the severity suggests.' WHEN 'low' THEN 'Note: the severity is high, yet exploitation is rare.' END",
    "'# Model'", _labelled("Risk score", _f("risk_score")), _labelled("Tier", "tier"), _labelled("Model probability", _f("ml_score")),
    "'Largest factors:'", _FACTORS,
    "'# Dependency'",
    "'Transitive dependencies: ' || transitive_dep_count || CASE WHEN transitive_dep_count = 0 THEN ' (direct)' ELSE ' (transitive)' END",
    _labelled("Patch available", "CASE WHEN has_patch <> 0 THEN 'yes' ELSE 'no' END"),
    _labelled("Fixed in", "CASE WHEN fix_versions <> '' THEN fix_versions ELSE 'none known' END"),
    "'# Repository'", _labelled("Findings", "r.n"), _labelled("Findings in 30 days", "r.n"), _labelled("Fix rate", _pct("r.fix")),
    _labelled("False positive rate", _pct("r.fp")), _labelled("Mean CVSS", _f("r.cvss")), _labelled("Critical findings", "r.crit"),
    _labelled("Packages", "r.pkgs"), _labelled("Weaknesses", "r.cwes"),
    "'# Portfolio'", _labelled("Findings", "t.n"), _labelled("Mean risk", _f("t.m")), _labelled("CRITICAL", "t.crit"), _labelled("HIGH", "t.high"),
    _labelled("Same weakness", _num("c.n")), _labelled("Same package", _num("p.n")),
    "'# Description'", "CASE WHEN cve_description <> '' THEN cve_description ELSE 'No description.' END",
    "'# Task'", *_quoted(prompts.FINDING_TASK),
)


@query(
    "finding_prompt",
    on("ranked", f"""r AS (SELECT repo, count(*) AS n, {_FIX} AS fix, count(*) FILTER (user_action = 'false_positive')::DOUBLE / count(*) AS fp,
  sum(cvss_score::DECIMAL(18,8))::DOUBLE / count(cvss_score) AS cvss, {_CRITICAL} AS crit, count(DISTINCT package_name) AS pkgs, count(DISTINCT primary_cwe) AS cwes FROM ranked GROUP BY repo),
t AS (SELECT count(*) AS n, {_MEAN} AS m, {_CRITICAL} AS crit, count(*) FILTER (tier = 'HIGH') AS high FROM ranked),
c AS (SELECT primary_cwe AS k, count(*) AS n FROM ranked WHERE primary_cwe <> '' GROUP BY primary_cwe),
p AS (SELECT package_name AS k, count(*) AS n FROM ranked WHERE package_name <> '' GROUP BY package_name)
SELECT finding_id, {_FINDING_SQL} AS prompt FROM scored s JOIN r ON s.repo = r.repo LEFT JOIN c ON c.k = primary_cwe LEFT JOIN p ON p.k = package_name, t"""),
)
def finding_prompt_query(spark, sf_dir):
    """Prompts whose factors are the terms of the score; the scored table serves as facts and as ranked table."""
    names = (*prompts.FINDING_COLUMNS, "risk_score", "tier", *PARTS.values())
    table = stage(scored(spark, sf_dir).select(*names), "scored")
    terms = [F.struct(F.lit(name).alias("name"), term.alias("value")) for name, term in score_terms().items()]
    facts = table.withColumns(
        {"days_since_published": elapsed_days(moment(AS_OF), F.col("published_date")), "factors": F.array(*terms)}
    )
    return prompts.finding_prompts(facts, ranked_table(table))


def _top_sql(select: str, order: str, line: str, limit: int = 10) -> str:
    """A top list as one text."""
    return f"(SELECT string_agg({line}, chr(10) ORDER BY {order}) FROM (SELECT * FROM ({select}) ORDER BY {order} LIMIT {limit}))"


_PORTFOLIO_SQL = _text(
    "'# Portfolio'", _labelled("Findings", "n"), _labelled("Mean risk", _f("m")),
    *[_labelled(tier, tier.lower()) for tier in TIERS], _labelled("Repositories", "repos"), _labelled("Packages", "pkgs"),
    "'# Riskiest repositories'",
    _top_sql(
        f"SELECT repo, {_MEAN} AS m, count(cve_id) AS n, {_CRITICAL} AS crit, {_FIX} AS fix FROM ranked GROUP BY repo", "m DESC, repo",
        f"'  - ' || repo || ': mean risk ' || {_f('m')} || ', findings ' || n || ', critical ' || crit || ', fix rate ' || {_pct('fix')}",
    ),
    "'# Riskiest findings'",
    _top_sql(
        "SELECT * FROM ranked", "risk_score DESC, finding_id",
        f"'  - ' || cve_id || ': ' || {_f('risk_score')} || ' (' || tier || '), package ' || package_name || ', weakness ' || primary_cwe",
    ),
    "'# Frequent weaknesses'",
    _top_sql(
        f"SELECT primary_cwe AS cwe, count(cve_id) AS n, {_FIX} AS fix FROM ranked GROUP BY primary_cwe", "n DESC, cwe",
        f"'  - ' || cwe || ': ' || n || ' findings, fix rate ' || {_pct('fix')}",
    ),
    "'# Most affected packages'",
    _top_sql(
        f"SELECT package_name AS package, count(cve_id) AS n, {_MEAN} AS m FROM ranked GROUP BY package_name", "n DESC, package",
        f"'  - ' || package || ': ' || n || ' findings, mean risk ' || {_f('m')}",
    ),
    "'# Task'", *_quoted(prompts.PORTFOLIO_TASK),
)


@query(
    "portfolio_prompt",
    on("ranked", f"""t AS (SELECT count(*) AS n, {_MEAN} AS m, {', '.join(f"count(*) FILTER (tier = '{t}') AS {t.lower()}" for t in TIERS)},
  count(DISTINCT repo) AS repos, count(DISTINCT package_name) AS pkgs FROM ranked)
SELECT {_PORTFOLIO_SQL} AS prompt FROM t"""),
)
def portfolio_prompt_query(spark, sf_dir):
    return prompts.portfolio_prompt(ranked(spark, sf_dir))


_BLOCK_SQL = _text(
    _labelled("Findings", "total_vulns"), _labelled("Mean risk", _f("avg_risk_score")), _labelled("Highest risk", _f("max_risk_score")),
    *[_labelled(tier, f"{tier.lower()}_count") for tier in TIERS],
    _labelled("Patch rate", _pct("patch_rate")), _labelled("Fix rate", _pct("fix_rate")), _labelled("Packages", "unique_packages"),
    "'Riskiest findings:'", "cves", "'Frequent weaknesses:'", "cwes", "'Most affected packages:'", "packages",
)
_CHANGE_LINE = f"'  - ' || cve_id || ': ' || {_f('risk_score')} || ' (' || tier || '), package ' || package_name"


def _ranked_lines(name: str, source: str, order: str, line: str, keys: str, limit: int) -> str:
    return f"""{name} AS (SELECT {keys}, string_agg({line}, chr(10) ORDER BY k) AS lines FROM
  (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS k FROM {source}) WHERE k <= {limit} GROUP BY {keys})"""


_RELEASE_SQL = _text(
    _labelled("# Repository", "p.repo"), _labelled("# Current release", "p.current_release"), "c.block",
    _labelled("# Previous release", "p.previous_release"), "v.block", "'# Change'",
    f"'Findings: ' || printf('%+d', c.total_vulns - v.total_vulns) || ' (' || {_pct('(c.total_vulns - v.total_vulns)::DOUBLE / greatest(v.total_vulns, 1)')} || ')'",
    f"'Mean risk: ' || {_f('c.avg_risk_score - v.avg_risk_score')} || ' (from ' || {_f('v.avg_risk_score')} || ' to ' || {_f('c.avg_risk_score')} || ')'",
    "'CRITICAL: ' || printf('%+d', c.critical_count - v.critical_count)", "'HIGH: ' || printf('%+d', c.high_count - v.high_count)",
    _labelled("Patch rate", _pct("c.patch_rate - v.patch_rate")),
    "'New CVEs: ' || coalesce(came.n, 0)", "coalesce(new_lines.lines, '  none')",
    "'Resolved CVEs: ' || coalesce(went.n, 0)", "coalesce(old_lines.lines, '  none')",
    "'New weaknesses: ' || coalesce(new_cwe.names, 'none')", "'Resolved weaknesses: ' || coalesce(old_cwe.names, 'none')",
    "'# Task'", *_quoted(prompts.RELEASE_TASK),
)


def _only_in(mine: str, other: str, column: str) -> str:
    return f"(SELECT repo, {column} FROM {mine} EXCEPT SELECT repo, {column} FROM {other})"


def _missing_in(mine: str, other: str) -> str:
    return f"(SELECT * FROM {mine} m WHERE NOT EXISTS (SELECT 1 FROM {other} o WHERE o.repo = m.repo AND o.cve_id = m.cve_id))"


@query(
    "release_prompt",
    on("ranked", f"""{_SIDES_SQL}, {_STATS_SQL},
{_ranked_lines('top_cves', 'ranked', 'risk_score DESC, finding_id', f"'  - ' || cve_id || ': ' || {_f('risk_score')} || ' (' || tier || '), package ' || package_name || ', weakness ' || primary_cwe", 'repo, release', 5)},
{_ranked_lines('top_cwes', '(SELECT repo, release, primary_cwe, count(cve_id) AS n FROM ranked GROUP BY ALL)', 'n DESC, primary_cwe', "'  - ' || primary_cwe || ': ' || n", 'repo, release', 5)},
{_ranked_lines('top_packages', f'(SELECT repo, release, package_name, count(cve_id) AS n, {_MEAN} AS m FROM ranked GROUP BY repo, release, package_name)', 'n DESC, package_name', f"'  - ' || package_name || ': ' || n || ', mean risk ' || {_f('m')}", 'repo, release', 5)},
whole AS (SELECT stats.*, top_cves.lines AS cves, top_cwes.lines AS cwes, top_packages.lines AS packages FROM stats
  JOIN top_cves USING (repo, release) JOIN top_cwes USING (repo, release) JOIN top_packages USING (repo, release)),
blocks AS (SELECT *, {_BLOCK_SQL} AS block FROM whole),
came AS (SELECT repo, count(*) AS n FROM {_only_in('cur', 'prev', 'cve_id')} GROUP BY repo),
went AS (SELECT repo, count(*) AS n FROM {_only_in('prev', 'cur', 'cve_id')} GROUP BY repo),
{_ranked_lines('new_lines', _missing_in('cur', 'prev'), 'risk_score DESC, finding_id', _CHANGE_LINE, 'repo', 10)},
{_ranked_lines('old_lines', _missing_in('prev', 'cur'), 'risk_score DESC, finding_id', _CHANGE_LINE, 'repo', 10)},
new_cwe AS (SELECT repo, string_agg(primary_cwe, ', ' ORDER BY primary_cwe) AS names FROM {_only_in('cur', 'prev', 'primary_cwe')} GROUP BY repo),
old_cwe AS (SELECT repo, string_agg(primary_cwe, ', ' ORDER BY primary_cwe) AS names FROM {_only_in('prev', 'cur', 'primary_cwe')} GROUP BY repo)
SELECT p.repo, p.current_release, p.previous_release, {_RELEASE_SQL} AS prompt FROM pairs p
JOIN blocks c ON c.repo = p.repo AND c.release = p.current_release JOIN blocks v ON v.repo = p.repo AND v.release = p.previous_release
LEFT JOIN came ON came.repo = p.repo LEFT JOIN went ON went.repo = p.repo
LEFT JOIN new_lines ON new_lines.repo = p.repo LEFT JOIN old_lines ON old_lines.repo = p.repo
LEFT JOIN new_cwe ON new_cwe.repo = p.repo LEFT JOIN old_cwe ON old_cwe.repo = p.repo"""),
)
def release_prompt_query(spark, sf_dir):
    return prompts.release_prompts(ranked(spark, sf_dir))


# Answers made from conversation turns: all headings, one heading, repeated headings, none.
_ANSWER = """concat(text, case turn % 4
  when 0 then concat(chr(10), '## I. Context', chr(10), role, chr(10), chr(10), text, chr(10), '### **Impact and health**', chr(10), 'seen in ', role, chr(10), '## III. Remedy', chr(10), text)
  when 1 then concat(chr(10), ' ## Remedy  ', chr(10), text, chr(10), '## II. More', chr(10), 'x', chr(10), '**iii. again', chr(10), 'y', chr(10))
  when 2 then concat(chr(10), '## impact', chr(10), chr(10), '  ', chr(10))
  else '' end)"""


def _mark_sql(*marks: str) -> str:
    return " OR ".join(f"contains(low, '{mark}')" for mark in marks)


_WS = "' ' || chr(9) || chr(10) || chr(13)"


@query(
    "response_sections",
    f"""WITH answers AS (SELECT conv_id, turn, {_ANSWER} AS answer FROM conversations),
lines AS (SELECT conv_id, turn, answer, unnest(string_split(trim(answer, {_WS}), chr(10))) AS line, generate_subscripts(string_split(trim(answer, {_WS}), chr(10)), 1) AS i FROM answers),
marked AS (SELECT *, lower(line) AS low FROM lines),
named AS (SELECT *, CASE WHEN {_mark_sql('## i.', '## context', '# context', '**i.', '**context')} THEN 'context'
  WHEN {_mark_sql('## ii.', '## impact', '# impact', '**ii.', '**impact')} THEN 'impact'
  WHEN {_mark_sql('## iii.', '## remedy', '# remedy', '**iii.', '**remedy')} THEN 'remedy' END AS heading FROM marked),
placed AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY i) AS section FROM named),
joined AS (SELECT conv_id, turn, any_value(answer) AS answer, count(*) FILTER (heading IS NULL AND section IS NOT NULL) AS kept,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (heading IS NULL AND section = 'context'), '') AS context,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (heading IS NULL AND section = 'impact'), '') AS impact,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (heading IS NULL AND section = 'remedy'), '') AS remedy FROM placed GROUP BY conv_id, turn)
SELECT conv_id, turn, trim(CASE WHEN kept = 0 THEN answer ELSE context END, {_WS}) AS context, trim(impact, {_WS}) AS impact, trim(remedy, {_WS}) AS remedy FROM joined""",
)
def response_sections_query(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    answers = turns.select("conv_id", "turn", F.expr(_ANSWER.replace("chr(10)", "char(10)")).alias("answer"))
    return section_responses(answers, "answer", ("conv_id", "turn"))
