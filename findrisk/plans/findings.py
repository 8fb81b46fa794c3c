"""Findings derived from the given order tables, for Spark and for the checking SQL.

One finding per order line. Each expression is valid in both dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from findrisk.functions.cvss import METRICS, normal_vector, vector_flags
from findrisk.operators.canonical import canonicalize
from findrisk.operators.features import exploit_known
from findrisk.operators.scoring import hybrid_score
from findrisk.session import spread

AS_OF = "2001-08-10 12:00:00"

FINDING_COLUMNS = {
    "finding_id": "concat_ws('-', cast(l_orderkey as varchar(20)), cast(l_linenumber as varchar(20)), cast(l_partkey as varchar(20)), cast(l_suppkey as varchar(20)), l_returnflag, l_linestatus, cast(cast(l_quantity as int) as varchar(20)))",
    "cve_id": "concat('CVE-', cast(2019 + l_partkey % 6 as varchar(20)), '-', cast(10000 + l_partkey as varchar(20)))",
    "title": "concat(case when l_orderkey % 50 = 0 then 'Withdrawn Advisory: ' else '' end, 'Issue in ', p_name)",
    "repo": "concat('repo-', cast(l_suppkey as varchar(20)))",
    "release": "concat('v', cast(l_linenumber as varchar(20)), '.0.0')",
    "package_name": "p_name",
    "package_version": "concat(case when l_linenumber % 3 = 0 then 'v' else '' end, cast(p_size % 5 as varchar(20)), '.', cast(l_partkey % 30 as varchar(20)), case when l_linenumber % 5 = 0 then '' else concat('.', cast(l_orderkey % 15 as varchar(20))) end, case when l_linenumber % 4 = 0 then '-beta' else '' end)",
    "ecosystem": "case p_size % 10 when 0 then 'npm' when 1 then 'pypi' when 2 then 'maven' when 3 then 'go' when 4 then 'nuget' when 5 then 'rubygems' when 6 then 'cargo' when 7 then 'composer' when 8 then 'NPM ' else '' end",
    "severity": "case o_orderpriority when '1-URGENT' then 'critical' when '2-HIGH' then 'HIGH' when '3-MEDIUM' then ' Medium ' when '5-LOW' then 'LOW' else 'none' end",
    "cvss_score": "case when l_orderkey % 97 = 0 then null else l_quantity / cast(5 as double) end",
    "cvss_vector": "case when l_orderkey % 17 = 0 then '' when l_orderkey % 19 = 0 then 'CVSS:3.1' else concat(case when l_linenumber = 1 then '' else 'CVSS:3.1/' end, 'AV:', substr('NLAP', cast(1 + l_orderkey % 4 as int), 1), '/AC:', substr('LH', cast(1 + l_partkey % 2 as int), 1), '/PR:', substr('NLH', cast(1 + l_suppkey % 3 as int), 1), '/UI:', substr('RN', cast(1 + l_partkey % 2 as int), 1), '/S:', substr('CU', cast(1 + l_suppkey % 2 as int), 1), '/C:', substr('NLH', cast(1 + l_partkey % 3 as int), 1), '/I:', substr('NLX', cast(1 + l_orderkey % 3 as int), 1), '/a:h') end",
    "epss_score": "l_discount * cast(10 as double)",
    "epss_percentile": "l_tax * cast(12.5 as double)",
    "published_date": "case when l_orderkey % 89 = 0 then null else o_orderdate end",
    "modified_date": "greatest(o_orderdate, l_shipdate)",
    "detection_time": "l_shipdate",
    "has_patch": "case when l_linestatus = 'F' then 1 else 0 end",
    "fix_versions": "case when l_linestatus = 'F' then concat(cast(1 + l_partkey % 7 as varchar(20)), '.', cast(l_partkey % 20 as varchar(20)), '.', cast(l_suppkey % 9 as varchar(20)), case when l_linenumber % 2 = 0 then ', 9.0.0-rc1' else '' end) else '' end",
    "cwes": "case l_partkey % 8 when 0 then '' when 1 then 'CWE-79' when 2 then 'CWE-89, CWE-79' when 3 then '787' when 4 then 'cwe-862' when 5 then 'CWE-502,CWE-20' when 6 then 'CWE-327,bogus' else 'CWE-287,CWE-352,CWE-22' end",
    "cve_description": "case l_partkey % 6 when 0 then '' when 1 then 'An attacker can EXPLOIT the parser' when 2 then 'Remote Code Execution via crafted input' when 3 then 'An RCE was found; DoS also possible' when 4 then 'Denial of service in windows dosbox mode' else 'forced  double  spaces' end",
    "references": "case when l_orderkey % 5 = 0 then 'https://x.example/Exploit/1,https://a.example' else 'https://a.example' end",
    "num_references": "l_linenumber",
    "sources": "case l_suppkey % 4 when 0 then 'OSV, GitHub, NVD' when 1 then 'GitHub, NVD' when 2 then 'NVD' else '' end",
    "transitive_dep_count": "cast(l_orderkey % 6 as int)",
    "num_affected_ranges": "cast(l_linenumber % 4 as int)",
    "user_action": "case when l_orderkey % 13 = 0 then 'monitoring' when l_returnflag = 'R' then case l_linenumber % 4 when 0 then 'fixed' when 1 then 'Remediated' when 2 then 'patched' else 'accepted' end when l_returnflag = 'A' then case l_linenumber % 3 when 0 then 'skipped' when 1 then 'ignored' else 'deferred' end else case l_linenumber % 2 when 0 then 'false_positive' else 'False Positive' end end",
    "status": "case when l_returnflag = 'R' then 'resolved' when l_orderkey % 101 = 0 then 'WITHDRAWN' else 'open' end",
    "licence": "case p_size % 5 when 0 then 'MIT' when 1 then 'Apache-2.0' when 2 then 'BSD-3-Clause' when 3 then 'ISC' else 'GPL-3.0' end",
    "repo_criticality": "case l_suppkey % 4 when 0 then cast(1.0 as double) when 1 then cast(0.5 as double) when 2 then cast(0.3 as double) else cast(null as double) end",
    # A supplied model probability, so every tier occurs without training.
    "model_score": "cast((l_orderkey * 31 + l_partkey * 17) % 1001 as double) / cast(1000 as double)",
}


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings table as a scanner would deliver it."""
    read = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
    lines, orders, parts = spread(read("lineitem"), "l_orderkey"), read("orders"), read("part")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
    return joined.selectExpr(*[f"{expression} as `{name}`" for name, expression in FINDING_COLUMNS.items()])


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonicalize(findings(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical findings with score and tier, from the supplied model probability."""
    return score_canonical(canonical(spark, sf_dir))


def score_canonical(table: DataFrame) -> DataFrame:
    """Add only the three features the score reads, then the score itself."""
    prepared = table.withColumn("_vector", normal_vector(table["cvss_vector"]))
    flags = vector_flags(prepared["_vector"])
    inputs = {name: flags[name] for name in ("attack_vector_network", "privileges_required_none")}
    inputs["is_exploit_known"] = exploit_known(prepared)
    return hybrid_score(prepared.withColumns(inputs).drop("_vector"), ml_score="model_score")


# ---------------------------------------------------------------- checking SQL

_BLANK = "' ' || chr(9) || chr(10) || chr(13)"


def _trim(expression: str) -> str:
    return f"trim({expression}, {_BLANK})"


def parts_sql(expression: str) -> str:
    """Non-blank entries of a comma-separated list."""
    return f"list_filter(list_transform(string_split(coalesce({expression}, ''), ','), lambda p: {_trim('p')}), lambda p: p <> '')"


FINDINGS_SQL = "findings AS (SELECT {} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)".format(
    ", ".join(f'{expression} AS "{name}"' for name, expression in FINDING_COLUMNS.items())
)

CANONICAL_SQL = f"""canonical AS (SELECT * REPLACE (
    CASE WHEN upper({_trim('severity')}) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN upper({_trim('severity')}) ELSE 'UNKNOWN' END AS severity,
    coalesce(cvss_score, 0.0) AS cvss_score,
    lower({_trim('user_action')}) AS user_action),
  '' AS vuln_id, '' AS purl, '' AS patch_recommendation, CAST(NULL AS TIMESTAMP) AS release_date,
  len({parts_sql('cwes')}) AS cwe_count,
  coalesce(({parts_sql('cwes')})[1], '') AS primary_cwe,
  len({parts_sql('sources')}) AS num_sources,
  CASE WHEN lower(title) LIKE '%withdrawn%' OR lower(status) LIKE '%withdrawn%' THEN 1 ELSE 0 END AS is_withdrawn,
  CASE upper({_trim('severity')}) WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS severity_numeric
  FROM findings)"""


def _flag_list() -> str:
    segments = (
        "list_transform(string_split(upper(coalesce(cvss_vector, '')), '/'), "
        "lambda s: trim(split_part(s, ':', 1)) || ':' || trim(substr(s, strpos(s, ':') + 1)))"
    )
    return f"{segments} AS segments"


SEGMENTS_SQL = f"segmented AS (SELECT *, {_flag_list()} FROM canonical)"
FLAG_SQL = {
    f"{prefix}_{word}": f"CAST(list_contains(segments, '{key}:{code}') AS INTEGER)"
    for key, prefix, _, values in METRICS
    for code, word in values
}

_EXPOSURE = (
    f"0.4 * {FLAG_SQL['attack_vector_network']}::DOUBLE + 0.3 * {FLAG_SQL['privileges_required_none']}::DOUBLE + 0.3 * is_exploit_known::DOUBLE"
)

SCORED_SQL = f"""exploits AS (SELECT *, CASE WHEN lower("references") LIKE '%exploit%' OR num_references > 5 THEN 1 ELSE 0 END AS is_exploit_known FROM segmented),
parts_of_score AS (SELECT * REPLACE (coalesce(repo_criticality, 0.5::DOUBLE) AS repo_criticality),
  model_score AS ml_score,
  least(greatest(cvss_score, 0), 10) / 10::DOUBLE AS normalized_cvss,
  least(greatest(epss_percentile, 0), 1) AS normalized_epss,
  least(greatest({_EXPOSURE}, 0), 1) AS exposure_score
  FROM exploits),
weighted AS (SELECT *,
  0.45::DOUBLE * ml_score + 0.2::DOUBLE * normalized_cvss + 0.15::DOUBLE * normalized_epss + 0.1::DOUBLE * exposure_score + 0.1::DOUBLE * repo_criticality AS blended
  FROM parts_of_score),
capped AS (SELECT *, CASE WHEN is_withdrawn = 1 THEN least(blended, 0.1::DOUBLE) ELSE blended END AS after_cap FROM weighted),
floored AS (SELECT *, least(greatest(CASE WHEN cvss_score >= 9 AND exposure_score > 0.5 THEN greatest(after_cap, 0.85::DOUBLE) ELSE after_cap END, 0), 1) AS exact_score FROM capped),
scored AS (SELECT *, exact_score AS risk_score,
  CASE WHEN exact_score > 0.8::DOUBLE THEN 'CRITICAL' WHEN exact_score > 0.6::DOUBLE THEN 'HIGH' WHEN exact_score > 0.4::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS tier
  FROM floored)"""


def round4_sql(expression: str) -> str:
    return f"(round_even(({expression}) * 10000, 0) / 10000)"


def printed_sql(expression: str, digits: int) -> str:
    """Rounded as number printing does."""
    return f"CAST(printf('%.{digits}f', {expression}) AS DOUBLE)"


RANKED_SQL = f"""ranked AS (SELECT finding_id, cve_id, severity, package_name, repo, cvss_score, epss_score,
  {round4_sql('ml_score')} AS ml_score, {round4_sql('risk_score')} AS risk_score, tier,
  cve_description, primary_cwe, user_action, release, has_patch FROM scored)"""

_LAYERS = {
    "findings": [FINDINGS_SQL],
    "canonical": [CANONICAL_SQL],
    "segmented": [SEGMENTS_SQL],
    "scored": [SCORED_SQL],
    "ranked": [RANKED_SQL],
}


def on(layer: str, body: str) -> str:
    """SQL whose WITH list reaches up to ``layer``; ``body`` starts with further tables or SELECT."""
    tables: list[str] = []
    for name, definitions in _LAYERS.items():
        tables += definitions
        if name == layer:
            break
    joiner = "\n" if body.lstrip().upper().startswith("SELECT") else ",\n"
    return "WITH " + ",\n".join(tables) + joiner + body.strip()
