"""Canonical schema, labels and the feature blocks."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession, functions as F

from findrisk.functions import cvss, cwe
from findrisk.operators import features, profiles
from findrisk.operators.assembly import FEATURE_NAMES, align_features, feature_matrix
from findrisk.operators.canonical import CANONICAL_COLUMNS, create_label, drop_unlabelled
from findrisk.operators.embeddings import VECTOR_NAMES
from findrisk.operators.training import prepare_training
from findrisk.plans.findings import AS_OF, FINDING_COLUMNS, FLAG_SQL, canonical, findings, on, parts_sql
from findrisk.plans.registry import query, settle_sql, settled
from findrisk.sources.columns import normalize_columns
from findrisk.sources.profile import dataset_profile

_DAY = "yyyy-MM-dd HH:mm:ss"
_DATES = ("published_date", "modified_date", "release_date", "detection_time")


def _plain(df: DataFrame) -> DataFrame:
    """Timestamps as text, so both engines print them alike."""
    return df.select(
        *[F.date_format(name, _DAY).alias(name) if name in _DATES else F.col(name) for name in df.columns]
    )


def _plain_sql(names) -> str:
    return ", ".join(f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}" if name in _DATES else f'"{name}"' for name in names)


# ------------------------------------------------------------- normalisation

_RAW_HEADERS = {
    "finding_id": "finding_id", "Repository ": "repo", " Release_Name": "release", "CVE ID": "cve_id",
    "Severity": "severity", "User Actions": "user_action", "Transitive Dependencies": "transitive_deps_text",
    "CVSS Score": "cvss_text", "EPSSScore": "epss_text", "Last Detected In Repo": "detected_text",
    "CVE- Weaknesses(CWE)": "cwes", "Sources(NVD, OSV...)": "sources", "Extra Column": "ecosystem",
    "License": "licence_or_null", "Licence": "licence",
}
_RAW_VALUES = {
    "transitive_deps_text": "case when transitive_dep_count = 5 then 'n/a' else cast(transitive_dep_count as varchar(20)) end",
    "cvss_text": "case when cvss_score is null then 'unknown' else cast(cast(cvss_score as decimal(4,1)) as varchar(20)) end",
    "epss_text": "cast(cast(epss_score as decimal(6,2)) as varchar(20))",
    "detected_text": "case when num_references = 3 then 'not a date' else substr(cast(detection_time as varchar(40)), 1, 10) end",
    "licence_or_null": "case when licence = 'MIT' then cast(null as varchar(20)) else 'License: ' || licence end",
}


def raw_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as a hand-made export: free header spelling, all values text."""
    table = findings(spark, sf_dir).withColumns({name: F.expr(rule) for name, rule in _RAW_VALUES.items()})
    return table.select(*[F.col(name).alias(header) for header, name in _RAW_HEADERS.items()])


@query(
    "normalize_columns",
    on("findings", """
SELECT finding_id, repo, release, cve_id, upper(trim(severity)) AS severity, lower(user_action) AS user_action,
  CASE WHEN transitive_dep_count = 5 THEN 0 ELSE transitive_dep_count END AS transitive_dep_count,
  CAST(CAST(cvss_score AS DECIMAL(4,1)) AS DOUBLE) AS cvss_score, CAST(CAST(epss_score AS DECIMAL(6,2)) AS DOUBLE) AS epss_score,
  CASE WHEN num_references = 3 THEN NULL ELSE strftime(detection_time, '%Y-%m-%d 00:00:00') END AS detection_time,
  cwes, sources, ecosystem AS "extra column",
  CASE WHEN licence = 'MIT' THEN licence ELSE 'License: ' || licence END AS licence
FROM findings"""),
)
def normalize_columns_query(spark, sf_dir):
    return _plain(normalize_columns(raw_headers(spark, sf_dir)))


@query(
    "canonicalize",
    on("canonical", f"SELECT finding_id, {_plain_sql(CANONICAL_COLUMNS)}, severity_numeric FROM canonical"),
)
def canonicalize_query(spark, sf_dir):
    return _plain(canonical(spark, sf_dir).select("finding_id", *CANONICAL_COLUMNS, "severity_numeric"))


_LABEL_SQL = """CASE WHEN user_action IN ('fixed', 'remediated', 'patched', 'accepted') THEN 1
  WHEN user_action IN ('false_positive', 'false positive', 'skipped', 'ignored', 'deferred') THEN 0 END"""


@query("create_label", on("canonical", f"SELECT finding_id, user_action, {_LABEL_SQL} AS label FROM canonical"))
def create_label_query(spark, sf_dir):
    return create_label(canonical(spark, sf_dir)).select("finding_id", "user_action", "label")


@query(
    "drop_unlabelled",
    on("canonical", f"SELECT finding_id, {_LABEL_SQL} AS label FROM canonical WHERE {_LABEL_SQL} IS NOT NULL"),
)
def drop_unlabelled_query(spark, sf_dir):
    return drop_unlabelled(create_label(canonical(spark, sf_dir))).select("finding_id", "label")


@query(
    "dataset_profile",
    on("canonical", f"""
SELECT 'records' AS item, '' AS value, count(*) AS n FROM canonical
UNION ALL SELECT 'repos', '', count(DISTINCT repo) FROM canonical
UNION ALL SELECT 'columns', '', {len(CANONICAL_COLUMNS)} + 6
UNION ALL SELECT 'severity', severity, count(*) FROM canonical GROUP BY severity
UNION ALL SELECT 'user_action', user_action, count(*) FROM canonical GROUP BY user_action
UNION ALL SELECT 'ecosystem', ecosystem, count(*) FROM canonical GROUP BY ecosystem"""),
)
def dataset_profile_query(spark, sf_dir):
    return dataset_profile(canonical(spark, sf_dir))


# ------------------------------------------------------------ row-local blocks


def _days_sql(later: str, earlier: str) -> str:
    return f"greatest(coalesce(date_sub('day', {earlier}, {later}), 0), 0)"


_NOW = f"TIMESTAMP '{AS_OF}'"

CORE_SQL = f"""severity_numeric, cvss_score, epss_score, epss_percentile,
  {_days_sql(_NOW, 'published_date')} AS days_since_published, {_days_sql(_NOW, 'modified_date')} AS days_since_modified,
  is_withdrawn, has_patch, num_references, num_sources"""
FLAGS_SQL = ", ".join(f"{expression} AS {name}" for name, expression in FLAG_SQL.items())


def _block(spark, sf_dir, block):
    return features.row_features(canonical(spark, sf_dir), AS_OF, [block])


@query("features_cve_core", on("segmented", f"SELECT finding_id, {CORE_SQL} FROM segmented"))
def cve_core_query(spark, sf_dir):
    names = [name for name in features.CVE_CORE_NAMES if name not in cvss.FLAG_NAMES]
    return _block(spark, sf_dir, "cve_core").select("finding_id", *names)


@query("features_cvss_flags", on("segmented", f"SELECT finding_id, {FLAGS_SQL} FROM segmented"))
def cvss_flags_query(spark, sf_dir):
    return _block(spark, sf_dir, "cve_core").select("finding_id", *cvss.FLAG_NAMES)


_METRIC_WORDS = {
    "cvss_attack_vector": "case l_orderkey % 5 when 0 then 'Network' when 1 then ' LOCAL ' when 2 then 'Adjacent' when 3 then 'physical' else '' end",
    "cvss_attack_complexity": "case l_partkey % 3 when 0 then 'Low' when 1 then 'HIGH' else 'medium' end",
    "cvss_privileges_required": "case l_suppkey % 4 when 0 then 'None' when 1 then 'Low' when 2 then 'High' else cast(null as varchar(10)) end",
    "cvss_user_interaction": "case l_linenumber % 3 when 0 then 'Required' when 1 then 'None' else '?' end",
    "cvss_scope": "case l_partkey % 2 when 0 then 'Changed' else 'Unchanged' end",
    "cvss_confidentiality": "case l_orderkey % 3 when 0 then 'None' when 1 then 'Low' else 'High' end",
    "cvss_integrity": "case l_suppkey % 3 when 0 then 'None' when 1 then 'Low' else 'High' end",
    "cvss_availability": "case l_linenumber % 4 when 0 then 'None' when 1 then 'Low' else 'High' end",
}
_ID = FINDING_COLUMNS["finding_id"]
_METRIC_SQL = "WITH words AS (SELECT {} AS finding_id, {} FROM lineitem) SELECT finding_id, {} FROM words".format(
    _ID,
    ", ".join(f"{rule} AS {name}" for name, rule in _METRIC_WORDS.items()),
    ", ".join(
        f"CASE WHEN lower(trim({source})) = '{word}' THEN 1 ELSE 0 END AS {prefix}_{word}"
        for _, prefix, source, values in cvss.METRICS
        for _, word in values
    ),
)


@query("features_cvss_metrics", _METRIC_SQL)
def cvss_metrics_query(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    words = lines.selectExpr(f"{_ID} as finding_id", *[f"{rule} as {name}" for name, rule in _METRIC_WORDS.items()])
    return features.metric_word_features(words)


CWE_IDS_SQL = f"""weakness_ids AS (SELECT *, list_distinct(list_filter(list_transform({parts_sql('cwes')},
  lambda p: TRY_CAST(replace(replace(upper(p), 'CWE-', ''), 'CWE', '') AS INTEGER)), lambda i: i IS NOT NULL)) AS ids FROM segmented)"""


def _best(values: dict[int, float]) -> str:
    entries = ", ".join(f"{cwe_id}: {value}" for cwe_id, value in values.items())
    return f"CAST(coalesce(list_max(list_transform(ids, lambda i: coalesce(map_extract(MAP {{{entries}}}, i)[1], 0))), 0) AS DOUBLE)"


_LABELS = ", ".join(f"'CWE-{cwe_id}': {code}" for cwe_id, code in cwe.LABEL_CODE.items())
CWE_SQL = ", ".join(
    ["len(ids) AS cwe_count"]
    + [f"CAST(list_contains(ids, {i}) AS INTEGER) AS is_cwe_{i}" for i in cwe.INDICATOR_IDS]
    + [f"CAST(list_has_any(ids, [{', '.join(map(str, family))}]) AS INTEGER) AS {name}" for name, family in cwe.FAMILIES.items()]
    + [
        f"{_best(cwe.EXPLOIT_RATE)} AS cwe_historical_exploit_rate",
        f"{_best(cwe.GLOBAL_FREQUENCY)} AS cwe_global_frequency",
        f"coalesce(map_extract(MAP {{{_LABELS}}}, upper(trim(primary_cwe)))[1], 0) AS cwe_primary_encoded",
    ]
)


@query("features_cwe", on("segmented", f"{CWE_IDS_SQL} SELECT finding_id, {CWE_SQL} FROM weakness_ids"))
def cwe_query(spark, sf_dir):
    return _block(spark, sf_dir, "cwe")


def _part_sql(text: str, position: int) -> str:
    plain = f"regexp_extract(regexp_replace(trim({text}), '^[vV]+', ''), '^[^-+_ ]*')"
    return f"coalesce(TRY_CAST(split_part({plain}, '.', {position}) AS BIGINT), 0)"


_FIX = f"coalesce(({parts_sql('fix_versions')})[1], '')"
VERSIONS_SQL = f"first_fix AS (SELECT *, {_FIX} AS fix FROM segmented)"


def _gap_sql(position: int) -> str:
    return f"CASE WHEN fix = '' THEN 0 ELSE greatest({_part_sql('fix', position)} - {_part_sql('package_version', position)}, 0) END"


GAPS_SQL = f"""{_gap_sql(1)} AS version_gap_major, {_gap_sql(2)} AS version_gap_minor, {_gap_sql(3)} AS version_gap_patch,
  CASE WHEN {_gap_sql(1)} > 0 THEN 1 ELSE 0 END AS is_major_upgrade"""
DEPENDENCY_SQL = f"""transitive_dep_count AS dependency_depth, CAST(transitive_dep_count = 0 AS INTEGER) AS is_direct_dependency,
  CAST(transitive_dep_count > 0 AS INTEGER) AS is_transitive_dependency, transitive_dep_count,
  {GAPS_SQL}, len({parts_sql('fix_versions')}) AS num_fix_versions, num_affected_ranges,
  CAST(trim(fix_versions) <> '' AS INTEGER) AS has_fix_available,
  {', '.join(f"CAST(lower(trim(ecosystem)) = '{name}' AS INTEGER) AS package_ecosystem_{name}" for name in features.ECOSYSTEMS)}"""
_GAP_NAMES = ("version_gap_major", "version_gap_minor", "version_gap_patch", "is_major_upgrade")


@query("features_version_gap", on("segmented", f"{VERSIONS_SQL} SELECT finding_id, package_version, fix_versions, {GAPS_SQL} FROM first_fix"))
def version_gap_query(spark, sf_dir):
    table = features.row_features(canonical(spark, sf_dir), AS_OF, ["dependency"], keep=("finding_id", "package_version", "fix_versions"))
    return table.select("finding_id", "package_version", "fix_versions", *_GAP_NAMES)


@query("features_dependency", on("segmented", f"{VERSIONS_SQL} SELECT finding_id, {DEPENDENCY_SQL} FROM first_fix"))
def dependency_query(spark, sf_dir):
    return _block(spark, sf_dir, "dependency")


TIME_BASE_SQL = f"""timed AS (SELECT *, {_days_sql('detection_time', 'published_date')} AS delay, {_days_sql(_NOW, 'published_date')} AS age FROM segmented)"""
TIME_SQL = f"""delay AS detection_delay_days, age AS cve_age_days, {_days_sql(_NOW, 'detection_time')} AS days_since_detection,
  CASE WHEN has_patch > 0 THEN delay ELSE 0 END AS patch_available_delay,
  CASE WHEN has_patch > 0 THEN 0 ELSE age END AS exposure_window_days,
  CAST(age <= 30 AS INTEGER) AS is_recent_cve, CAST(age > 365 AS INTEGER) AS is_old_cve,
  CAST(lower("references") LIKE '%exploit%' OR num_references > 5 AS INTEGER) AS is_exploit_known,
  CASE WHEN has_patch > 0 THEN {_days_sql(_NOW, 'modified_date')} ELSE 0 END AS patch_age_days,
  {settle_sql("least(delay::DOUBLE / greatest(age, 1), 10)")} AS time_to_patch_ratio,
  {settle_sql("least(epss_score / (cvss_score / 10.0::DOUBLE + 0.001::DOUBLE), 100)")} AS epss_cvss_ratio,
  {settle_sql("epss_score * (1.0::DOUBLE / (age + 1))")} AS risk_acceleration,
  severity_numeric * age AS severity_age_interaction,
  {settle_sql("least(num_sources / 4.0::DOUBLE, 1)")} AS source_diversity,
  {settle_sql("num_references::DOUBLE / (age + 1)")} AS reference_density"""


@query("features_time", on("segmented", f"{TIME_BASE_SQL} SELECT finding_id, {TIME_SQL} FROM timed"))
def time_query(spark, sf_dir):
    return settled(_block(spark, sf_dir, "time"))


def _text_sql(column: str) -> str:
    low = f"lower(coalesce({column}, ''))"
    return f"""length(coalesce({column}, '')) AS description_length,
  len(regexp_extract_all(coalesce({column}, ''), '[^\\p{{Z}}\\s\\x0b\\x1c-\\x1f\\x85]+')) AS description_word_count,
  CAST(contains({low}, 'exploit') AS INTEGER) AS description_has_exploit_mention,
  CAST(contains({low}, 'remote code execution') OR regexp_matches({low}, '(^|[^\\pL\\pN\\pM_])rce($|[^\\pL\\pN\\pM_])') AS INTEGER) AS description_has_rce_mention,
  CAST(contains({low}, 'denial of service') OR regexp_matches({low}, '(^|[^\\pL\\pN\\pM_])dos($|[^\\pL\\pN\\pM_])') AS INTEGER) AS description_has_dos_mention"""


TEXT_SQL = _text_sql("cve_description")


@query("features_text", on("segmented", f"SELECT finding_id, {TEXT_SQL} FROM segmented"))
def text_query(spark, sf_dir):
    return _block(spark, sf_dir, "text")


@query("features_text_documents", f"SELECT doc_id, {_text_sql('text')} FROM documents")
def text_documents_query(spark, sf_dir):
    """The same signals on whole multilingual documents."""
    return features.text_features(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", ["doc_id"])


# -------------------------------------------------------------- grouped blocks

PACKAGE_SQL = """package_stats AS (SELECT package_name, count(*) AS package_name_frequency, count(DISTINCT cve_id) AS package_name_cve_density,
  sum(fixed) AS fixed_p, sum(skipped) AS skipped_p, sum(fp) AS fp_p FROM acted GROUP BY package_name)"""
ACTED_SQL = """acted AS (SELECT *, CASE WHEN user_action IN ('fixed', 'remediated', 'patched') THEN 1 ELSE 0 END AS fixed,
  CASE WHEN user_action = 'skipped' THEN 1 ELSE 0 END AS skipped,
  CASE WHEN user_action IN ('false_positive', 'false positive') THEN 1 ELSE 0 END AS fp FROM segmented)"""
_R = settle_sql
REPO_SQL = f"""newest AS (SELECT max(published_date) AS newest FROM acted),
repo_stats AS (SELECT repo, count(*) AS repo_total_cves,
  count(*) FILTER (published_date >= newest - INTERVAL 30 DAY) AS repo_cve_count_30d,
  count(*) FILTER (published_date >= newest - INTERVAL 90 DAY) AS repo_cve_count_90d,
  count(*) FILTER (severity = 'CRITICAL') AS repo_critical_count, count(*) FILTER (severity = 'HIGH') AS repo_high_count,
  count(*) FILTER (severity = 'MEDIUM') AS repo_medium_count, count(*) FILTER (severity = 'LOW') AS repo_low_count,
  {_R("sum(fixed)::DOUBLE / count(*)")} AS repo_fix_rate,
  {_R("count(*) FILTER (user_action = 'false_positive')::DOUBLE / count(*)")} AS repo_false_positive_rate,
  {_R("sum(skipped)::DOUBLE / count(*)")} AS repo_skip_rate,
  {_R("avg(cvss_score)")} AS repo_avg_cvss, {_R("max(cvss_score)")} AS repo_max_cvss, {_R("avg(epss_score)")} AS repo_avg_epss,
  {_R("count(*) FILTER (severity = 'CRITICAL')::DOUBLE / count(*)")} AS repo_severity_ratio_critical,
  {_R("count(*) FILTER (severity = 'HIGH')::DOUBLE / count(*)")} AS repo_severity_ratio_high,
  count(DISTINCT package_name) AS repo_unique_packages, count(DISTINCT primary_cwe) AS repo_unique_cwes,
  {_R("avg(has_patch)")} AS repo_has_patch_rate, {_R("avg(transitive_dep_count)")} AS repo_avg_transitive_deps,
  {_R("CASE WHEN count(*) = 1 THEN 1 ELSE coalesce(count(*)::DOUBLE / greatest(date_sub('day', min(published_date), max(published_date)) + 1, 1), 0) END")} AS repo_cve_velocity,
  count(DISTINCT user_action) AS repo_actions, sum(fixed) AS fixed_r, sum(skipped) AS skipped_r, sum(fp) AS fp_r
  FROM acted, newest GROUP BY repo)"""
CWE_STATS_SQL = "cwe_stats AS (SELECT primary_cwe, count(*) AS n_c, sum(fixed) AS fixed_c, sum(skipped) AS skipped_c, sum(fp) AS fp_c FROM acted GROUP BY primary_cwe)"
SEVERITY_STATS_SQL = "severity_stats AS (SELECT severity, count(*) AS n_s, sum(fixed) AS fixed_s, sum(skipped) AS skipped_s, sum(fp) AS fp_s FROM acted GROUP BY severity)"
ACTIONS_SQL = "all_actions AS (SELECT count(DISTINCT user_action) AS distinct_actions FROM acted)"
_JOINS = """acted JOIN package_stats USING (package_name) JOIN repo_stats USING (repo)
  JOIN cwe_stats USING (primary_cwe) JOIN severity_stats USING (severity), all_actions"""
_GROUPS = {"cwe": ("c", "n_c"), "package": ("p", "package_name_frequency"), "severity": ("s", "n_s"), "repo": ("r", "repo_total_cves")}


def _rate(kind: str, group: str, out: bool) -> str:
    letter, rows = _GROUPS[group]
    if out:
        return _R(f"CASE WHEN {rows} > 1 THEN ({kind}_{letter} - {kind})::DOUBLE / ({rows} - 1) ELSE 0 END")
    return _R(f"{kind}_{letter}::DOUBLE / {rows}")


def _std(group: str) -> str:
    letter, rows = _GROUPS[group]
    hits = f"fixed_{letter}::DOUBLE"
    return _R(f"CASE WHEN {rows} > 1 THEN sqrt({hits} * ({rows} - {hits}) / ({rows}::DOUBLE * ({rows} - 1))) ELSE 0 END")


def _history_sql(out: bool) -> str:
    rates = [
        f"{_rate(kind, group, out)} AS historical_{label}_rate_same_{group}"
        for group in _GROUPS
        for kind, label in (("fixed", "fix"), ("skipped", "skip"), ("fp", "fp"))
    ]
    return ", ".join(
        rates
        + [
            f"{_std('cwe')} AS cwe_action_consistency",
            f"{_std('package')} AS package_action_consistency",
            f"{_R('repo_actions::DOUBLE / greatest(distinct_actions, 1)')} AS repo_action_diversity",
            f"{_rate('fixed', 'severity', out)} AS severity_action_alignment",
        ]
    )


_STATS_SQL = ",\n".join([ACTED_SQL, PACKAGE_SQL, REPO_SQL, CWE_STATS_SQL, SEVERITY_STATS_SQL, ACTIONS_SQL])


@query(
    "features_package_stats",
    on("segmented", f"{_STATS_SQL} SELECT finding_id, package_name_frequency, package_name_cve_density FROM {_JOINS}"),
)
def package_stats_query(spark, sf_dir):
    return profiles.grouped_features(canonical(spark, sf_dir), ["package"])


@query("features_repo", on("segmented", f"{_STATS_SQL} SELECT finding_id, {', '.join(profiles.REPO_NAMES)} FROM {_JOINS}"))
def repo_query(spark, sf_dir):
    return settled(profiles.grouped_features(canonical(spark, sf_dir), ["repo"]))


@query("features_user_behavior", on("segmented", f"{_STATS_SQL} SELECT finding_id, {_history_sql(False)} FROM {_JOINS}"))
def user_behavior_query(spark, sf_dir):
    return settled(profiles.grouped_features(canonical(spark, sf_dir), ["user"]))


@query("features_user_behavior_loo", on("segmented", f"{_STATS_SQL} SELECT finding_id, {_history_sql(True)} FROM {_JOINS}"))
def user_behavior_loo_query(spark, sf_dir):
    return settled(profiles.grouped_features(canonical(spark, sf_dir), ["user"], leave_one_out=True))


# ------------------------------------------------------------------- assembly

# The whole matrix: every block over the same rows, each in its own table.
MATRIX_TABLES_SQL = f"""{_STATS_SQL},
{CWE_IDS_SQL}, {VERSIONS_SQL}, {TIME_BASE_SQL},
m_core AS (SELECT finding_id, {CORE_SQL}, {FLAGS_SQL} FROM segmented),
m_cwe AS (SELECT finding_id, {CWE_SQL} FROM weakness_ids),
m_dep AS (SELECT finding_id, {DEPENDENCY_SQL} FROM first_fix),
m_time AS (SELECT finding_id, {TIME_SQL} FROM timed),
m_text AS (SELECT finding_id, {TEXT_SQL} FROM segmented),
m_group AS (SELECT finding_id, package_name_frequency, package_name_cve_density, {', '.join(profiles.REPO_NAMES)}, {_history_sql(False)} FROM {_JOINS}),
matrix AS (SELECT * FROM m_core JOIN m_cwe USING (finding_id) JOIN m_dep USING (finding_id) JOIN m_time USING (finding_id)
  JOIN m_text USING (finding_id) JOIN m_group USING (finding_id))"""
_MATRIX_LIST = ", ".join(
    f"{settle_sql(name)} AS {name}" if name in ("cvss_score", "epss_score", "epss_percentile", "cwe_historical_exploit_rate", "cwe_global_frequency") else name
    for name in FEATURE_NAMES
)


@query("feature_matrix", on("segmented", f"{MATRIX_TABLES_SQL} SELECT finding_id, {_MATRIX_LIST} FROM matrix"))
def feature_matrix_query(spark, sf_dir):
    return settled(feature_matrix(canonical(spark, sf_dir), AS_OF))


_LABELLED_SQL = f"labelled_rows AS (SELECT *, {_LABEL_SQL} AS label FROM segmented WHERE {_LABEL_SQL} IS NOT NULL)"


@query(
    "training_matrix",
    on("segmented", f"""{_LABELLED_SQL}, {MATRIX_TABLES_SQL.replace('FROM segmented', 'FROM labelled_rows')}
SELECT finding_id, label, {_MATRIX_LIST} FROM matrix JOIN (SELECT finding_id, label FROM labelled_rows) USING (finding_id)"""),
)
def training_matrix_query(spark, sf_dir):
    """Features of labelled findings: group statistics see no other rows."""
    return settled(prepare_training(findings(spark, sf_dir), AS_OF).drop("published_date"))


@query(
    "feature_matrix_vectors",
    on("segmented", f"""vector_of AS (SELECT finding_id, CAST(substr(cve_id, 10) AS BIGINT) % (SELECT count(*) FROM embeddings) AS vec_id, length(cve_description) AS description_length FROM segmented),
weights AS (SELECT vec_id, count(*) AS n FROM vector_of GROUP BY vec_id),
cells AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT i, sum(n * x) / sum(n) AS m FROM cells JOIN weights USING (vec_id) GROUP BY i),
energies AS (SELECT vec_id, {settle_sql('sum((x - m) * (x - m))')} AS energy FROM cells JOIN means USING (i) GROUP BY vec_id)
SELECT finding_id, description_length, energy, 229 AS features FROM vector_of JOIN energies USING (vec_id)"""),
)
def feature_matrix_vectors_query(spark, sf_dir):
    """The matrix with reduced text vectors, shown by their squared length."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    table = canonical(spark, sf_dir).withColumn("vec_id", F.substring("cve_id", 10, 20).cast("bigint") % vectors.count())
    matrix = feature_matrix(table.join(vectors.select("vec_id", "embedding"), "vec_id"), AS_OF, vectors="embedding")
    energy = reduce(add, [F.col(name) * F.col(name) for name in VECTOR_NAMES])
    return settled(
        matrix.select("finding_id", "description_length", energy.alias("energy"), F.lit(len(matrix.columns) - 1).alias("features"))
    )


# A model that was trained on some known and one unknown column, in its own order.
CONTRACT = ("is_exploit_known", "feature_from_the_past", "version_gap_major", "attack_vector_network", "description_length")


@query(
    "feature_align",
    on("segmented", f"""{VERSIONS_SQL}, {TIME_BASE_SQL}, t AS (SELECT finding_id, {TIME_SQL} FROM timed)
SELECT finding_id, is_exploit_known, 0 AS feature_from_the_past, version_gap_major, attack_vector_network, description_length
FROM (SELECT finding_id, {GAPS_SQL}, {FLAGS_SQL}, {TEXT_SQL} FROM first_fix) JOIN t USING (finding_id)"""),
)
def feature_align_query(spark, sf_dir):
    table = features.row_features(canonical(spark, sf_dir), AS_OF)
    return align_features(table, CONTRACT, keep=("finding_id",))
