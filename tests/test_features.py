import pytest
from conftest import AS_OF
from pyspark.sql import functions as F

from findrisk.functions.cvss import FLAG_NAMES
from findrisk.functions.text import strip, text_or_blank
from findrisk.operators import features, profiles
from findrisk.operators.assembly import FEATURE_NAMES, align_features, feature_matrix
from findrisk.operators.canonical import canonicalize


def row_of(one, block, **values):
    return features.row_features(canonicalize(one(**values)), AS_OF, [block]).first()


def test_one_flag_per_metric_of_a_well_formed_vector(one):
    row = row_of(one, "cve_core", cvss_vector="CVSS:3.1/AV:N/AC:H/PR:N/UI:R/S:U/C:L/I:L/a : h")
    on = {name for name in FLAG_NAMES if row[name]}
    assert on == {
        "attack_vector_network", "attack_complexity_high", "privileges_required_none", "user_interaction_required",
        "scope_unchanged", "confidentiality_low", "integrity_low", "availability_high",
    }


@pytest.mark.parametrize("vector", ["CVSS:3.1", "", None, "AV:X/junk", "AVN"])
def test_vectors_without_any_flag(one, vector):
    row = row_of(one, "cve_core", cvss_vector=vector)
    assert not any(row[name] for name in FLAG_NAMES)


def test_repeated_metric_sets_both_flags(one):
    row = row_of(one, "cve_core", cvss_vector="AV:N/AV:L")
    assert (row.attack_vector_network, row.attack_vector_local) == (1, 1)


def test_metric_words(one):
    row = features.metric_word_features(one(cvss_attack_vector=" Network", cvss_scope="CHANGED", cvss_integrity="")).first()
    assert (row.attack_vector_network, row.scope_changed, row.integrity_none, row.availability_high) == (1, 1, 0, 0)


def test_weakness_ids(one):
    row = row_of(one, "cwe", cwes="cwe-79, 89,CWE22,x,79,079")
    assert (row.cwe_count, row.is_cwe_79, row.is_cwe_89, row.is_cwe_22, row.is_cwe_78) == (3, 1, 1, 1, 0)
    assert (row.cwe_is_injection, row.cwe_is_web_related, row.cwe_is_memory_related) == (1, 1, 0)
    assert (row.cwe_historical_exploit_rate, row.cwe_global_frequency) == (0.72, 0.95)


def test_weakness_label_codes(one):
    assert row_of(one, "cwe", cwes="CWE-862").cwe_primary_encoded == 36
    assert row_of(one, "cwe", cwes="CWE-943").cwe_primary_encoded == 50
    assert row_of(one, "cwe", cwes="862").cwe_primary_encoded == 0
    assert row_of(one, "cwe", cwes="").cwe_historical_exploit_rate == 0.0


@pytest.mark.parametrize(
    "current, fixes, gaps, count",
    [
        ("v1.2.3-beta", "2.0.0, 3.0", (1, 0, 0), 2),
        ("1.2.3", "", (0, 0, 0), 0),
        ("1.x", "1.4.7", (0, 4, 7), 1),
        ("vV0.9_1", " , v1.10.0+build", (1, 1, 0), 1),
        (None, "20230101123456.1", (20230101123456, 1, 0), 1),
    ],
)
def test_version_gaps(one, current, fixes, gaps, count):
    row = row_of(one, "dependency", package_version=current, fix_versions=fixes)
    assert (row.version_gap_major, row.version_gap_minor, row.version_gap_patch) == gaps
    assert row.num_fix_versions == count
    assert row.is_major_upgrade == (gaps[0] > 0)
    assert row.has_fix_available == (1 if fixes.strip() else 0)


def test_ecosystem_and_depth(one):
    row = row_of(one, "dependency", ecosystem=" NPM ", transitive_dep_count="2")
    assert (row.package_ecosystem_npm, row.package_ecosystem_go, row.is_direct_dependency, row.dependency_depth) == (1, 0, 0, 2)


def test_time_features(one):
    row = row_of(
        one, "time", published_date="2024-05-22 13:00:00", detection_time="2024-05-20", modified_date="2024-05-30",
        has_patch="yes", cvss_score="5", epss_score="0.5", num_references="6", sources="NVD", severity="HIGH",
    )
    assert row.detection_delay_days == 0
    assert row.cve_age_days == 9  # 9 days and 23 hours
    assert (row.is_recent_cve, row.is_old_cve, row.is_exploit_known) == (1, 0, 1)
    assert (row.exposure_window_days, row.patch_age_days) == (0, 2)
    assert row.severity_age_interaction == 27
    assert row.source_diversity == 0.25
    assert row.epss_cvss_ratio == pytest.approx(0.5 / 0.501)


def test_unknown_publication_counts_as_age_zero(one):
    row = row_of(one, "time", published_date=None, references="see EXPLOIT-db")
    assert (row.cve_age_days, row.is_recent_cve, row.is_exploit_known) == (0, 1, 1)


@pytest.mark.parametrize(
    "text, rce, dos", [("windows dosbox", 0, 0), ("a DoS attack", 0, 1), ("RCE!", 1, 0), ("forced source", 0, 0), ("Remote code execution", 1, 0), ("éDOS", 0, 0)]
)
def test_text_words(one, text, rce, dos):
    row = row_of(one, "text", cve_description=text)
    assert (row.description_has_rce_mention, row.description_has_dos_mention) == (rce, dos)


def test_text_counts(one):
    row = row_of(one, "text", cve_description="  two　words ")
    assert (row.description_length, row.description_word_count) == (12, 2)


# ------------------------------------------------------------ grouped blocks


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        ("1", "a", "p", "CVE-1", "HIGH", "fixed", "CWE-79", "2024-01-01", 5.0),
        ("2", "a", "p", "CVE-1", "HIGH", "skipped", "CWE-79", "2024-01-11", 7.0),
        ("3", "a", "q", "CVE-2", "LOW", "False Positive", "", "2024-05-01", 9.0),
        ("4", "b", "q", "CVE-3", "CRITICAL", "false_positive", "CWE-79", None, 1.0),
    ]
    names = "finding_id, repo, package_name, cve_id, severity, user_action, cwes, published_date, cvss_score".split(", ")
    return canonicalize(spark.createDataFrame(rows, names))


def by_id(table):
    return {row.finding_id: row for row in table.collect()}


def test_package_features(small):
    rows = by_id(profiles.grouped_features(small, ["package"]))
    assert (rows["1"].package_name_frequency, rows["1"].package_name_cve_density) == (2, 1)
    assert (rows["4"].package_name_frequency, rows["4"].package_name_cve_density) == (2, 2)


def test_repo_features(small):
    rows = by_id(profiles.grouped_features(small, ["repo"]))
    a, b = rows["1"], rows["4"]
    assert (a.repo_total_cves, a.repo_high_count, a.repo_low_count, a.repo_cve_count_30d, a.repo_cve_count_90d) == (3, 2, 1, 1, 1)
    assert a.repo_fix_rate == pytest.approx(1 / 3)
    assert a.repo_false_positive_rate == 0.0  # the spelling with a space is not counted here
    assert a.repo_cve_velocity == pytest.approx(3 / 122)
    assert (a.repo_avg_cvss, a.repo_max_cvss, a.repo_unique_packages, a.repo_unique_cwes) == (7.0, 9.0, 2, 2)
    assert (b.repo_cve_velocity, b.repo_false_positive_rate) == (1.0, 1.0)


def test_repo_features_are_zero_without_any_repo(one):
    row = profiles.grouped_features(canonicalize(one(repo="", cvss_score="9")), ["repo"]).first()
    assert all(row[name] == 0 for name in profiles.REPO_NAMES)


def test_history_features(small):
    rows = by_id(profiles.grouped_features(small, ["user"]))
    assert rows["1"].historical_fix_rate_same_cwe == pytest.approx(1 / 3)
    assert rows["3"].historical_fp_rate_same_repo == pytest.approx(1 / 3)
    assert rows["1"].cwe_action_consistency == pytest.approx(0.5773502692)
    assert rows["3"].cwe_action_consistency == 0.0  # alone in its group
    assert rows["4"].repo_action_diversity == 0.25
    assert rows["1"].severity_action_alignment == 0.5


def test_leave_one_out(small):
    rows = by_id(profiles.grouped_features(small, ["user"], leave_one_out=True))
    assert rows["1"].historical_fix_rate_same_cwe == 0.0
    assert rows["2"].historical_fix_rate_same_cwe == 0.5
    assert rows["3"].historical_fp_rate_same_cwe == 0.0  # a group of one


def test_matrix_has_the_129_features_in_order_and_no_gaps(small):
    matrix = feature_matrix(small, AS_OF)
    assert len(FEATURE_NAMES) == 129
    assert matrix.columns == ["finding_id", *FEATURE_NAMES]
    assert all(value is not None for row in matrix.collect() for value in row)


def test_matrix_of_some_blocks(small):
    assert len(feature_matrix(small, AS_OF, ["cwe", "time"]).columns) == 1 + 20 + 15


def test_alignment_adds_drops_and_reorders(small):
    table = align_features(features.row_features(small, AS_OF, ["time"]), ["unknown", "cve_age_days"])
    assert table.columns == ["finding_id", "unknown", "cve_age_days"]
    assert {row.unknown for row in table.collect()} == {0}


def test_missing_repos_are_unknown_in_one_block_and_blank_in_the_other(spark):
    rows = [("1", None, "fixed"), ("2", "unknown", "skipped"), ("3", "", "skipped"), ("4", "a", "fixed")]
    table = canonicalize(spark.createDataFrame(rows, "finding_id string, repo string, user_action string"))
    result = by_id(profiles.grouped_features(table, ["repo", "user"]))
    assert [result[i].repo_total_cves for i in "1234"] == [2, 2, 1, 1]
    assert [result[i].historical_fix_rate_same_repo for i in "1234"] == [0.5, 0.0, 0.5, 1.0]
    alone = by_id(profiles.grouped_features(table, ["user"]))
    assert all(alone[i].historical_fix_rate_same_repo == result[i].historical_fix_rate_same_repo for i in "1234")


def test_version_parts_without_patterns(spark):
    from findrisk.functions.versions import version_parts

    texts = ["vV1.2.3-rc.1", " v10.0+b.2", "1.2_3", "1 2.3", "-1.2", "v", "", "nan", None, "1..2.", "a\n.b-c", "Vv.1v.v2"]
    table = spark.createDataFrame([(text,) for text in texts], "x string")
    plan = table.select(version_parts(F.col("x")).alias("p"))
    old = F.split(F.regexp_extract(F.regexp_replace(strip(text_or_blank(F.col("x"))), "^[vV]+", ""), "^[^-+_ ]*", 0), r"\.")
    rows = table.select(version_parts(F.col("x")).alias("new"), old.alias("old")).collect()
    assert [row.new for row in rows] == [row.old for row in rows]
    assert "regexp" not in plan._jdf.queryExecution().executedPlan().toString()
