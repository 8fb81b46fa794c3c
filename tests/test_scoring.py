import pytest
from pyspark.sql import functions as F

from findrisk.operators import dashboard, scoring


@pytest.mark.parametrize("score, tier", [(0.81, "CRITICAL"), (0.8, "HIGH"), (0.6, "MEDIUM"), (0.4, "LOW"), (0.400001, "MEDIUM"), (0.0, "LOW")])
def test_tier_bounds_belong_to_the_lower_tier(one, score, tier):
    assert one(s=score).select(scoring.classify_tier(F.col("s")).alias("t")).first().t == tier


def scored(one, **values):
    given = {"cvss_score": 5.0, "epss_percentile": 0.5, "ml_score": 0.5, "is_withdrawn": 0, **values}
    return scoring.hybrid_score(one(**given)).first()


def test_weighted_sum(one):
    row = scored(one, attack_vector_network=1, privileges_required_none=0, is_exploit_known=1, repo_criticality=1.0)
    assert row.exposure_score == pytest.approx(0.7)
    assert row.risk_score == pytest.approx(0.225 + 0.1 + 0.075 + 0.07 + 0.1)


def test_components_are_clipped_and_defaulted(one):
    row = scored(one, cvss_score=14.0, epss_percentile=-1.0)
    assert (row.normalized_cvss, row.normalized_epss, row.exposure_score, row.repo_criticality) == (1.0, 0.0, 0.0, 0.5)


def test_floor_for_critical_beats_cap_for_withdrawn(one):
    flags = dict(attack_vector_network=1, privileges_required_none=1, is_exploit_known=0)
    assert scored(one, is_withdrawn=1, cvss_score=9.5, **flags).risk_score == 0.85
    assert scored(one, is_withdrawn=1, cvss_score=8.9, **flags).risk_score == 0.1


def test_exposure_of_exactly_one_half_has_no_floor(one):
    table = one(cvss_score=9.5, epss_percentile=0.0, ml_score=0.0, is_withdrawn=0, exposure=0.5)
    low = scoring.hybrid_score(table.withColumn("attack_vector_network", F.lit(1.25))).first()  # 0.4 * 1.25
    assert low.exposure_score == 0.5 and low.risk_score < 0.85


def test_other_weights(one):
    weights = {"ml": 1.0, "cvss": 0.0, "epss": 0.0, "exposure": 0.0, "repo_criticality": 0.0}
    table = one(cvss_score=5.0, epss_percentile=0.5, ml_score=0.3, is_withdrawn=0)
    assert scoring.hybrid_score(table, weights=weights).first().risk_score == 0.3


def service(one, **values):
    given = dict(cve_id="CVE-1", cvss_score=9.5, epss_score=0.2, has_known_exploit=True, is_withdrawn=False, exposure_score=0.7, repo_criticality=0.5, ml_score=0.4)
    return scoring.service_score(one(**{**given, **values})).first()


def test_service_variant_cap_excludes_floor(one):
    row = service(one, is_withdrawn=True)
    assert (row.risk_score, row.overrides_applied, row.tier) == (0.1, "withdrawn_cap", "LOW")
    row = service(one)
    assert (row.risk_score, row.overrides_applied, row.tier) == (0.85, "critical_exploit_floor", "CRITICAL")
    assert service(one, has_known_exploit=False).overrides_applied == "none"


def test_service_variant_fallbacks(spark):
    table = spark.sql(
        "select 'f' finding_id, 'CVE-1' cve_id, 5.0D cvss_score, 0.00005D epss_score, false has_known_exploit, false is_withdrawn,"
        " cast(null as double) exposure_score, cast(null as double) repo_criticality, cast(null as double) ml_score"
    )
    row = scoring.service_score(table).first()
    assert (row.ml_score, row.ml_fallback_used, row.exposure_score, row.repo_criticality) == (0.5, 1, 0.5, 0.5)
    assert row.epss_score == 0.0001  # ties go up


def test_request_validation(spark):
    table = spark.sql(
        "select * from values ('CVE-1', 5.0D, 0.5D, 0.5D, cast(null as double)), (' ', 11.0D, 0.5D, 0.5D, 0.5D), ('CVE-2', 5.0D, -0.1D, 2.0D, 0.5D)"
        " as t(cve_id, cvss_score, epss_score, exposure_score, repo_criticality)"
    )
    assert scoring.accepted_requests(table).count() == 1
    reasons = {row.reject_reason for row in scoring.rejected_requests(table).collect()}
    assert reasons == {
        "cve_id is required; cvss_score must be between 0 and 10",
        "epss_score must be between 0 and 1; exposure_score must be between 0 and 1",
    }


def ranked(spark, scores):
    rows = [(f"f{i:05d}", s) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "finding_id string, risk_score double")


def test_histogram_buckets(spark):
    table = ranked(spark, [i / 10000 for i in range(10001)])
    clean = {row["range"]: row["count"] for row in dashboard.risk_histogram(table).collect()}
    assert list(clean.values()) == [1000] * 9 + [1001]
    floats = {row["range"]: row["count"] for row in dashboard.risk_histogram(table, float_bounds=True).collect()}
    assert sum(floats.values()) == 10001 - 2  # 0.6 and 1.0 fall through
    assert floats["0.2-0.3"] == 1001 and floats["0.3-0.4"] == 999


def test_pages_follow_each_other_and_end(spark):
    table = ranked(spark, [0.5] * 7 + [0.9] * 3)
    pages = [[r.finding_id for r in dashboard.table_page(table, page, 4).collect()] for page in (1, 2, 3, 4)]
    assert [len(page) for page in pages] == [4, 4, 2, 0]
    assert sum(pages, []) == [r.finding_id for r in scoring.by_risk(table).collect()]
    counts = dashboard.page_counts(table, 4).first()
    assert (counts.total, counts.total_pages) == (10, 3)
    assert dashboard.page_counts(table.filter("false"), 4).first().total_pages == 1
    after = [r.finding_id for r in dashboard.page_after(table, 0.9, "f00009", 4).collect()]
    assert after == ["f00000", "f00001", "f00002", "f00003"]


def test_sort_by_unknown_column_falls_back_to_risk(spark):
    table = ranked(spark, [0.1, 0.9])
    assert dashboard.table_sort(table, "no_such_column", "asc").first().risk_score == 0.9


def test_search_is_a_regex_unless_literal(spark):
    table = spark.createDataFrame([("f1", "CVE-1", "a.b", "r"), ("f2", "CVE-2", "axb", None)], "finding_id string, cve_id string, package_name string, repo string")
    assert dashboard.table_filter(table, search="A.B").count() == 2
    assert dashboard.table_filter(table, search="A.B", literal=True).count() == 1


def test_catalogue_keeps_a_repo_without_releases(spark):
    table = spark.createDataFrame(
        [("a", "v1", "LOW", 0.1), ("a", "v2", "CRITICAL", 0.9), ("a", None, "LOW", 0.2), ("b", None, "LOW", 0.3)],
        "repo string, release string, tier string, risk_score double",
    )
    rows = [(r.repo, r.total_vulns, r.release, r.release_total_vulns) for r in dashboard.repo_catalogue(table).collect()]
    assert rows == [("a", 3, "v2", 1), ("a", 3, "v1", 1), ("b", 1, None, None)]
