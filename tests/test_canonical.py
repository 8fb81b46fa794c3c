import pytest
from pyspark.sql import functions as F

from findrisk.operators.canonical import CANONICAL_COLUMNS, canonicalize, create_label, drop_unlabelled
from findrisk.sources.columns import CANONICAL_NAME, normalize_columns


def canonical_row(one, **values):
    return canonicalize(one(**values)).first()


def test_missing_columns_get_defaults(one):
    table = canonicalize(one(cve_id="CVE-1"))
    row = table.first()
    assert set(CANONICAL_COLUMNS) <= set(table.columns)
    assert (row.title, row.cvss_score, row.has_patch, row.cwe_count, row.severity) == ("", 0.0, 0, 0, "UNKNOWN")
    assert row.published_date is None


@pytest.mark.parametrize(
    "given, word, rank",
    [("critical", "CRITICAL", 4), (" Medium\t", "MEDIUM", 2), ("none", "UNKNOWN", 0), ("odd", "UNKNOWN", 0), (None, "UNKNOWN", 0), (" low　", "LOW", 1)],
)
def test_severity(one, given, word, rank):
    row = canonical_row(one, severity=given)
    assert (row.severity, row.severity_numeric) == (word, rank)


@pytest.mark.parametrize("given, expected", [("yes", 1), (" Patched ", 1), ("2", 0), ("no", 0), (None, 0), (3, 1), (0, 0), (float("nan"), 1), (True, 1), (False, 0)])
def test_patch_flag(one, given, expected):
    assert canonical_row(one, has_patch=given).has_patch == expected


def test_scores_never_raise(one):
    row = canonical_row(one, cvss_score="high", epss_score="NaN", epss_percentile="0.25", transitive_dep_count="3.9")
    assert (row.cvss_score, row.epss_score, row.epss_percentile, row.transitive_dep_count) == (0.0, 0.0, 0.25, 3)


def test_cwes_are_counted_and_the_first_wins(one):
    row = canonical_row(one, cwes=" , cwe-79, 89,CWE22,x,79", primary_cwe="CWE-1", cwe_count=9)
    assert (row.cwe_count, row.primary_cwe) == (5, "cwe-79")


def test_given_primary_cwe_survives_blank_list_unless_strict(one):
    assert canonicalize(one(cwes="", primary_cwe="CWE-20")).first().primary_cwe == "CWE-20"
    assert canonicalize(one(cwes="", primary_cwe="CWE-20"), strict_cwe=True).first().primary_cwe == ""


def test_withdrawn_from_title_or_status_only(one):
    assert canonical_row(one, title="x", status="WITHDRAWN").is_withdrawn == 1
    assert canonical_row(one, title="Withdrawn Advisory: x", status="open").is_withdrawn == 1
    assert canonical_row(one, title="x", status="open", is_withdrawn=1).is_withdrawn == 0


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2023-04-05T06:07:08Z", "2023-04-05 06:07:08"),
        ("2023-04-05T06:07:08+02:00", "2023-04-05 04:07:08"),
        ("4/5/2023", "2023-04-05 00:00:00"),
        ("20230405", "2023-04-05 00:00:00"),
        ("5 Apr 2023", "2023-04-05 00:00:00"),
        ("soon", None),
    ],
)
def test_dates(one, text, expected):
    table = canonicalize(one(published_date=text)).select(F.date_format("published_date", "yyyy-MM-dd HH:mm:ss").alias("d"))
    assert table.first().d == expected


def test_missing_action_is_the_text_nan(one):
    assert canonical_row(one, user_action=None).user_action == "nan"


def test_unknown_columns_are_kept(one):
    assert canonical_row(one, team="blue").team == "blue"


@pytest.mark.parametrize(
    "action, label", [("Fixed ", 1), ("accepted", 1), ("False Positive", 0), ("false_positive", 0), ("deferred", 0), ("monitoring", None)]
)
def test_labels(one, action, label):
    table = create_label(one(user_action=action))
    assert table.first().label == label
    assert drop_unlabelled(table).count() == (label is not None)


def test_caller_may_override_positive_actions(one):
    assert create_label(one(user_action="skipped"), ["skipped"]).first().label == 1


def test_header_spellings():
    assert len(CANONICAL_NAME) == 59
    assert CANONICAL_NAME["cve- weaknesses(cwe)"] == "cwes"


def test_two_headers_of_one_column_are_merged_in_order(spark):
    table = spark.createDataFrame([(None, "MIT", " HIGH"), ("ISC", "MIT", "low")], "License string, ` Licence` string, `Severity ` string")
    rows = normalize_columns(table).collect()
    assert [(r.licence, r.severity) for r in rows] == [("MIT", "HIGH"), ("ISC", "LOW")]
