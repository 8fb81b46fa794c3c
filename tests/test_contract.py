import __spark_entry__ as contract


def test_entry_returns_the_top_repos(spark):
    table = contract.entry(spark)
    assert table.columns == ["repo", "avg_risk", "max_risk", "total_vulns", "critical_count"]
    assert table.count() == 10


def test_every_check_names_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 90
