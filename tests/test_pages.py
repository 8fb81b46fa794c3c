import pytest
from pyspark.sql import functions as F

from findrisk.operators import dashboard, pages
from findrisk.storage import stage


@pytest.fixture(scope="module")
def table(spark):
    """Scores with many ties and some nulls."""
    draw = F.pmod(F.xxhash64("id"), F.lit(7))
    rows = spark.range(1003).select(F.col("id").cast("string").alias("finding_id"), F.when(draw > 0, draw / 10).alias("risk_score"), F.lit("x").alias("tier"))
    return stage(rows.repartition(5))


@pytest.mark.parametrize("sort_by, sort_order", [("risk_score", "desc"), ("risk_score", "asc"), ("tier", "asc"), ("unknown", "desc")])
def test_every_page_is_that_of_the_sorted_table(table, sort_by, sort_order):
    index = pages.page_index(table, sort_by, sort_order, range_rows=100)
    assert index.total == 1003 and len(index.ranges) > 5
    want = [row.finding_id for row in dashboard.table_sort(table, sort_by, sort_order).collect()]
    got = [row.finding_id for number in range(1, 6) for row in pages.page(index, number, 240).collect()]
    assert got == want
    for number in (1, 17, 100, 101, 102, 4000):
        found = pages.page(index, number, 10)
        assert [row.finding_id for row in found.collect()] == want[10 * number - 10 : 10 * number]
        assert found.columns == table.columns


def test_a_deep_page_reads_two_ranges_at_most(spark, table):
    """The rows a task can hold are those of a range, however deep the page lies."""
    index = pages.page_index(table, range_rows=100)
    sizes = [b - a for a, b in zip(index.before, [*index.before[1:], index.total])]
    assert max(sizes) <= 300
    for number in (1, 50, 100):
        ranges, place = pages.page_ranges(index, number, 10)
        assert 1 <= len(ranges) <= 2 and 0 <= place < 300
        found = pages.page(index, number, 10)
        # folders of other ranges are not read
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "_range" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_an_empty_table_has_no_pages(table):
    index = pages.page_index(table.limit(0))
    assert index.total == 0 and pages.page(index).collect() == []


def test_the_number_of_ranges_does_not_grow_without_end(table, monkeypatch):
    """Folders, files and tasks stay bounded; every page is still that of the sorted table."""
    monkeypatch.setattr(pages, "MOST_RANGES", 4)
    index = pages.page_index(table, range_rows=10)
    assert index.total == 1003 and len(index.ranges) <= 4
    want = [row.finding_id for row in dashboard.table_sort(table).collect()]
    got = [row.finding_id for number in range(1, 6) for row in pages.page(index, number, 240).collect()]
    assert got == want
