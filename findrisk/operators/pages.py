"""Any page of a sorted table without gathering the pages before it.

The table is dealt out once into ranges of its order, each a folder of the staged
index; the number of rows before every range is known. A page then reads the one or
two ranges it lies in, whatever its number.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from findrisk.operators.dashboard import order_columns
from findrisk.storage import stage, staging_path

#: Rows of a range, about; a task of a page holds no more than a range.
RANGE_ROWS = 50_000
#: Ranges of an index at most: each is a folder, a file and a task. Larger tables get longer ranges.
MOST_RANGES = 2000


@dataclass(frozen=True)
class PageIndex:
    """``rows`` by range; ``before[i]`` rows lie before range ``ranges[i]`` in the order, ``total`` in all."""

    rows: DataFrame
    ranges: list[int]
    before: list[int]
    total: int
    sort_by: str
    sort_order: str


def page_index(table: DataFrame, sort_by: str = "risk_score", sort_order: str = "desc", range_rows: int = RANGE_ROWS) -> PageIndex:
    """Stage ``table`` in ranges of the order of ``table_sort``.

    The finding id is part of the order, so equal sort values are spread over ranges
    like any others. Only the ranges' sizes reach the driver. A range has about
    ``range_rows`` rows, or more where that would make over ``MOST_RANGES`` of them.
    """
    spark = table.sparkSession
    rows = stage(table, "page-rows")
    keys = order_columns(rows, sort_by, sort_order)
    ranges = min(max(1, -(-rows.count() // range_rows)), MOST_RANGES)
    dealt = rows.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id())
    path = staging_path(spark, "page-index")
    dealt.write.partitionBy("_range").parquet(path)
    index = spark.read.schema(dealt.schema).parquet(path)
    sizes = sorted((row["_range"], row["n"]) for row in index.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    before = [0]
    for _, n in sizes:
        before.append(before[-1] + n)
    return PageIndex(index, [number for number, _ in sizes], before[:-1], before[-1], sort_by, sort_order)


def page_ranges(index: PageIndex, number: int, page_size: int) -> tuple[list[int], int]:
    """The ranges a page lies in, and its place from the start of the first one."""
    first = (number - 1) * page_size
    last = min(first + page_size, index.total)
    if first >= last:
        return [], 0
    low, high = bisect_right(index.before, first) - 1, bisect_right(index.before, last - 1)
    return index.ranges[low:high], first - index.before[low]


def page(index: PageIndex, number: int = 1, page_size: int = 25) -> DataFrame:
    """One page of the indexed table, sorted; a page past the end is empty."""
    ranges, place = page_ranges(index, number, page_size)
    rows = index.rows.filter(F.col("_range").isin(ranges)).drop("_range")
    return rows.orderBy(*order_columns(rows, index.sort_by, index.sort_order)).offset(place).limit(page_size)
