"""First rows per group without bringing whole groups together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The ``n`` first rows of each group, numbered from 1.

    Spark limits each group inside every task before the shuffle (window group
    limit), so a group of any size sends at most ``n`` rows per task.
    """
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col(rank) <= n)
