"""Registry of named queries and the SQL that says what each should return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from findrisk.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with SQL over the same tables if there is one."""

    def add(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return build

    return add


def settled(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, ties upward.

    Two engines add the same doubles in different orders; the last digits differ.
    The small excess over one half puts exact ties on one side in both.
    """
    return df.select(
        *[
            (F.floor(F.col(f.name) * 1e6 + 0.5001).cast("double") / 1e6).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def settle_sql(expression: str) -> str:
    """The same rounding as SQL text."""
    return f"(floor(({expression}) * 1e6 + 0.5001) / 1e6)"
