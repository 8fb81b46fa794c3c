"""Shape of an ingested table: row count, columns, value counts, distinct repos."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PROFILED = ("severity", "user_action", "ecosystem")


def dataset_profile(df: DataFrame) -> DataFrame:
    """Long table (item, value, n): records, columns, distinct repos and value counts.

    One pass: each row becomes one (item, value) pair for the record, its repo and
    each profiled column; the pairs are counted, with partial counts made before
    the shuffle, and the repos among them counted once more.
    """
    present = [name for name in PROFILED if name in df.columns]
    named = [("records", F.lit("")), *[(name, F.col(name).cast("string")) for name in present]]
    if "repo" in df.columns:
        named.append(("repos", F.col("repo").cast("string")))
    pairs = F.explode(F.array(*[F.struct(F.lit(item).alias("item"), value.alias("value")) for item, value in named]))
    counted = df.select(pairs.alias("p")).select("p.*").filter("value is not null").groupBy("item", "value").agg(F.count(F.lit(1)).alias("n"))
    is_repo = F.col("item") == "repos"
    folded = counted.select(
        "item", F.when(is_repo, "").otherwise(F.col("value")).alias("value"), F.when(is_repo, 1).otherwise(F.col("n")).cast("bigint").alias("n")
    )
    # items that an empty table has too
    fixed = [("columns", "", len(df.columns)), *[(item, "", 0) for item, _ in named if item in ("records", "repos")]]
    zero = df.sparkSession.createDataFrame(fixed, "item string, value string, n bigint")
    return folded.unionByName(zero).groupBy("item", "value").agg(F.sum("n").alias("n"))
