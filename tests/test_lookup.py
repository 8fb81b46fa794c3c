from pyspark.sql import functions as F

from findrisk.operators.lookup import attach
from findrisk.operators.releases import COMPARED_COLUMNS, compared_rows


def facts_and_stats(spark):
    """One key holds a third of 30,000 rows; 10,000 keys share the rest; some rows have no statistics."""
    facts = spark.range(30_000).select(
        F.col("id").cast("string").alias("finding_id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, "absent").otherwise(F.concat(F.lit("k"), F.col("id") % 10_000)).alias("key"),
    )
    stats = facts.filter("key <> 'absent'").groupBy("key").agg(
        F.count(F.lit(1)).alias("weight"), F.count(F.lit(1)).alias("n"), F.max("finding_id").alias("last")
    )
    return facts, stats


def test_all_ways_of_joining_agree(spark):
    facts, stats = facts_and_stats(spark)
    expected = facts.join(stats.drop("weight"), "key", "left").select("finding_id", "key", "n", "last")
    for limit in (64 << 20, 0):
        joined = attach(facts, stats, "key", weight="weight", spread_by=F.col("finding_id"), broadcast_bytes=limit)
        result = joined.select("finding_id", "key", "n", "last")
        assert result.count() == 30_000
        assert result.exceptAll(expected).count() == 0


def test_small_statistics_leave_the_facts_unshuffled(spark):
    facts, stats = facts_and_stats(spark)
    plan = attach(facts, stats, "key", weight="weight", spread_by=F.col("finding_id"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_hot_rows_are_spread_when_statistics_are_too_large(spark):
    facts, stats = facts_and_stats(spark)
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = attach(facts, stats, "key", weight="weight", spread_by=F.col("finding_id"), broadcast_bytes=0)
        sizes = [row["count"] for row in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
    assert len(sizes) == 4 and max(sizes) < 9_000


def test_hot_repo_is_spread_in_release_comparison(spark):
    """A third of all rows in one repo, pairs too large to broadcast."""
    columns = {name: "'x'" for name in COMPARED_COLUMNS} | {
        "finding_id": "cast(id as string)", "repo": "if(id % 3 = 0, 'hot', concat('r', id % 3000))",
        "release": "concat('v', id div 3000 % 2)", "risk_score": "0.5", "has_patch": "1",
    }
    table = spark.range(30_000).selectExpr(*[f"{expression} as {name}" for name, expression in columns.items()])
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spread = compared_rows(table, broadcast_bytes=0)
        files = [row["count"] for row in spread.groupBy(F.input_file_name()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
    assert sum(files) == 30_000
    assert max(files) < 9_000
    assert compared_rows(table).exceptAll(spread.select(*compared_rows(table).columns)).count() == 0
