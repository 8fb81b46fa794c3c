import time

from pyspark.sql import functions as F

from llm.frames import join_rows, row_key
from llm.mixing import mix


def _keyed(spark, rows):
    return row_key(spark.createDataFrame(rows, "doc_id long, text string, `a.b` int"), "doc_id")


def test_rows_meet_what_carries_their_key(spark):
    rows = [(1, "x", 1), (1, "x", 1), (1, "x", 1), (1, "y", 1), (2, None, None), (None, "x", 1)]
    keyed = _keyed(spark, rows)
    other = keyed.filter("not (text <=> 'y')").select(
        "__id", "__hash", "__copy", F.array(F.col("__copy")).alias("__list"), F.when(F.col("__copy") != 2, F.lit("s")).alias("some")
    )
    own = lambda df: sorted((repr(r.doc_id), repr(r.text), r["a.b"] or 0, repr(r["__list"]), repr(r.some)) for r in df.collect())
    want = [("1", "'x'", 1, "[1]", "'s'"), ("1", "'x'", 1, "[2]", "None"), ("1", "'x'", 1, "[3]", "'s'"), ("2", "None", 0, "[1]", "'s'"), ("None", "'x'", 1, "[1]", "'s'")]
    inner = join_rows(keyed, other)
    assert inner.columns == [*keyed.columns, "__list", "some"]
    assert own(inner) == sorted(want)
    assert own(join_rows(keyed, other, "left")) == sorted([*want, ("1", "'y'", 1, "None", "None")])
    # one copy of three taken: one row, whichever
    assert join_rows(keyed, other.filter("__copy = 3")).count() == 1


def test_empty_sides(spark):
    keyed = _keyed(spark, [(1, "x", 1)])
    other = keyed.select("__id", "__hash", "__copy", F.lit(1).alias("n"))
    assert join_rows(keyed.limit(0), other).count() == 0
    assert join_rows(keyed, other.filter("n = 2")).count() == 0
    assert [r.n for r in join_rows(keyed, other.filter("n = 2"), "left").collect()] == [None]


def test_wide_rows_are_shuffled_once(spark):
    keyed = _keyed(spark, [(1, "x", 1)])
    other = spark.createDataFrame([(1, 2, 1, 1)], "__id long, __hash long, __copy int, n int")
    plan = join_rows(keyed, other)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_equal_rows_in_linear_time(spark):
    """Ten times the equal rows must not take a hundred times as long."""

    def seconds(n):
        docs = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
        begun = time.monotonic()
        assert mix(docs).count() == n * 3 // 2
        return time.monotonic() - begun

    seconds(2_000)
    assert seconds(200_000) < 20 * max(seconds(20_000), 0.5)
