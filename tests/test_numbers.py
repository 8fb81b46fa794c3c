import random

import pytest
from pyspark.sql import functions as F

from findrisk.functions.numbers import exact_round, fixed, mean4, round4_half_up, whole
from findrisk.storage import clear_staged, stage


@pytest.mark.parametrize("digits", [1, 3, 4])
def test_rounding_and_printing_follow_the_exact_value(spark, digits):
    rng = random.Random(digits)
    values = [i / 10 ** (digits + 1) for i in range(-3000, 3000, 5)] + [rng.uniform(-100, 100) for _ in range(500)] + [0.125, 2.5, 0.0625]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    for row in table.select("v", exact_round(F.col("v"), digits).alias("r"), fixed(F.col("v"), digits).alias("t")).collect():
        assert row.r == round(row.v, digits)
        assert float(row.t) == float(f"{row.v:.{digits}f}")


def test_null_prints_as_null(spark):
    assert spark.sql("select cast(null as double) v").select(fixed(F.col("v"), 2).alias("t")).first().t is None


def test_half_up(spark):
    row = spark.sql("select 0.00005D a, 0.12344999D b").select(round4_half_up(F.col("a")), round4_half_up(F.col("b"))).first()
    assert tuple(row) == (0.0001, 0.1234)


@pytest.mark.parametrize("text, value", [("3.9", 3), ("-2.5", -2), ("1e3", 1000), ("1e30", 0), ("", 0), (None, 0), ("inf", 0)])
def test_whole(one, text, value):
    assert one(v=text).select(whole(F.col("v")).alias("w")).first().w == value


def test_mean_does_not_depend_on_order(spark):
    table = spark.range(10_000).select((F.col("id") * 37 % 10_007 / 10_000).alias("v"))
    means = {table.repartition(n).agg(mean4(F.col("v"))).first()[0] for n in (1, 3, 7)}
    assert len(means) == 1


def test_staged_tables_live_in_the_configured_folder_until_cleared(spark):
    table = stage(spark.range(5))
    assert spark.conf.get("spark.checkpoint.dir") in table.inputFiles()[0]
    assert table.count() == 5
    other = stage(spark.range(1))
    clear_staged(spark)
    assert not list(map(_exists, other.inputFiles())).count(True)


def _exists(uri):
    import os
    from urllib.parse import urlparse

    return os.path.exists(urlparse(uri).path)
