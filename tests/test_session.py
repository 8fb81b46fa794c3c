"""Options the library sets: how much of a shuffle one task takes on, and how it joins."""

import pytest

from findrisk.session import SHUFFLES_END, TASK_BYTES, prepare

ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
LOCAL_MAP = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
BROADCAST = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture
def settings(spark):
    before = {key: spark.conf.get(key) for key in (ADVISORY, LOCAL_MAP, BROADCAST)}
    yield spark.conf
    for key, value in before.items():
        spark.conf.set(key, value)


def test_a_task_takes_on_a_bounded_share(spark, settings):
    settings.set(ADVISORY, "64MB")
    prepare(spark)
    assert int(settings.get(ADVISORY)) == TASK_BYTES
    settings.set(ADVISORY, "8m")
    prepare(spark)
    assert settings.get(ADVISORY) == "8m"


def test_a_join_with_small_partitions_does_not_sort(spark, settings):
    settings.set(ADVISORY, "64MB")
    settings.set(LOCAL_MAP, "0")
    settings.set(BROADCAST, "-1")
    prepare(spark)
    joined = spark.range(1000).join(spark.range(0, 1000, 3), "id")
    assert len(joined.collect()) == 334
    assert "ShuffledHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_shuffle_files_are_deleted_with_their_job(spark):
    prepare(spark)
    assert spark.conf.get(SHUFFLES_END) == "true"
    counted = spark.range(1000).groupBy("id").count()
    # the same frame gives the same rows again
    assert counted.agg({"count": "sum"}).first()[0] == 1000 and len(counted.collect()) == len(counted.collect()) == 1000
