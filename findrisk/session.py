"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "findrisk", master: str | None = None, **extra: str) -> SparkSession:
    """Build a session with the settings below; ``extra`` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in extra.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


# The JVM does not compile methods longer than this many bytes of bytecode; a wide
# projection fused into one longer method would run interpreted.
JIT_METHOD_BYTES = 8000
# Shuffled bytes one task takes on. Packed rows grow several times in memory, and a
# task may hold them in a sort, a hash table and a window at once.
TASK_BYTES = 16 * 1024 * 1024


# Shuffle files of a job go when it ends, not when the driver happens to collect garbage.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _bytes(spark: SparkSession, key: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options the library relies on.

    Timestamps are read and compared in UTC. Stages whose generated code the JVM
    would not compile fall back to code that is split into smaller methods. A task
    takes on at most TASK_BYTES of shuffled rows where there are enough shuffle
    partitions, so its memory does not grow with the tables; a join with no larger
    partition on one side builds a hash table of it instead of sorting both sides.
    Shuffle files are deleted at the end of the job that wrote them.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > JIT_METHOD_BYTES:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(JIT_METHOD_BYTES))
    advisory, local_map = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    if _bytes(spark, advisory) > TASK_BYTES:
        spark.conf.set(advisory, str(TASK_BYTES))
    if _bytes(spark, local_map) == 0:
        spark.conf.set(local_map, str(TASK_BYTES))
    if spark.conf.get(SHUFFLES_END, "false") == "false":
        spark.conf.set(SHUFFLES_END, "true")
    return spark


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a table out over all cores if it comes in fewer splits than there are cores.

    A table in one small file would otherwise be worked on by one core. A large
    table has more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
