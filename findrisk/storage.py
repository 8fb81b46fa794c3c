"""Staged tables: intermediate results written once to shared storage.

A staged table cuts lineage with files that outlive any executor, is read back
with column pruning, and gives exact row counts from file footers.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, tempfile.TemporaryDirectory] = {}


def staging_root(spark: SparkSession) -> str:
    """Folder for staged tables, taken from ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder; on
    a cluster a machine-local folder would be wrong, so the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.TemporaryDirectory(prefix="findrisk-")
    return _local_roots[app].name


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give iterative estimators a checkpoint folder if the session has none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{staging_root(spark)}/rdd")


def staging_path(spark: SparkSession, label: str) -> str:
    """A new path under the staging folder."""
    return f"{_application_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _application_folder(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/findrisk-staged/{spark.sparkContext.applicationId}"


def clear_staged(spark: SparkSession) -> None:
    """Delete the tables this application has staged; call it once their readers are done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_application_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str = "table", **options: str) -> DataFrame:
    """Write ``df`` as parquet under the staging folder and read it back; ``options`` go to the writer."""
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.mode("error").options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(staged: DataFrame) -> None:
    """Delete one staged table that nothing reads any more."""
    spark = staged.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in staged.inputFiles()}:
        if "/findrisk-staged/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
