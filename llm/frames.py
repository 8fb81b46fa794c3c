"""DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from findrisk.storage import stage

__all__ = ["join_rows", "read_table", "require", "row_key", "running_totals", "sheltered", "stage", "shuffle_width", "sql_identifier"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, *names: str) -> None:
    """Fail early, by name, if a column the operator reads is missing."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def sql_identifier(name: str) -> str:
    """A column name quoted for expressions, so that dots and blanks are plain characters."""
    return "`" + name.replace("`", "``") + "`"


def sheltered(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Keep the caller's columns apart from an operator's working columns, which start with two underscores.

    Columns of the first table with such names are worked on under other names and
    get their own back in the result. A column the caller wants replaced (``into``)
    is left as it is; parameters ending in ``_col`` follow the names.
    """
    signature = inspect.signature(operator)

    @wraps(operator)
    def apply(docs: DataFrame, *args, **kwargs) -> DataFrame:
        given = signature.bind(docs, *args, **kwargs)
        taken = {name.lower() for name in docs.columns}
        names: dict[str, str] = {}
        for name in docs.columns:
            if name.startswith("__") and name != given.arguments.get("into"):
                other = f"own{name}"
                while other.lower() in taken:
                    other = f"own_{other}"
                taken.add(other.lower())
                names[name] = other
        if not names:
            return operator(docs, *args, **kwargs)
        given.arguments["docs"] = docs.withColumnsRenamed(names)
        settings = [given.arguments, *[value for value in given.arguments.values() if isinstance(value, dict)]]
        for arguments in settings:
            for key, value in arguments.items():
                if key.endswith("_col") and value in names:
                    arguments[key] = names[value]
        return operator(*given.args, **given.kwargs).withColumnsRenamed({other: name for name, other in names.items()})

    return apply


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions that shuffles of this session use."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(df: DataFrame, id_col: str) -> DataFrame:
    """Add ``__id, __hash, __copy``, which name each row by its content.

    Rows equal in every column are numbered among themselves; as nothing tells
    them apart, any numbering gives the same rows after a join on the three
    columns. Nothing depends on partitions, so the key is stable when tasks run
    again. A null id counts as the smallest long.
    """
    columns = [F.col(sql_identifier(name)) for name in df.columns]
    hashed = F.xxhash64(*columns, *[column.isNull() for column in columns])
    keyed = df.withColumns(
        {"__id": F.coalesce(F.col(sql_identifier(id_col)).cast("long"), F.lit(-(1 << 63))), "__hash": hashed}
    )
    return keyed.withColumn("__copy", F.row_number().over(Window.partitionBy("__id", "__hash").orderBy("__hash")))


def join_rows(keyed: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """Join a table that has a row key with rows that carry such keys, at most one per key.

    Both tables are dealt out together by id and hash, the rows of a content are
    numbered there, and each group of one number holds a row and what belongs to it.
    So the work on n equal rows grows with n, and wide rows are shuffled once. With
    ``left``, rows without a partner stay, with nulls.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown kind of join: {how}")
    key = ["__id", "__hash", "__copy"]
    brought = [name for name in other.columns if name not in key]
    # any numbering of equal rows will do: they are numbered anew where they meet their partners
    rows = keyed.drop("__copy").withColumn("__copy", F.lit(None).cast("long"))
    partners = other.withColumns({"__copy": F.col("__copy").cast("long"), "__partner": F.lit(True)})
    dealt = rows.unionByName(partners, allowMissingColumns=True).repartition("__id", "__hash")
    number = F.row_number().over(Window.partitionBy("__id", "__hash", F.col("__copy").isNull()).orderBy("__hash")).cast("long")
    numbered = dealt.withColumn("__number", F.coalesce("__copy", number))
    same = Window.partitionBy("__id", "__hash", "__number")
    met = numbered.withColumns({f"__met{i}": F.max_by(sql_identifier(name), "__partner").over(same) for i, name in enumerate(["__partner", *brought])})
    found = met.filter(F.col("__copy").isNull() & (F.col("__met0").isNotNull() | F.lit(how == "left")))
    return found.select(
        *[F.col("__number").alias(name) if name == "__copy" else sql_identifier(name) for name in keyed.columns],
        *[F.col(f"__met{i}").alias(name) for i, name in enumerate(brought, 1)],
    )


def running_totals(
    df: DataFrame, order: Sequence[str | Column], values: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """Exact prefix sums over a table too large for one task.

    Adds ``before_rows`` and, for each value ``v``, ``before_v`` (its sum over
    the rows before this one in ``order``, within ``group``) and ``all_v`` (its
    sum over the group). Rows are dealt out by ranges of the order, each range
    is summed on its own, and only the totals of the ranges are summed in
    sequence. Rows equal in the order are cut apart by their place in the input,
    so that no range can hold an unbounded number of equal keys. ``group``
    columns must not be null.
    """
    spark = df.sparkSession
    keys = {f"__key{i}": F.col(key) if isinstance(key, str) else key for i, key in enumerate(order)}
    dealt = (
        df.withColumns(keys | {"__tie": F.monotonically_increasing_id()})
        .repartitionByRange(shuffle_width(spark), *group, *keys, "__tie")
        .withColumn("__range", F.spark_partition_id())
    )
    rows = stage(dealt, "ranges")
    sums = {"rows": F.lit(1).cast("long")} | {value: F.col(value).cast("long") for value in values}
    totals = rows.groupBy("__range", *group).agg(*[F.sum(column).alias(f"__sum_{name}") for name, column in sums.items()])
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = totals.select(
        "__range",
        *group,
        *[F.coalesce(F.sum(f"__sum_{name}").over(earlier), F.lit(0)).alias(f"__off_{name}") for name in sums],
        *[F.sum(f"__sum_{name}").over(whole).alias(f"all_{name}") for name in sums],
    )
    inside = Window.partitionBy("__range", *group).orderBy(*keys, "__tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns(
        {f"__in_{name}": F.coalesce(F.sum(column).over(inside), F.lit(0)) for name, column in sums.items()}
    )
    return placed.join(offsets, ["__range", *group]).select(
        *df.columns,
        *[(F.col(f"__off_{name}") + F.col(f"__in_{name}")).alias(f"before_{name}") for name in sums],
        *[f"all_{name}" for name in sums],
    )
