"""Join per-key statistics back to every row, safely for large and skewed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from findrisk.storage import stage

BROADCAST_BYTES = 64 * 1024 * 1024
HEAVY_SHARE = 2000
SPREAD = 4096


def _row_bytes(df: DataFrame) -> Column:
    """Size of a row in memory: 16 bytes per column and the length of every text."""
    total = F.lit(16 * (len(df.columns) + 1))
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            total = total + F.coalesce(F.octet_length(f.name), F.lit(0))
    return total


def attach(
    facts: DataFrame,
    stats: DataFrame,
    key: str,
    *,
    weight: str,
    spread_by: Column,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left-join ``stats`` (one row per ``key``) to ``facts``.

    The statistics are staged first, so their size is known, not guessed:

    * small enough: broadcast, the facts are not shuffled at all;
    * too large: keys holding at least 1/2000 of all rows (there can be no more
      than 2000) are broadcast. The other keys are joined by shuffle, in which
      the rows already served are spread by ``spread_by`` over many partitions,
      so a key with a third of all rows does not end in one task.

    ``weight`` names the row count per key in ``stats`` and is dropped from the
    result unless the facts need it under another name.
    """
    staged = stage(stats, f"stats-{key}")
    value_names = [name for name in staged.columns if name not in (key, weight)]
    size = staged.agg(
        F.coalesce(F.sum(_row_bytes(staged)), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(weight), F.lit(0)).alias("rows"),
    ).first()
    values = staged.drop(weight)
    if size["bytes"] <= broadcast_bytes:
        return facts.join(F.broadcast(values), key, "left")

    heavy = staged.filter(F.col(weight) * HEAVY_SHARE >= size["rows"]).select(
        key, F.struct(*value_names).alias("_heavy")
    )
    light = staged.filter(F.col(weight) * HEAVY_SHARE < size["rows"]).select(
        F.col(key).cast("string").alias("_key"), F.struct(*value_names).alias("_light")
    )
    # A row already served joins under a slot of its own choice and matches nothing.
    served = F.col("_heavy").isNotNull()
    slot = F.concat(F.lit("slot "), F.pmod(F.xxhash64(spread_by), F.lit(SPREAD)).cast("string"))
    marked = facts.join(F.broadcast(heavy), key, "left").withColumns(
        {"_served": served, "_slot": F.when(served, slot).otherwise(F.col(key).cast("string"))}
    )
    joined = marked.join(light, (F.col("_slot") == F.col("_key")) & ~F.col("_served"), "left")
    found = F.coalesce("_heavy", "_light")
    return joined.select(*[marked[name] for name in facts.columns], *[found[name].alias(name) for name in value_names])
