"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from llm.frames import read_table, require, running_totals, sql_identifier
from llm.registry import register

SHARDS = 16


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text plus one for its end; a null text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the documents, in ascending id order, into ``shards`` runs of near-equal bytes.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and
    ``shard_bytes, shard_rows``, one row per document. The size of everything
    before a document is known from the totals of the ranges of ids, and the
    document goes to the shard that its middle byte falls in: each cut lies
    within half a document of its equal target. ``slot`` numbers a shard's
    documents from 0 without gaps.

    A null text has no bytes (size 1, crc 0). Null ids come first; repeated ids
    are ordered by size and checksum, and rows equal in all of these are
    interchangeable. A document larger than a whole share leaves neighbouring
    shards empty. An empty table gives no rows. Other columns of the input are
    not read, whatever their names.
    """
    require(docs, id_col, text_col)
    text = F.col(sql_identifier(text_col))
    narrow = docs.select(
        F.col(sql_identifier(id_col)).alias("doc_id"),
        text_bytes(text).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = running_totals(narrow, ["doc_id", "size", "text_crc32"], ["size"])
    middle = (2 * F.col("before_size") + F.col("size")) * F.lit(shards).cast("long")
    cut = placed.withColumn("__middle", middle).withColumn("shard", F.expr("__middle div (2 * all_size)").cast("int"))
    starts = cut.groupBy("shard").agg(
        F.min("before_rows").alias("__first"), F.sum("size").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows")
    )
    # at most ``shards`` rows
    return cut.join(F.broadcast(starts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before_rows") - F.col("__first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "shard_bytes",
        "shard_rows",
    )


CRC_SQL = """
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    WITH RECURSIVE step(i, k, c) AS (
      SELECT i, 0, i FROM (SELECT unnest(range(0, 256))::BIGINT AS i)
      UNION ALL
      SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8)
    SELECT i, c FROM step WHERE k = 8)),
"""

SQL = f"""
WITH {CRC_SQL}
sized AS (
  SELECT doc_id, (coalesce(octet_length(encode(text)), 0) + 1)::BIGINT AS size,
         xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
           lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM documents, crc_table),
run AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS before,
         sum(size) OVER () AS total FROM sized),
cut AS (SELECT *, (((2 * before + size) * {SHARDS}) // (2 * total))::INTEGER AS shard FROM run)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       NULL::INTEGER AS grown_shard,
       (sum(size) OVER (PARTITION BY shard))::BIGINT AS shard_bytes,
       count(*) OVER (PARTITION BY shard) AS shard_rows
FROM cut
"""


@register("op2_sharding", SQL)
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read_table(spark, sf_dir, "documents"))
