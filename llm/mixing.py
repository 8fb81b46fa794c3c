"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from llm.frames import join_rows, read_table, require, row_key, running_totals, sheltered, sql_identifier, stage
from llm.registry import register

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Size of the mix as a share of all sizes, in percent.
BUDGET_PERCENT = 150
#: Largest target of a source as a multiple of its size.
MOST_EPOCHS = 2
SEED = "mix-1"
#: Expected copies are whole multiples of 1 / UNIT, so that prefix sums are exact.
UNIT = 1 << 32


def targets(sizes: DataFrame, weights: Sequence[int], budget_percent: int, most_epochs: int) -> DataFrame:
    """Target words per source, from one row per source (``__null, __name, source_size``).

    Shares follow the weights; a target stops at ``most_epochs`` times its
    source's size and the excess goes to the others by weight, until none is
    above. Sources fill up in the order of size per weight, so the level comes
    from one running sum over the sources. All of the budget is placed if it is
    at most ``most_epochs`` times everything.
    """
    by_name = Window.orderBy("__null", "__name")
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")
    )
    everything = Window.partitionBy()
    fill = Window.orderBy("__ratio", "__null", "__name")
    earlier = fill.rowsBetween(Window.unboundedPreceding, -1)
    later = fill.rowsBetween(0, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("__weight", weight)
        .withColumn("__cap", F.col("source_size") * float(most_epochs))
        .withColumn("__ratio", F.col("__cap") / F.col("__weight"))
    )
    levelled = ranked.withColumns(
        {
            "__budget": F.sum("source_size").over(everything) * float(budget_percent) / 100.0,
            "__full": F.coalesce(F.sum("__cap").over(earlier), F.lit(0.0)),
            "__open": F.sum("__weight").over(later),
        }
    ).withColumn("__level", (F.col("__budget") - F.col("__full")) / F.col("__open"))
    # the first source, in fill order, that its level does not fill sets the level of all later ones;
    # levels computed after it are no higher
    found = levelled.withColumn("__final", F.max(F.when(F.col("__level") <= F.col("__ratio"), F.col("__level"))).over(everything))
    return found.select(
        "__null",
        "__name",
        "source_size",
        F.least(F.col("__cap"), F.coalesce(F.col("__final") * F.col("__weight"), F.col("__cap"))).alias("target"),
    )


def word_count(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def crossings(before: Column, rate: Column, offset: Column) -> Column:
    """Whole numbers between ``before * rate + offset`` and the same plus ``rate``, all three in units of 1 / UNIT.

    Only the fractions decide beyond the rate's whole part. The product is taken
    modulo UNIT in two halves of 16 bits, so it fits a long for any rank.
    """
    fraction = rate.bitwiseAND(F.lit(UNIT - 1))
    high = F.shiftright(before.bitwiseAND(F.lit(UNIT - 1)), 16) * fraction
    low = before.bitwiseAND(F.lit((1 << 16) - 1)) * fraction
    phase = (F.shiftleft(high.bitwiseAND(F.lit((1 << 16) - 1)), 16) + low + offset).bitwiseAND(F.lit(UNIT - 1))
    return F.shiftright(rate, 32) + F.shiftright(phase + fraction, 32)


def copies(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    budget_percent: int = BUDGET_PERCENT,
    most_epochs: int = MOST_EPOCHS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] = (),
) -> DataFrame:
    """How often the mix takes each document.

    Returns ``doc_id, source, size, source_size, target, copies, taken`` and the
    columns in ``keep``, one row per document. Within a source, documents stand
    in the order of size, id and text hash; each one's expected copies (target
    over size of its source) are added up, one random offset per source is added,
    and a document is taken once for each whole number its stretch crosses. It is
    therefore taken the whole part of its expected copies or once more, never more
    than ``most_epochs`` times; as neighbours have like sizes, the words taken
    differ from the target by about one document at most.

    The offset comes from a hash of seed and source: reruns agree. Null and empty
    texts have size 0 and are drawn like any other; a null source is a source of
    its own, the last in order; a source without words has target 0 and is not
    taken. Rows equal in source, size, id and text are interchangeable. An empty
    table gives no rows.
    """
    require(docs, id_col, text_col, source_col)
    text, source = F.col(sql_identifier(text_col)), F.col(sql_identifier(source_col))
    narrow = docs.select(
        F.col(sql_identifier(id_col)).alias("doc_id"),
        source.alias("source"),
        F.isnull(source).cast("int").alias("__null"),
        F.coalesce(source, F.lit("")).alias("__name"),
        word_count(text).alias("size"),
        F.xxhash64(text).alias("__text"),
        *keep,
    )
    narrow = stage(narrow, "sizes")
    sizes = narrow.groupBy("__null", "__name").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, weights, budget_percent, most_epochs).withColumn(
        "__rate", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * float(UNIT) + 0.5)).otherwise(0).cast("long")
    )
    named = F.concat(F.lit(seed), F.lit("|"), F.col("__null").cast("string"), F.lit("|"), F.col("__name"))
    goals = goals.withColumn("__offset", F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("long"))
    placed = running_totals(narrow, ["size", "doc_id", "__text"], [], group=["__null", "__name"])
    joined = placed.join(goals, ["__null", "__name"])
    # every document of a source has the same expected copies, so their prefix sum is rank times rate
    crossed = crossings(F.col("before_rows"), F.col("__rate"), F.col("__offset"))
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", crossed.alias("copies"), (crossed * F.col("size")).alias("taken"), *keep
    )


@sheltered
def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mix itself: every document as often as ``copies`` says, with the columns of ``docs``."""
    keyed = row_key(docs, id_col)
    key = ["__id", "__hash", "__copy"]
    counts = copies(keyed, id_col=id_col, text_col=text_col, source_col=source_col, keep=key, **settings)
    taken = counts.filter("copies > 0").select(*key, F.col("copies").alias("__copies"))
    return (
        join_rows(keyed, taken)
        .withColumn("__again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
        .select(*[sql_identifier(name) for name in docs.columns])
    )


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, (source IS NULL)::INTEGER AS nul, coalesce(source, '') AS name,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
per AS (SELECT nul, name, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
weighted AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY nul, name) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END)::DOUBLE AS w FROM per),
ranked AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio FROM weighted),
levelled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 150.0::DOUBLE / 100.0::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY ratio, nul, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY ratio, nul, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM ranked),
goals AS (
  SELECT nul, name, source_size,
         least(cap, coalesce(max(CASE WHEN lev <= ratio THEN lev END) OVER () * w, cap)) AS target
  FROM levelled),
rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 4294967296.0::DOUBLE + 0.5)::BIGINT ELSE 0 END AS rate,
         ('0x' || substr(md5('{SEED}|' || nul || '|' || name), 1, 8))::BIGINT AS off
  FROM goals),
placed AS (
  SELECT s.doc_id, s.source, s.size, r.source_size, r.target, r.rate, r.off,
         row_number() OVER (PARTITION BY s.nul, s.name ORDER BY s.size, s.doc_id NULLS FIRST) - 1 AS rank
  FROM sized s JOIN rated r ON s.nul = r.nul AND s.name = r.name)
SELECT doc_id, source, size, source_size, target,
       (((rank + 1) * rate + off) >> 32) - ((rank * rate + off) >> 32) AS copies,
       ((((rank + 1) * rate + off) >> 32) - ((rank * rate + off) >> 32)) * size AS taken
FROM placed
"""


@register("op6_mixing", SQL)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(read_table(spark, sf_dir, "documents"))
