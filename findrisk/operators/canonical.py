"""One canonical schema for findings from any source, and training labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from findrisk.functions.dates import to_utc
from findrisk.functions.numbers import TRUE_WORDS, flag, number, whole
from findrisk.functions.text import list_head, list_size, lower_strip, mentions, text_or_blank, upper_strip
from findrisk.storage import stage

# The canonical columns in order.
CANONICAL_COLUMNS = (
    "cve_id", "vuln_id", "title", "repo", "release",
    "package_name", "package_version", "ecosystem", "purl",
    "severity", "cvss_score", "cvss_vector", "epss_score", "epss_percentile",
    "published_date", "modified_date", "release_date", "detection_time",
    "has_patch", "fix_versions", "patch_recommendation",
    "cwes", "cwe_count", "primary_cwe",
    "cve_description", "num_references", "sources", "num_sources",
    "transitive_dep_count", "is_withdrawn", "user_action", "status", "licence",
)
SCORE_COLUMNS = ("cvss_score", "epss_score", "epss_percentile")
DATE_COLUMNS = ("published_date", "modified_date", "release_date", "detection_time")

# Severity words and their rank.
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "UNKNOWN": 0}

# Action words behind the two label classes.
POSITIVE_ACTIONS = ("fixed", "remediated", "patched", "accepted")
NEGATIVE_ACTIONS = ("false_positive", "false positive", "skipped", "ignored", "deferred")


def field(df: DataFrame, name: str, default) -> Column:
    """Column of ``df`` if it has one of that name, else a literal."""
    return F.col(name) if name in df.columns else F.lit(default)


def severity_rank(severity: Column) -> Column:
    """4 for CRITICAL down to 0 for UNKNOWN or anything else."""
    ranked = F.lit(0)
    for word, rank in SEVERITY_RANK.items():
        ranked = F.when(severity == word, rank).otherwise(ranked)
    return ranked


def _truth(column: Column, data_type: T.DataType) -> Column:
    """1 for true, a non-zero number (NaN included) or one of the accepted words."""
    if isinstance(data_type, T.BooleanType):
        return flag(column)
    if isinstance(data_type, T.NumericType):
        return flag(column != 0)
    return flag(lower_strip(column.cast("string")).isin(*TRUE_WORDS))


def canonicalize(df: DataFrame, *, strict_cwe: bool = False) -> DataFrame:
    """Bring a findings table to the canonical schema; other columns are kept.

    ``primary_cwe`` is the first entry of ``cwes``. Where ``cwes`` is blank a
    given ``primary_cwe`` is kept, unless ``strict_cwe`` asks to blank it.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    severity = upper_strip(field(df, "severity", "").cast("string"))
    # read several times below, so worked out first, once per row
    df = df.withColumn("__known", F.when(severity.isin(*[word for word in SEVERITY_RANK]), severity).otherwise("UNKNOWN"))
    known = F.col("__known")
    cwes = text_or_blank(field(df, "cwes", "").cast("string"))
    given_cwe = F.lit("") if strict_cwe else text_or_blank(field(df, "primary_cwe", "").cast("string"))
    head = list_head(cwes)
    withdrawn = mentions(field(df, "title", ""), "withdrawn") | mentions(field(df, "status", ""), "withdrawn")

    rules = {
        "severity": known,
        "cwes": cwes,
        "cwe_count": list_size(cwes),
        "primary_cwe": F.when(head == "", given_cwe).otherwise(head),
        "has_patch": _truth(F.col("has_patch"), types["has_patch"]) if "has_patch" in types else F.lit(0),
        "is_withdrawn": flag(withdrawn),
        "user_action": lower_strip(F.coalesce(field(df, "user_action", "").cast("string"), F.lit("nan"))),
        "num_references": whole(field(df, "num_references", 0)),
        "num_sources": list_size(field(df, "sources", "").cast("string")),
        "transitive_dep_count": whole(field(df, "transitive_dep_count", 0)),
    }
    for name in SCORE_COLUMNS:
        rules[name] = number(field(df, name, 0.0))
    for name in DATE_COLUMNS:
        rules[name] = to_utc(F.col(name), types[name]) if name in types else F.lit(None).cast("timestamp")
    for name in CANONICAL_COLUMNS:
        rules.setdefault(name, field(df, name, "").cast("string"))

    extras = [name for name in df.columns if name not in rules and name not in ("severity_numeric", "__known")]
    return df.select(
        *[F.col(name) for name in extras],
        *[rules[name].alias(name) for name in CANONICAL_COLUMNS],
        severity_rank(known).alias("severity_numeric"),
    )


def add_finding_id(df: DataFrame) -> DataFrame:
    """Give every row an id if the source has none.

    The id is a hash of the row's values; rows equal in all of them are numbered.
    It does not depend on partitions, so a table read again, or in other splits,
    gets the same ids. The rows are staged once, with the partition they came in:
    equal rows are numbered within a partition and the counts of the partitions
    are added up, so a row that repeats very often is not sent to one task.
    """
    if "finding_id" in df.columns:
        return df
    columns = [F.col(f"`{name}`") for name in df.columns]
    hashed = df.withColumns(
        {
            "__row": F.xxhash64(*columns, *[column.isNull() for column in columns]),
            "__twin": F.hash(*columns),
            "__part": F.spark_partition_id(),
        }
    )
    rows = stage(hashed, "numbered")
    key = ["__row", "__twin", "__part"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__row", "__twin").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*key, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy("__row"))
    number = F.col("__before") + F.col("__number")
    name = F.concat(
        F.lit("row-"), F.lower(F.hex("__row")), F.lower(F.hex("__twin")),
        F.when(number > 1, F.concat(F.lit("-"), number.cast("string"))).otherwise(""),
    )
    numbered = rows.withColumn("__number", inside).join(offsets, key)
    return numbered.withColumn("finding_id", name).drop(*key, "__number", "__before")


def create_label(df: DataFrame, positive_actions: Sequence[str] = POSITIVE_ACTIONS) -> DataFrame:
    """Add ``label``: 1 for positive actions, 0 for negative ones, null for the rest."""
    action = lower_strip(F.col("user_action").cast("string"))
    label = F.when(action.isin(*positive_actions), 1).when(action.isin(*NEGATIVE_ACTIONS), 0)
    return df.withColumn("label", label.cast("int"))


def drop_unlabelled(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label").isNotNull())
