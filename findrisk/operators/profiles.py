"""Statistics per repo, package, weakness and severity, attached to every finding.

Each key gets one fused aggregate that serves all blocks reading it. Rows are
combined before the shuffle and distinct counts are first grouped by (key,
value), so a key holding much of the table does not reach one task as raw rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from findrisk.functions.numbers import number, ratio
from findrisk.functions.text import lower_strip
from findrisk.operators.canonical import field
from findrisk.operators.lookup import attach
from findrisk.storage import stage

# Action words counted as fixed, skipped and false positive in histories.
FIXED_ACTIONS = ("fixed", "remediated", "patched")
SKIPPED_ACTION = "skipped"
FALSE_POSITIVE_ACTIONS = ("false_positive", "false positive")
REPO_FALSE_POSITIVE = "false_positive"

# Canonical columns the profiles are made from.
SOURCE_COLUMNS = (
    "repo", "package_name", "primary_cwe", "severity", "user_action", "cve_id", "published_date",
    "cvss_score", "epss_score", "has_patch", "transitive_dep_count",
)
# Columns each block reads, besides the key it groups by.
BLOCK_INPUTS = {
    "package": ("package_name", "cve_id", "_fixed", "_skipped", "_fp"),
    "repo": (
        "_severity", "_action", "_fixed", "_skipped", "_fp", "_package", "_cwe",
        "published_date", "cvss_score", "epss_score", "has_patch", "transitive_dep_count",
    ),
    "user": ("_action", "_fixed", "_skipped", "_fp"),
}
# Where each profile keeps the number of rows of a group.
ROW_COUNT = {
    "_package": "package_name_frequency", "_repo": "repo_total_cves",
    "_cwe": "_n_same_cwe", "_severity": "_n_same_severity", "_home": "_n_same_repo",
}

PACKAGE_NAMES = ("package_name_frequency", "package_name_cve_density")
REPO_NAMES = (
    "repo_total_cves", "repo_cve_count_30d", "repo_cve_count_90d",
    "repo_critical_count", "repo_high_count", "repo_medium_count", "repo_low_count",
    "repo_fix_rate", "repo_false_positive_rate", "repo_skip_rate",
    "repo_avg_cvss", "repo_max_cvss", "repo_avg_epss",
    "repo_severity_ratio_critical", "repo_severity_ratio_high",
    "repo_unique_packages", "repo_unique_cwes",
    "repo_has_patch_rate", "repo_avg_transitive_deps", "repo_cve_velocity",
)
# Suffix of the history features and the key they group by.
HISTORY_KEYS = {"same_cwe": "_cwe", "same_package": "_package", "same_severity": "_severity", "same_repo": "_home"}
HISTORY_NAMES = (
    *[f"historical_{kind}_rate_{suffix}" for suffix in HISTORY_KEYS for kind in ("fix", "skip", "fp")],
    "cwe_action_consistency", "package_action_consistency", "repo_action_diversity", "severity_action_alignment",
)


def _action(df: DataFrame) -> Column:
    return lower_strip(F.coalesce(field(df, "user_action", "").cast("string"), F.lit("nan")))


def _keyed(df: DataFrame) -> DataFrame:
    """Add the group keys with their stand-ins for null, and the three action flags.

    Rows without a repo count as repo "unknown" in the repo block and as repo ""
    in the history; the two keys are equal for all other rows.
    """
    action = _action(df)
    return df.withColumns(
        {
            "_repo": F.coalesce(field(df, "repo", "").cast("string"), F.lit("unknown")),
            "_home": F.coalesce(field(df, "repo", "").cast("string"), F.lit("")),
            "_package": F.coalesce(field(df, "package_name", "").cast("string"), F.lit("")),
            "_cwe": F.coalesce(field(df, "primary_cwe", "").cast("string"), F.lit("")),
            "_severity": F.coalesce(F.upper(field(df, "severity", "UNKNOWN")), F.lit("")),
            "_action": action,
            "_fixed": action.isin(*FIXED_ACTIONS).cast("int"),
            "_skipped": (action == SKIPPED_ACTION).cast("int"),
            "_fp": action.isin(*FALSE_POSITIVE_ACTIONS).cast("int"),
        }
    )


def _history(suffix: str) -> list[Column]:
    return [
        F.sum("_fixed").alias(f"_fixed_{suffix}"),
        F.sum("_skipped").alias(f"_skipped_{suffix}"),
        F.sum("_fp").alias(f"_fp_{suffix}"),
        F.count(F.lit(1)).alias(f"_n_{suffix}"),
    ]


def package_profile(keyed: DataFrame) -> DataFrame:
    """Rows, distinct CVEs and action counts per package."""
    measures = [F.count(F.lit(1)).alias("package_name_frequency"), *_history("same_package")]
    if "cve_id" in keyed.columns:
        named = F.when(F.col("package_name").isNotNull(), F.col("cve_id"))
        measures.append(F.countDistinct(named).alias("package_name_cve_density"))
    return keyed.groupBy("_package").agg(*measures)


def repo_profile(keyed: DataFrame, newest: datetime | None, history: bool) -> DataFrame:
    """Measures of a repo, and on request its history, in one aggregate.

    ``newest`` is the last publication anywhere.
    """
    published = F.col("published_date")
    rows = F.count(F.lit(1))
    severity = F.col("_severity")
    span = F.greatest(F.timestamp_diff("DAY", F.min(published), F.max(published)) + 1, F.lit(1))
    days = F.when(rows == 1, F.lit(1)).otherwise(span)

    def since(count: int) -> Column:
        return F.count_if(published >= F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {count} DAYS"))

    return keyed.groupBy("_repo").agg(
        rows.alias("repo_total_cves"),
        since(30).alias("repo_cve_count_30d"),
        since(90).alias("repo_cve_count_90d"),
        F.count_if(severity == "CRITICAL").alias("repo_critical_count"),
        F.count_if(severity == "HIGH").alias("repo_high_count"),
        F.count_if(severity == "MEDIUM").alias("repo_medium_count"),
        F.count_if(severity == "LOW").alias("repo_low_count"),
        ratio(F.sum("_fixed"), rows).alias("repo_fix_rate"),
        ratio(F.count_if(F.col("_action") == REPO_FALSE_POSITIVE), rows).alias("repo_false_positive_rate"),
        ratio(F.sum("_skipped"), rows).alias("repo_skip_rate"),
        F.avg(number(F.col("cvss_score"))).alias("repo_avg_cvss"),
        F.max(number(F.col("cvss_score"))).alias("repo_max_cvss"),
        F.avg(number(F.col("epss_score"))).alias("repo_avg_epss"),
        ratio(F.count_if(severity == "CRITICAL"), rows).alias("repo_severity_ratio_critical"),
        ratio(F.count_if(severity == "HIGH"), rows).alias("repo_severity_ratio_high"),
        F.countDistinct("_package").alias("repo_unique_packages"),
        F.countDistinct("_cwe").alias("repo_unique_cwes"),
        F.avg(number(F.col("has_patch"))).alias("repo_has_patch_rate"),
        F.avg(number(F.col("transitive_dep_count"))).alias("repo_avg_transitive_deps"),
        F.coalesce(rows / days, F.lit(0.0)).alias("repo_cve_velocity"),
        *(_repo_history() if history else []),
    )


def home_profile(keyed: DataFrame) -> DataFrame:
    """Only the action history of a repo."""
    return keyed.groupBy("_home").agg(*_repo_history())


def _repo_history() -> list[Column]:
    return [F.countDistinct("_action").alias("_repo_actions"), *_history("same_repo")]


def cwe_profile(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("_cwe").agg(*_history("same_cwe"))


def severity_profile(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("_severity").agg(*_history("same_severity"))


def _deviation(suffix: str) -> Column:
    """Sample standard deviation of a 0/1 flag from its count and sum; 0 for one row.

    Both inputs are exact integers, so the result does not depend on row order.
    """
    n, hits = F.col(f"_n_{suffix}").cast("double"), F.col(f"_fixed_{suffix}").cast("double")
    return F.when(n > 1, F.sqrt(hits * (n - hits) / (n * (n - 1.0)))).otherwise(F.lit(0.0))


def _rates(suffix: str, leave_one_out: bool) -> dict[str, Column]:
    """Share of fixed, skipped and false-positive rows in the group of a row."""
    n = F.col(f"_n_{suffix}")
    rates = {}
    for kind, column in (("fix", "_fixed"), ("skip", "_skipped"), ("fp", "_fp")):
        hits = F.col(f"{column}_{suffix}")
        share = ratio(hits - F.col(column), n - 1) if leave_one_out else ratio(hits, n)
        rates[f"historical_{kind}_rate_{suffix}"] = share
    return rates


def history_expressions(distinct_actions: int, leave_one_out: bool) -> dict[str, Column]:
    rates: dict[str, Column] = {}
    for suffix in HISTORY_KEYS:
        rates.update(_rates(suffix, leave_one_out))
    return {
        **rates,
        "cwe_action_consistency": _deviation("same_cwe"),
        "package_action_consistency": _deviation("same_package"),
        "repo_action_diversity": F.col("_repo_actions") / float(max(distinct_actions, 1)),
        "severity_action_alignment": rates["historical_fix_rate_same_severity"],
    }


def grouped_features(
    canonical: DataFrame,
    blocks: Sequence[str] = ("package", "repo", "user"),
    *,
    keep: Sequence[str] = ("finding_id",),
    row_id: str = "finding_id",
    leave_one_out: bool = False,
    mark: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Kept columns plus the grouped features of the given blocks.

    The keyed table is staged once; each profile then reads only its own columns
    and none repeats the work that led to the table.

    ``leave_one_out`` takes the row itself out of its action rates (not out of
    the deviations and the diversity); a row alone in its group then gets 0.
    ``mark`` may add columns to the staged rows before statistics are attached.
    """
    keys = {"package": ["_package"], "repo": ["_repo"], "user": list(HISTORY_KEYS.values())}
    inputs = [name for block in blocks for name in (*keys[block], *BLOCK_INPUTS[block])]
    keyed = stage(_keyed(canonical).select(*dict.fromkeys([*keep, row_id, *inputs])), "keyed")
    overall: dict = {}
    if "repo" in blocks or "user" in blocks:
        totals = {"actions": F.countDistinct("_action")}
        if "repo" in blocks:
            totals["newest"] = F.max("published_date")
            totals["named"] = F.coalesce(F.max((F.col("_repo") != "").cast("int")), F.lit(0))
        if "repo" in blocks and "user" in blocks:
            totals["nameless"] = F.count_if(F.col("_repo") != F.col("_home"))
        overall = keyed.agg(*[column.alias(name) for name, column in totals.items()]).first().asDict()

    # Where no row lacks a repo, one aggregate serves the repo block and the history.
    fused = overall.get("nameless") == 0
    needs: dict[str, list[str]] = {key: [] for block in blocks for key in keys[block]}
    if "package" in blocks:
        needs["_package"] += PACKAGE_NAMES
    if "repo" in blocks:
        needs["_repo"] += REPO_NAMES
    if "user" in blocks:
        for suffix, key in HISTORY_KEYS.items():
            place = "_repo" if fused and key == "_home" else key
            needs[place] += [f"{column}_{suffix}" for column in ("_fixed", "_skipped", "_fp", "_n")]
        needs["_repo" if fused else "_home"].append("_repo_actions")
    needs = {key: names for key, names in needs.items() if names}
    makers = {
        "_package": package_profile,
        "_repo": lambda table: repo_profile(table, overall["newest"], fused),
        "_home": home_profile,
        "_cwe": cwe_profile,
        "_severity": severity_profile,
    }
    own = ["_fixed", "_skipped", "_fp"] if leave_one_out and "user" in blocks else []
    rows = mark(keyed) if mark else keyed
    marks = [name for name in rows.columns if name not in keyed.columns]
    facts = rows.select(*dict.fromkeys([*keep, row_id, *own, *needs, *marks]))
    for key in needs:
        stats = makers[key](keyed).select(key, F.col(ROW_COUNT[key]).alias("_weight"), *needs[key])
        facts = attach(facts, stats, key, weight="_weight", spread_by=F.col(row_id))

    features: dict[str, Column] = {}
    if "package" in blocks:
        features.update({name: F.coalesce(F.col(name), F.lit(0)) for name in PACKAGE_NAMES})
    if "repo" in blocks:
        # Without a single named repo the whole block says nothing.
        features.update({name: F.col(name) if overall["named"] else F.lit(0) for name in REPO_NAMES})
    if "user" in blocks:
        features.update(history_expressions(overall["actions"], leave_one_out))
    kept = [F.col(name) for name in dict.fromkeys([*keep, *marks]) if name not in features]
    return facts.select(*kept, *[column.alias(name) for name, column in features.items()])
