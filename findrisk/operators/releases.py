"""Release over release: statistics, deltas, and what came and went.

Everything is computed for all repos at once. A repo may hold much of the
table; rows are therefore combined per (repo, release) or cut to the needed top
rows inside each task before any shuffle by repo.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from findrisk.functions.numbers import mean4
from findrisk.functions.versions import version_number, version_parts
from findrisk.operators.dashboard import FIXED
from findrisk.operators.lookup import BROADCAST_BYTES, attach
from findrisk.operators.scoring import TIERS
from findrisk.operators.topk import first_per_group
from findrisk.storage import stage

# What the comparison reads of the ranked table.
COMPARED_COLUMNS = (
    "finding_id", "repo", "release", "cve_id", "risk_score", "tier", "package_name", "primary_cwe", "user_action", "has_patch",
)
STAT_NAMES = (
    "total_vulns", "avg_risk_score", "max_risk_score", *[f"{tier.lower()}_count" for tier in TIERS],
    "unique_packages", "patch_rate", "fix_rate",
)


def _release_order(order: str) -> list[Column]:
    """Releases sort as text, so v10 comes before v2; "version" sorts by numbers first."""
    if order == "text":
        return [F.col("release")]
    parts = version_parts(F.col("release"))
    return [version_number(parts, 0), version_number(parts, 1), version_number(parts, 2), F.col("release")]


def _ordered(counted: DataFrame, order: str) -> DataFrame:
    """Positions of releases within their repo, from rows of ``repo, release, n``."""
    keys = _release_order(order)
    forward = Window.partitionBy("repo").orderBy(*keys)
    backward = Window.partitionBy("repo").orderBy(*[key.desc() for key in keys])
    return counted.select(
        "repo",
        "release",
        "n",
        F.coalesce(F.lag("release").over(forward), F.col("release")).alias("before"),
        F.row_number().over(backward).alias("from_end"),
        F.count(F.lit(1)).over(Window.partitionBy("repo")).alias("n_releases"),
    )


def release_list(ranked: DataFrame, order: str = "text") -> DataFrame:
    """Distinct releases per repo with position from the end, the one before, and row count."""
    counted = ranked.filter("repo is not null and release is not null").groupBy("repo", "release").agg(F.count(F.lit(1)).alias("n"))
    return _ordered(counted, order)


def release_pairs(ranked: DataFrame, *, current: str | None = None, previous: str | None = None, order: str = "text") -> DataFrame:
    """The two releases to compare in each repo with at least two.

    Default: the last release and the one before it. A named current release is
    compared with the one before it, the first one with itself. Repos that lack
    a named release are left out; :func:`release_eligibility` tells why.
    """
    return _pairs(release_list(ranked, order), current, previous)


def _pairs(releases: DataFrame, current: str | None = None, previous: str | None = None) -> DataFrame:
    chosen = releases.filter(F.col("release") == current) if current else releases.filter("from_end = 1")
    pairs = chosen.filter("n_releases >= 2").select(
        "repo", F.col("release").alias("current_release"), F.col("before").alias("previous_release"), "n_releases"
    )
    if previous:
        having = releases.filter(F.col("release") == previous).select("repo")
        pairs = pairs.join(having, "repo", "left_semi").withColumn("previous_release", F.lit(previous))
    return pairs


def release_eligibility(ranked: DataFrame, *, current: str | None = None, previous: str | None = None) -> DataFrame:
    """Release count per repo and why it cannot be compared, null if it can."""
    per_release = ranked.filter("repo is not null").groupBy("repo", "release").agg(F.count(F.lit(1)).alias("n"))
    facts = per_release.groupBy("repo").agg(
        F.count("release").alias("n_releases"),
        *[F.max(F.col("release") == name).alias(alias) for alias, name in (("_c", current), ("_p", previous)) if name],
    )
    reason = F.when(F.col("n_releases") == 0, "no release data")
    reason = reason.when(F.col("n_releases") < 2, "needs at least two releases")
    for alias, name, text in (("_c", current, "current"), ("_p", previous, "previous")):
        if name:
            reason = reason.when(~F.coalesce(F.col(alias), F.lit(False)), f"{text} release not found")
    return facts.select("repo", "n_releases", reason.alias("reject_reason"))


def release_stats(ranked: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Statistics of every release of every repo; ``also`` names columns constant within a repo to keep."""
    rows = F.count(F.lit(1))
    return ranked.filter("release is not null").groupBy("repo", "release", *also).agg(
        rows.alias("total_vulns"),
        mean4(F.col("risk_score")).alias("avg_risk_score"),
        F.max("risk_score").alias("max_risk_score"),
        *[F.count_if(F.col("tier") == tier).alias(f"{tier.lower()}_count") for tier in TIERS],
        F.countDistinct("package_name").alias("unique_packages"),
        (F.count_if(F.col("has_patch") != 0) / rows).alias("patch_rate"),
        (F.count_if(F.col("user_action") == FIXED) / rows).alias("fix_rate"),
    )


def release_top_cves(ranked: DataFrame, n: int = 5) -> DataFrame:
    """Riskiest findings of every release."""
    top = first_per_group(ranked.filter("release is not null"), ["repo", "release"], [F.desc("risk_score"), F.asc("finding_id")], n)
    return top.select("repo", "release", "rank", "finding_id", "cve_id", "risk_score", "tier", "package_name", "primary_cwe")


def release_top_cwes(ranked: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent weaknesses of every release."""
    counts = ranked.filter("release is not null and primary_cwe is not null").groupBy("repo", "release", "primary_cwe").agg(
        F.count("cve_id").alias("count")
    )
    top = first_per_group(counts, ["repo", "release"], [F.desc("count"), F.asc("primary_cwe")], n)
    return top.withColumnRenamed("primary_cwe", "cwe")


def release_top_packages(ranked: DataFrame, n: int = 5) -> DataFrame:
    """Packages with most findings in every release."""
    counts = ranked.filter("release is not null and package_name is not null").groupBy("repo", "release", "package_name").agg(
        F.count("cve_id").alias("count"), mean4(F.col("risk_score")).alias("avg_risk")
    )
    top = first_per_group(counts, ["repo", "release"], [F.desc("count"), F.asc("package_name")], n)
    return top.withColumnRenamed("package_name", "package")


def compared_rows(
    ranked: DataFrame, pairs: DataFrame | None = None, order: str = "text", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Rows of the two compared releases of each repo, with both release names.

    The compared columns are staged in one scan of the ranked table, pairs and row
    counts come from there. The result is staged too: the functions below accept it
    in place of the ranked table.
    """
    narrow = stage(ranked.select(*COMPARED_COLUMNS), "compared-columns")
    counted = stage(release_list(narrow, order), "releases")
    pairs = _pairs(counted) if pairs is None else pairs
    # row counts tell which repos are too large to join by shuffle in one task
    sizes = counted.groupBy("repo").agg(F.sum("n").alias("_rows"))
    named = pairs.select("repo", "current_release", "previous_release").join(sizes, "repo")
    rows = attach(narrow, named, "repo", weight="_rows", spread_by=F.col("finding_id"), broadcast_bytes=broadcast_bytes)
    return stage(rows.filter("release = current_release or release = previous_release"), "compared")


def _compared(table: DataFrame, pairs: DataFrame | None) -> DataFrame:
    return table if "current_release" in table.columns else compared_rows(table, pairs)


#: Releases per word of a bit set.
WORD = 64


@dataclass(frozen=True)
class ReleaseSets:
    """Which releases of a repo hold which values of a column.

    ``sets`` has a row ``repo, value, word, bits`` per 64 releases with the value:
    bit b stands for the release at position 64 * word + b. ``releases`` has the
    positions. Both are staged; they answer for any pair of releases.
    """

    column: str
    releases: DataFrame
    sets: DataFrame


def release_sets(ranked: DataFrame, column: str, order: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> ReleaseSets:
    """Bit sets over release positions of every (repo, value), from one scan of the table.

    Rows are first counted per (repo, release, value); releases, their positions and
    the bit sets follow from the counts. Null values are in no set, releases with
    nothing else still have a position.
    """
    rows = ranked.filter("repo is not null and release is not null")
    counts = stage(rows.groupBy("repo", "release", F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")), "release-values")
    per_release = counts.groupBy("repo", "release").agg(F.sum("n").alias("n"), F.count("value").alias("values"))
    releases = stage(_ordered(per_release, order).withColumn("position", F.col("n_releases") - F.col("from_end")), "releases")
    # values per release tell which releases are too large to join by shuffle in one task
    key = F.concat_ws("\u0000", "repo", "release")
    weighted = releases.join(per_release.select("repo", "release", "values"), ["repo", "release"])
    placed = attach(
        counts.filter("value is not null").select("repo", "value", key.alias("_release")),
        weighted.select(key.alias("_release"), "position", "values"),
        "_release", weight="values", spread_by=F.col("value"), broadcast_bytes=broadcast_bytes,
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("position", F.lit(WORD)).cast("int"))
    sets = placed.groupBy("repo", "value", F.floor(F.col("position") / WORD).alias("word")).agg(F.bit_or(bit).alias("bits"))
    return ReleaseSets(column, releases, stage(sets, "release-sets"))


def _holds(position: str) -> Column:
    """Whether a bit set's row has the bit of a position."""
    bit = F.call_function("getbit", F.col("bits"), F.pmod(position, F.lit(WORD)).cast("int")) == 1
    return ((F.col("word") == F.floor(F.col(position) / WORD)) & bit).cast("int")


def changes(sets: ReleaseSets, pairs: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``repo, value, current_release, previous_release, in_current, in_previous`` for a pair of releases of each repo."""
    pairs = _pairs(sets.releases) if pairs is None else pairs
    place = lambda name, at: sets.releases.select("repo", F.col("release").alias(name), F.col("position").alias(at))
    sizes = sets.releases.groupBy("repo").agg(F.sum("n").alias("_rows"))
    ends = pairs.select("repo", "current_release", "previous_release")
    ends = ends.join(place("current_release", "current_at"), ["repo", "current_release"]).join(place("previous_release", "previous_at"), ["repo", "previous_release"])
    named = attach(sets.sets, ends.join(sizes, "repo"), "repo", weight="_rows", spread_by=F.col("value"), broadcast_bytes=broadcast_bytes)
    return named.filter("current_at is not null").groupBy("repo", "value", "current_release", "previous_release").agg(
        F.max(_holds("current_at")).alias("in_current"), F.max(_holds("previous_at")).alias("in_previous")
    )


def release_churn(sets: ReleaseSets) -> DataFrame:
    """New, common and resolved values of every release against the one before it, all releases of all repos at once.

    A set moved up by one release and compared with itself gives the common values;
    the bit that leaves a word goes to the next one.
    """
    behind = Window.partitionBy("repo", "value").orderBy("word")
    before = F.when(F.lag("word").over(behind) == F.col("word") - 1, F.lag("bits").over(behind)).otherwise(0)
    moved = F.call_function("shiftleft", F.col("bits"), F.lit(1)).bitwiseOR(F.call_function("shiftrightunsigned", before, F.lit(WORD - 1)))
    both = sets.sets.withColumn("common", F.col("bits").bitwiseAND(moved))
    bits = both.select("repo", "word", "bits", "common", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("b"))
    # numbers of values per release: a repo has as many rows as releases from here on
    has = lambda name: F.call_function("getbit", F.col(name), F.col("b")) == 1
    counted = bits.filter(has("bits")).groupBy("repo", (F.col("word") * WORD + F.col("b")).alias("position")).agg(
        F.count(F.lit(1)).alias("held"), F.count_if(has("common")).alias("common")
    )
    zero = F.lit(0).cast("long")
    listed = sets.releases.select("repo", "release", "before", "position").join(counted, ["repo", "position"], "left")
    held, common = F.coalesce("held", zero), F.coalesce("common", zero)
    earlier = F.lag(held).over(Window.partitionBy("repo").orderBy("position"))
    return listed.select("repo", "release", "before", held.alias("held"), (held - common).alias("new"), (earlier - common).alias("resolved"), "position").filter("position > 0").drop("position")


@dataclass(frozen=True)
class ReleaseHistory:
    """The compared columns of the ranked table and the bit sets of its CVEs, for any number of comparisons."""

    rows: DataFrame
    cves: ReleaseSets


def release_history(ranked: DataFrame, order: str = "text") -> ReleaseHistory:
    """One scan of the ranked table; the bit sets come from what it staged."""
    rows = stage(ranked.select(*COMPARED_COLUMNS), "release-rows")
    return ReleaseHistory(rows, release_sets(rows, "cve_id", order))


def _changed_cves(table: DataFrame | ReleaseHistory, pairs: DataFrame | None, sides: tuple[str, str], n: int) -> DataFrame:
    """Top rows of CVEs on one side only; rows without a CVE are on neither, as in the counts.

    Rows are first cut to ``n`` per (repo, CVE): no others can be among the
    first ``n`` of the repo, and a CVE with very many rows does not reach one task.
    """
    mine, other = sides
    order = [F.desc("risk_score"), F.asc("finding_id")]
    if isinstance(table, DataFrame):
        # one comparison: its two releases are compared as they are
        rows = _compared(table, pairs).filter("cve_id is not null")
        short = first_per_group(rows.filter(F.col("release") == F.col(f"{mine}_release")), ["repo", "cve_id"], order, n, "_rank")
        others = rows.filter(F.col("release") == F.col(f"{other}_release")).select("repo", "cve_id").distinct()
        left = short.join(others, ["repo", "cve_id"], "left_anti")
    else:
        pairs = stage(_pairs(table.cves.releases) if pairs is None else pairs, "pairs")
        changed = changes(table.cves, pairs).filter((F.col(f"in_{mine}") == 1) & (F.col(f"in_{other}") == 0))
        sizes = table.cves.releases.groupBy("repo").agg(F.sum("n").alias("_rows"))
        sides_of = pairs.select("repo", F.col(f"{mine}_release").alias("_mine")).join(sizes, "repo")
        rows = attach(table.rows.filter("cve_id is not null"), sides_of, "repo", weight="_rows", spread_by=F.col("finding_id"))
        short = first_per_group(rows.filter("release = _mine"), ["repo", "cve_id"], order, n, "_rank")
        left = short.join(changed.select("repo", F.col("value").alias("cve_id")), ["repo", "cve_id"], "left_semi")
    top = first_per_group(left, ["repo"], order, n)
    return top.select("repo", "release", "rank", "finding_id", "cve_id", "risk_score", "tier", "package_name")


def new_cves(table: DataFrame | ReleaseHistory, pairs: DataFrame | None = None, n: int = 10) -> DataFrame:
    """Riskiest rows of CVEs in the current release but not in the previous one."""
    return _changed_cves(table, pairs, ("current", "previous"), n)


def resolved_cves(table: DataFrame | ReleaseHistory, pairs: DataFrame | None = None, n: int = 10) -> DataFrame:
    """Riskiest rows of CVEs in the previous release but no longer in the current one."""
    return _changed_cves(table, pairs, ("previous", "current"), n)


def _presence(compared: DataFrame, column: str) -> DataFrame:
    """Per repo and value: seen in the current release, seen in the previous one."""
    return compared.filter(F.col(column).isNotNull()).groupBy("repo", F.col(column).alias("value")).agg(
        F.max((F.col("release") == F.col("current_release")).cast("int")).alias("in_current"),
        F.max((F.col("release") == F.col("previous_release")).cast("int")).alias("in_previous"),
    )


def _changed_cwes(table: DataFrame | ReleaseSets, pairs: DataFrame | None, condition: str) -> DataFrame:
    if isinstance(table, DataFrame) and "current_release" in table.columns:
        seen = _presence(table, "primary_cwe")
    else:
        seen = changes(table if isinstance(table, ReleaseSets) else release_sets(table, "primary_cwe"), pairs)
    return seen.filter(condition).select("repo", F.col("value").alias("cwe")).orderBy("repo", "cwe")


def new_cwes(table: DataFrame | ReleaseSets, pairs: DataFrame | None = None) -> DataFrame:
    """Weaknesses of the current release that the previous one did not have, one row each."""
    return _changed_cwes(table, pairs, "in_current = 1 and in_previous = 0")


def resolved_cwes(table: DataFrame | ReleaseSets, pairs: DataFrame | None = None) -> DataFrame:
    """Weaknesses of the previous release that the current one no longer has, one row each."""
    return _changed_cwes(table, pairs, "in_current = 0 and in_previous = 1")


def changed_cve_counts(table: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Number of distinct new and resolved CVEs per repo."""
    return _presence(_compared(table, pairs), "cve_id").groupBy("repo").agg(
        F.count_if((F.col("in_current") == 1) & (F.col("in_previous") == 0)).alias("new_cve_count"),
        F.count_if((F.col("in_current") == 0) & (F.col("in_previous") == 1)).alias("resolved_cve_count"),
    )


def compared_stats(rows: DataFrame) -> DataFrame:
    """Statistics of both compared releases of each repo, from compared rows."""
    return release_stats(rows, also=("current_release", "previous_release"))


def release_delta(table: DataFrame, pairs: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Change from the previous to the current release of each repo.

    The statistics of both releases, two rows per repo, are folded into one row;
    ``stats`` gives them where they have been worked out before.
    """
    rows = _compared(table, pairs)
    stats = compared_stats(rows) if stats is None else stats
    sides = {"c": F.col("release") == F.col("current_release"), "p": F.col("release") == F.col("previous_release")}
    folded = stats.groupBy("repo", "current_release", "previous_release").agg(
        *[F.max(F.when(is_side, F.col(name))).alias(f"{side}_{name}") for side, is_side in sides.items() for name in STAT_NAMES]
    )

    def change(name: str) -> Column:
        return F.col(f"c_{name}") - F.col(f"p_{name}")

    zero = F.lit(0).cast("bigint")
    return folded.join(changed_cve_counts(rows), "repo", "left").select(
        "repo",
        "current_release",
        "previous_release",
        change("total_vulns").alias("vuln_count_change"),
        (change("total_vulns") / F.greatest(F.col("p_total_vulns"), F.lit(1))).alias("vuln_count_change_pct"),
        change("avg_risk_score").alias("avg_risk_change"),
        change("critical_count").alias("critical_change"),
        change("high_count").alias("high_change"),
        change("patch_rate").alias("patch_rate_change"),
        F.coalesce("new_cve_count", zero).alias("new_cve_count"),
        F.coalesce("resolved_cve_count", zero).alias("resolved_cve_count"),
    )
