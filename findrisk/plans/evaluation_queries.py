"""Evaluation of a score and train/test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from findrisk.operators import evaluation, splits
from findrisk.operators.canonical import create_label, drop_unlabelled
from findrisk.plans.feature_queries import _LABEL_SQL
from findrisk.plans.findings import canonical, on, scored
from findrisk.plans.registry import query, settle_sql, settled


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and normalised CVSS of every labelled finding."""
    table = drop_unlabelled(create_label(scored(spark, sf_dir)))
    return table.select("finding_id", "label", F.col("normalized_cvss").alias("score"))


_SCORES_SQL = f"labelled AS (SELECT finding_id, {_LABEL_SQL} AS label, normalized_cvss AS score FROM scored WHERE {_LABEL_SQL} IS NOT NULL)"
_CELLS_SQL = f"""{_SCORES_SQL}, cells AS (SELECT count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp,
  count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label = 0 AND score < 0.5) AS tn FROM labelled)"""


@query(
    "eval_metrics",
    on("scored", f"""{_CELLS_SQL} SELECT {settle_sql('tp::DOUBLE / (tp + fp)')} AS precision, {settle_sql('tp::DOUBLE / (tp + fn)')} AS recall,
  {settle_sql('2 * tp::DOUBLE / (2 * tp + fp + fn)')} AS f1, {settle_sql('(tp + tn)::DOUBLE / (tp + fp + fn + tn)')} AS accuracy,
  0.5::DOUBLE AS threshold, tp + fp + fn + tn AS total_samples, {settle_sql('(tp + fn)::DOUBLE / (tp + fp + fn + tn)')} AS positive_rate FROM cells"""),
)
def eval_metrics_query(spark, sf_dir):
    return settled(evaluation.classification_metrics(labelled_scores(spark, sf_dir)))


@query(
    "eval_confusion",
    on("scored", f"""{_CELLS_SQL} SELECT 0 AS actual, 0 AS predicted, tn AS "count" FROM cells UNION ALL SELECT 0, 1, fp FROM cells
UNION ALL SELECT 1, 0, fn FROM cells UNION ALL SELECT 1, 1, tp FROM cells"""),
)
def eval_confusion_query(spark, sf_dir):
    return evaluation.confusion_matrix(labelled_scores(spark, sf_dir))


_CURVE_SQL = f"""{_SCORES_SQL}, per_score AS (SELECT score AS threshold, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM labelled GROUP BY score),
curve AS (SELECT *, sum(pos) OVER (ORDER BY threshold DESC) AS cum_pos, sum(neg) OVER (ORDER BY threshold DESC) AS cum_neg,
  sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg FROM per_score)"""


@query(
    "eval_auc",
    on("scored", f"{_CURVE_SQL} SELECT {settle_sql('sum(pos * (all_neg - cum_neg + neg / 2.0::DOUBLE)) / (max(all_pos)::DOUBLE * max(all_neg))')} AS auc FROM curve"),
)
def eval_auc_query(spark, sf_dir):
    return settled(evaluation.auc(labelled_scores(spark, sf_dir)))


@query(
    "eval_roc",
    on("scored", f"""{_CURVE_SQL} SELECT {settle_sql('threshold')} AS threshold, {settle_sql('cum_neg::DOUBLE / all_neg')} AS fpr, {settle_sql('cum_pos::DOUBLE / all_pos')} AS tpr FROM curve
UNION ALL SELECT NULL, 0, 0"""),
)
def eval_roc_query(spark, sf_dir):
    return settled(evaluation.roc_points(labelled_scores(spark, sf_dir)))


@query(
    "eval_pr",
    on("scored", f"""{_CURVE_SQL} SELECT {settle_sql('threshold')} AS threshold, {settle_sql('cum_pos::DOUBLE / (cum_pos + cum_neg)')} AS precision, {settle_sql('cum_pos::DOUBLE / all_pos')} AS recall FROM curve
UNION ALL SELECT NULL, 1, 0"""),
)
def eval_pr_query(spark, sf_dir):
    return settled(evaluation.pr_points(labelled_scores(spark, sf_dir)))


@query(
    "time_split",
    on("canonical", f"""labelled AS (SELECT finding_id, published_date FROM canonical WHERE {_LABEL_SQL} IS NOT NULL),
placed AS (SELECT finding_id, row_number() OVER (ORDER BY published_date NULLS LAST, md5(finding_id), finding_id) AS k, count(*) OVER () AS n FROM labelled)
SELECT finding_id, CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM placed"""),
)
def time_split_query(spark, sf_dir):
    table = drop_unlabelled(create_label(canonical(spark, sf_dir))).select("finding_id", "published_date")
    return splits.time_split(table).select("finding_id", "split")


@query(
    "stratified_split",
    on("canonical", f"""labelled AS (SELECT finding_id, {_LABEL_SQL} AS label FROM canonical WHERE {_LABEL_SQL} IS NOT NULL),
placed AS (SELECT finding_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || finding_id), finding_id) AS k,
  count(*) OVER (PARTITION BY label) AS n FROM labelled)
SELECT finding_id, label, CASE WHEN k <= floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM placed"""),
)
def stratified_split_query(spark, sf_dir):
    table = drop_unlabelled(create_label(canonical(spark, sf_dir))).select("finding_id", "label")
    return splits.stratified_split(table)
