"""The batch jobs end to end: train a model, judge it, score findings with it, explain the riskiest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from findrisk.functions.dates import elapsed_days, moment
from findrisk.operators import contributions, evaluation, splits, training
from findrisk.operators.assembly import BLOCKS, feature_matrix, feature_names
from findrisk.operators.canonical import add_finding_id, canonicalize, create_label, drop_unlabelled
from findrisk.operators.embeddings import fit_vectors
from findrisk.operators.prompts import finding_prompts
from findrisk.operators.scoring import (
    EXPOSURE_WEIGHTS, RANKED_COLUMNS, WEIGHTS, by_risk, hybrid_score, ranked_table, top_findings,
)
from findrisk.operators.training import BoostedModel
from findrisk.storage import stage

# Columns the score and the ranked table read beside the model probability.
SCORE_INPUTS = ("cvss_score", "epss_percentile", "is_withdrawn", "repo_criticality", *EXPOSURE_WEIGHTS)


def split_findings(
    raw: DataFrame,
    as_of: str | datetime,
    *,
    split: str = "time",
    test_size: float = 0.2,
    blocks: Sequence[str] = BLOCKS,
    keep: Sequence[str] = (),
    leave_one_out: bool = False,
    vectors: str | None = None,
    vector_model: PipelineModel | None = None,
) -> DataFrame:
    """Feature matrix of all labelled findings with their ``split``.

    By "time" the newest rows are the test part, by "random" the same share of
    every label. What the features are made from is staged and split; the wide
    columns are made for the rows a reader asks for, each time they are read.
    """
    makers = {"time": splits.time_split, "random": splits.stratified_split}
    if split not in makers:
        raise ValueError(f"unknown split: {split}")
    return training.prepare_training(
        add_finding_id(raw), as_of, blocks=blocks, keep=keep, leave_one_out=leave_one_out, vectors=vectors, vector_model=vector_model,
        mark=lambda rows: makers[split](rows, test_size=test_size),
    )


def fit_model(
    parted: DataFrame, *, blocks: Sequence[str] = BLOCKS, vectors: bool = False, validation_share: float = 0.0, **settings
) -> BoostedModel:
    """Fit a model on the train part; with a validation share, that part of it ends the rounds early."""
    rows = parted.filter("split = 'train'")
    if validation_share > 0:
        rows = training.mark_validation(rows, validation_share)
        settings["validation"] = "validation"
    return training.train(rows, feature_names(blocks, vectors), **settings)


def train_model(
    raw: DataFrame,
    as_of: str | datetime,
    *,
    split: str = "time",
    test_size: float = 0.2,
    blocks: Sequence[str] = BLOCKS,
    keep: Sequence[str] = (),
    validation_share: float = 0.0,
    leave_one_out: bool = False,
    vectors: str | None = None,
    **settings,
) -> tuple[BoostedModel, DataFrame]:
    """Fit a model on the train part of the labelled findings.

    Returns the model and the split matrix (``split_findings``, ``fit_model``).
    ``vectors`` names a column of text vectors: their components are fitted once,
    kept with the model and used for all rows it scores. ``leave_one_out`` takes
    each row out of its own group rates. Other settings go to ``training.train``.
    """
    table = add_finding_id(raw)
    fitted = fit_vectors(drop_unlabelled(create_label(canonicalize(table))), vectors) if vectors else None
    parted = split_findings(
        table, as_of, split=split, test_size=test_size, blocks=blocks, keep=keep,
        leave_one_out=leave_one_out, vectors=vectors, vector_model=fitted,
    )
    model = fit_model(parted, blocks=blocks, vectors=vectors is not None, validation_share=validation_share, **settings)
    model.vector_model = fitted
    return model, parted


def evaluate_model(model: BoostedModel, parted: DataFrame, *, part: str = "test", threshold: float = 0.5) -> DataFrame:
    """AUC and threshold metrics of one part in one row."""
    scores = stage(
        training.predict(model, parted.filter(F.col("split") == part), keep=("finding_id", "label")), "predictions"
    )
    metrics = evaluation.classification_metrics(scores, score="ml_score", threshold=threshold)
    return metrics.withColumn("auc", evaluation.auc(scores, score="ml_score").scalar())


def score_findings(
    raw: DataFrame,
    model: BoostedModel,
    as_of: str | datetime,
    *,
    blocks: Sequence[str] = BLOCKS,
    weights: Mapping[str, float] = WEIGHTS,
    leave_one_out: bool = False,
    vectors: str | None = None,
) -> DataFrame:
    """Scored findings, unrounded; ``ranked_table`` and ``by_risk`` turn them into the ranked table.

    The columns the score and its readers need travel through the feature matrix,
    so the probabilities need not be joined back to the findings. ``vectors``
    names the column of text vectors for a model that was trained with one.
    """
    matrix = _carrying_matrix(raw, model, as_of, blocks, leave_one_out, vectors)
    return _score_matrix(matrix, model, weights)


def _carrying_matrix(
    raw: DataFrame, model: BoostedModel, as_of: str | datetime, blocks: Sequence[str], leave_one_out: bool, vectors: str | None
) -> DataFrame:
    """Feature matrix that also holds what the score and the ranked table read."""
    table = canonicalize(add_finding_id(raw))
    carried = [name for name in dict.fromkeys([*RANKED_COLUMNS, *SCORE_INPUTS]) if name in table.columns]
    return feature_matrix(
        table, as_of, blocks, keep=carried, leave_one_out=leave_one_out, vectors=vectors, vector_model=training.vector_model_of(model)
    )


def _score_matrix(matrix: DataFrame, model: BoostedModel, weights: Mapping[str, float]) -> DataFrame:
    present = [name for name in dict.fromkeys([*RANKED_COLUMNS, *SCORE_INPUTS]) if name in matrix.columns]
    return hybrid_score(training.predict(model, matrix, keep=present), weights=weights)


def rank_all(
    raw: DataFrame,
    model: BoostedModel,
    as_of: str | datetime,
    *,
    blocks: Sequence[str] = BLOCKS,
    weights: Mapping[str, float] = WEIGHTS,
    leave_one_out: bool = False,
    vectors: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Feature matrix and staged ranked table of all findings, for ``explain_top`` and ``prompt_top`` over the same findings."""
    matrix = _carrying_matrix(raw, model, as_of, blocks, leave_one_out, vectors)
    return matrix, stage(ranked_table(_score_matrix(matrix, model, weights)), "ranked")


# So many ids, given by the caller's number of findings, are looked for by their values.
LISTED = 1000


def _chosen(table: DataFrame, top: DataFrame, n: int) -> DataFrame:
    """Rows of the ``n`` findings in ``top``; a filter by values reaches the staged rows, so only these become wide."""
    if n > LISTED:
        return table.join(F.broadcast(top.select("finding_id")), "finding_id", "left_semi")
    return table.filter(F.col("finding_id").isin([row[0] for row in top.select("finding_id").limit(n).collect()]))


def explain_top(
    raw: DataFrame,
    model: BoostedModel,
    as_of: str | datetime,
    *,
    n: int = 10,
    factors: int = 5,
    blocks: Sequence[str] = BLOCKS,
    weights: Mapping[str, float] = WEIGHTS,
    leave_one_out: bool = False,
    vectors: str | None = None,
    ranked: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """The ``n`` riskiest findings with their largest factors and the explanation text.

    Contributions are worked out for those rows only. ``ranked`` is what ``rank_all``
    returned for these findings, so that they need not be scored again.
    """
    if ranked is None:
        matrix = _carrying_matrix(raw, model, as_of, blocks, leave_one_out, vectors)
        order = ranked_table(_score_matrix(matrix, model, weights))
    else:
        matrix, order = ranked
    top = stage(top_findings(order, n), "top")
    chosen = _chosen(matrix, top, n)
    explained = contributions.contributions(model, training.feature_vectors(model, chosen))
    largest = contributions.top_factors(explained, training.model_features(model), factors)
    told = contributions.explanation_text(largest, keep=("factors",))
    return by_risk(top.join(told, "finding_id"))


def explain_cve(
    raw: DataFrame,
    model: BoostedModel,
    as_of: str | datetime,
    cve_id: str,
    *,
    factors: int = 5,
    blocks: Sequence[str] = BLOCKS,
    weights: Mapping[str, float] = WEIGHTS,
    leave_one_out: bool = False,
    vectors: str | None = None,
) -> DataFrame:
    """All findings of one CVE, scored, with their largest factors and the explanation text.

    The matrix needs all findings for its group statistics; only rows of the CVE
    are scored and explained.
    """
    matrix = _carrying_matrix(raw, model, as_of, blocks, leave_one_out, vectors).filter(F.col("cve_id") == cve_id)
    chosen = stage(matrix, "one-cve")
    explained = contributions.contributions(model, training.feature_vectors(model, chosen))
    told = contributions.explanation_text(
        contributions.top_factors(explained, training.model_features(model), factors), keep=("factors",)
    )
    return by_risk(ranked_table(_score_matrix(chosen, model, weights)).join(told, "finding_id"))


def prompt_top(
    raw: DataFrame,
    model: BoostedModel,
    as_of: str | datetime,
    *,
    n: int = 10,
    factors: int = 5,
    blocks: Sequence[str] = BLOCKS,
    weights: Mapping[str, float] = WEIGHTS,
    leave_one_out: bool = False,
    vectors: str | None = None,
    ranked: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Prompts for the ``n`` riskiest findings, with the model's largest factors.

    All findings are scored once; their staged ranked table gives the order and
    the figures of repositories and portfolio. Only the chosen ones are explained.
    ``ranked`` is what ``rank_all`` returned for these findings.
    """
    table = add_finding_id(raw)
    if ranked is None:
        ranked = rank_all(table, model, as_of, blocks=blocks, weights=weights, leave_one_out=leave_one_out, vectors=vectors)
    matrix, order = ranked
    top = stage(top_findings(order, n).select("finding_id", "risk_score", "tier", "ml_score"), "top")
    # n rows, the caller's number
    chosen = _chosen(matrix, top, n)
    explained = contributions.contributions(model, training.feature_vectors(model, chosen))
    largest = contributions.top_factors(explained, training.model_features(model), factors)
    # a long form of the chosen findings only
    canonical = canonicalize(_chosen(table, top, n))
    names = [name for name in canonical.columns if name not in ("risk_score", "tier", "ml_score", "factors")]
    facts = canonical.select(*names).join(F.broadcast(top.join(largest, "finding_id")), "finding_id")
    facts = facts.withColumn("days_since_published", elapsed_days(moment(as_of), F.col("published_date")))
    return finding_prompts(stage(facts, "facts"), order)
