"""Boosted-tree training, prediction and storage."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from findrisk.operators import boosting
from findrisk.operators.assembly import BLOCKS, align_features, feature_matrix
from findrisk.operators.boosting import Forest, Settings, Tree
from findrisk.operators.canonical import canonicalize, create_label, drop_unlabelled
from findrisk.storage import discard, stage

# Default training parameters.
DEFAULTS = {"max_depth": 6, "eta": 0.05, "subsample": 0.8, "colsample": 0.8, "l2": 1.0, "l1": 0.5, "rounds": 500, "patience": 50, "seed": 42}


@dataclass
class BoostedModel:
    """Trees over named features; the margin is the log-odds of label 1, half and half without any tree."""

    names: list[str]
    trees: list[Tree]
    settings: dict = field(default_factory=dict)
    vector_model: PipelineModel | None = None

    def margins(self, matrix: np.ndarray) -> np.ndarray:
        return Forest(self.trees).margins(matrix)


def prepare_training(
    raw: DataFrame,
    as_of: str | datetime,
    *,
    blocks: Sequence[str] = BLOCKS,
    keep: Sequence[str] = (),
    leave_one_out: bool = False,
    vectors: str | None = None,
    vector_model: PipelineModel | None = None,
    mark: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Labelled feature matrix with finding_id, label, published_date and the columns in ``keep``.

    Unlabelled rows are dropped first, so group statistics see labelled rows only.
    ``vectors`` names a column of text vectors, ``vector_model`` their fitted components.
    ``mark`` may add columns to the staged rows the matrix is made from.
    """
    labelled = drop_unlabelled(create_label(canonicalize(raw)))
    kept = dict.fromkeys(["finding_id", "label", "published_date", *keep])
    return feature_matrix(
        labelled, as_of, blocks, keep=list(kept), leave_one_out=leave_one_out, vectors=vectors, vector_model=vector_model, mark=mark
    )


def mark_validation(matrix: DataFrame, share: float = 0.1, seed: int = DEFAULTS["seed"]) -> DataFrame:
    """Add the boolean ``validation``, true for about a share of the rows, chosen by a hash of their id."""
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("finding_id")), F.lit(1_000_000)) / 1_000_000
    return matrix.withColumn("validation", chance < share)


def _bounded(rows: DataFrame, most: int | None, keys: DataFrame | None = None) -> DataFrame:
    """The rows themselves if there are at most ``most`` (or that is None), else ``most`` of them, those of the smallest hashes of their ids.

    ``keys`` holds the ids of the rows, if they are cheaper to read elsewhere. The
    choice is a comparison with one id, so the other columns are only made for the
    rows chosen.
    """
    keys = rows if keys is None else keys
    n = keys.count() if most is not None else 0
    if most is None or n <= most:
        return rows
    place = F.struct(F.pmod(F.xxhash64(F.lit("rows"), F.col("finding_id")), F.lit(1 << 62)).alias("h"), F.col("finding_id").alias("id"))
    # a few more than wanted by the hash alone, then the exact last one among those
    share = min(1.0, 1.1 * most / n + 100 / n)
    last = keys.select(place.alias("place")).filter(F.col("place.h") <= int(share * (1 << 62))).orderBy("place").limit(most).agg(F.max("place").alias("last")).first()["last"]
    if last is None:
        return rows.limit(0)
    kind = rows.schema["finding_id"].dataType
    return rows.filter(place <= F.struct(F.lit(last["h"]).alias("h"), F.lit(last["id"]).cast(kind).alias("id")))


def train(
    matrix: DataFrame,
    names: Sequence[str],
    *,
    label: str = "label",
    validation: str | None = None,
    max_depth: int = DEFAULTS["max_depth"],
    eta: float = DEFAULTS["eta"],
    subsample: float = DEFAULTS["subsample"],
    colsample: float = DEFAULTS["colsample"],
    l2: float = DEFAULTS["l2"],
    l1: float = DEFAULTS["l1"],
    least_hessian: float = 1.0,
    rounds: int = DEFAULTS["rounds"],
    patience: int = DEFAULTS["patience"],
    seed: int = DEFAULTS["seed"],
    most_rows: int | None = None,
    most_validation_rows: int | None = None,
    block_rows: int = boosting.BLOCK_ROWS,
    max_bins: int = boosting.MAX_BINS,
) -> BoostedModel:
    """Fit boosted trees for a 0/1 label on all rows.

    ``validation`` names a boolean column: rows where it is true are held out and
    judge every round by the area under the curve. A caller may ask for fewer rows of
    either kind, ``most_rows`` and ``most_validation_rows``, chosen by a hash of the
    finding id. The rounds end once it has not risen for ``patience`` rounds, and the
    trees up to the best round stay. Validation rows should be part of the training
    data, not of the test data. ``l2`` and ``l1`` shrink the leaves;
    ``least_hessian`` is the least sum of hessians on either side of a split.
    """
    settings = Settings(max_depth, eta, subsample, colsample, l2, l1, least_hessian, rounds, patience, seed)
    columns = ["finding_id", label, *names]
    bounded = most_rows is not None or (validation and most_validation_rows is not None)
    keys = stage(matrix.select("finding_id", *([validation] if validation else [])), "training-keys") if bounded else matrix
    if validation:
        held = F.col(validation)
        parts = [_bounded(matrix.filter(~held), most_rows, keys.filter(~held)), _bounded(matrix.filter(held), most_validation_rows, keys.filter(held))]
        rows = parts[0].select(*columns, validation).unionByName(parts[1].select(*columns, validation))
    else:
        rows = _bounded(matrix, most_rows, keys).select(*columns)
    rows = stage(rows, "training-rows")
    trees = boosting.boost(rows, names, label, validation, settings, block_rows=block_rows, max_bins=max_bins)
    discard(rows)
    return BoostedModel(list(names), trees, asdict(settings))


def first_trees(model: BoostedModel, n: int) -> BoostedModel:
    """The model cut to its first ``n`` trees."""
    return BoostedModel(model.names, model.trees[:n], model.settings, model.vector_model)


def model_features(model: BoostedModel) -> list[str]:
    """Feature names a trained model expects, in order."""
    return model.names


def _with_margin(rows: DataFrame, model: BoostedModel, features: str, into: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(Forest(model.trees))

    def margins(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.margins(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)))

    return rows.withColumn(into, F.arrow_udf(margins, "double")(F.col(features)))


def predict(model: BoostedModel, matrix: DataFrame, keep: Sequence[str] = ("finding_id",)) -> DataFrame:
    """Kept columns (features among them if named) plus ``ml_score``, the probability of the positive class."""
    chance = 1 / (1 + F.exp(-F.col("_margin")))
    return margins(model, matrix, keep, "_margin").select(*keep, chance.alias("ml_score"))


def margins(model: BoostedModel, matrix: DataFrame, keep: Sequence[str] = ("finding_id",), into: str = "margin") -> DataFrame:
    """Kept columns plus the margin of every row."""
    names = model_features(model)
    aligned = align_features(matrix, names, keep=[name for name in keep if name not in names])
    vector = F.array(*[F.col(name).cast("double") for name in names]).alias("_features")
    return _with_margin(aligned.select(*keep, vector), model, "_features", into).select(*keep, into)


def feature_vectors(model: BoostedModel, matrix: DataFrame, keep: Sequence[str] = ("finding_id",)) -> DataFrame:
    """Kept columns plus ``features`` as an array, in the order of the model."""
    names = model_features(model)
    aligned = align_features(matrix, names, keep=keep)
    return aligned.select(*keep, F.array(*[F.col(name).cast("double") for name in names]).alias("features"))


def vector_model_of(model: BoostedModel) -> PipelineModel | None:
    """Components of the text vectors a model was trained with, None if it was without."""
    return model.vector_model


def save_model(model: BoostedModel, path: str) -> None:
    """Write trees, feature names and training settings and, if the model has some, the components of its text vectors."""
    spark = SparkSession.active()
    spark.createDataFrame(boosting.tree_rows(model.trees), boosting.TREE_COLUMNS).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    about = json.dumps({"names": model.names, "settings": model.settings})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/text_vectors")
    if model.vector_model is not None:
        model.vector_model.write().overwrite().save(f"{path}/text_vectors")
    else:
        # components of a model saved there before are not this one's
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def load_model(path: str) -> BoostedModel:
    """A saved model, with the components of its text vectors if it has some."""
    spark = SparkSession.active()
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    trees = boosting.trees_of(spark.read.parquet(f"{path}/trees").collect())
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/text_vectors")
    known = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return BoostedModel(about["names"], trees, about["settings"], PipelineModel.load(f"{path}/text_vectors") if known else None)
