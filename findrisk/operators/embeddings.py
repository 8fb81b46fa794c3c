"""Text vectors reduced to at most 100 principal components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

COMPONENTS = 100
VECTOR_NAMES = tuple(f"text_embed_{i}" for i in range(COMPONENTS))


def _dense(column: str) -> Column:
    return array_to_vector(F.col(column).cast("array<double>")).alias("_raw")


def fit_vectors(df: DataFrame, column: str, components: int = COMPONENTS) -> PipelineModel | None:
    """Mean and principal components of the vectors in ``column``; null vectors are left out.

    There are min(components, rows, dimensions) components, and None comes back if
    fewer than two are possible. The covariance is added up in the tasks; only a
    dimensions-by-dimensions matrix reaches the driver.
    """
    known = df.filter(F.col(column).isNotNull()).select(column)
    size = known.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(column)).alias("dims")).first()
    k = min(components, size["rows"], size["dims"] or 0)
    if k < 2:
        return None
    vectors = known.select(_dense(column))
    centre = StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False).fit(vectors)
    axes = PCA(k=k, inputCol="_centred", outputCol="_reduced").fit(centre.transform(vectors))
    return PipelineModel([centre, axes])


def apply_vectors(
    df: DataFrame, column: str, fitted: PipelineModel | None, *, keep: Sequence[str], components: int = COMPONENTS
) -> DataFrame:
    """Kept columns plus ``text_embed_0`` ... by fitted components.

    A row's values depend on its own vector only. A null vector, components the
    fit does not have, and all of them without a fit, give 0.
    """
    names = [f"text_embed_{i}" for i in range(components)]
    if fitted is None:
        return df.select(*keep, *[F.lit(0.0).alias(name) for name in names])
    k = fitted.stages[-1].getK()
    # rows without a vector pass through the model with an empty stand-in of the same length
    zeros = F.array_repeat(F.lit(0.0), fitted.stages[0].mean.size)
    filled = df.select(*keep, F.col(column).isNotNull().alias("_known"), F.coalesce(F.col(column).cast("array<double>"), zeros).alias("_filled"))
    reduced = fitted.transform(filled.withColumn("_raw", array_to_vector("_filled")))
    values = reduced.select(*keep, "_known", vector_to_array("_reduced").alias("_values"))
    return values.select(
        *keep,
        *[(F.when(F.col("_known"), F.col("_values")[i]).otherwise(0.0) if i < k else F.lit(0.0)).alias(name) for i, name in enumerate(names)],
    )


def reduce_vectors(df: DataFrame, column: str, *, keep: Sequence[str], components: int = COMPONENTS) -> DataFrame:
    """Components fitted on the table itself and applied to it. The sign of a component is arbitrary."""
    return apply_vectors(df, column, fit_vectors(df, column, components), keep=keep, components=components)
