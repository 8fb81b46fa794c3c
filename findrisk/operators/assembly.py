"""The whole feature matrix and the contract between training and scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from findrisk.functions.numbers import number, whole
from findrisk.operators import features, profiles
from findrisk.operators.canonical import field
from findrisk.operators.embeddings import VECTOR_NAMES, apply_vectors, fit_vectors
from findrisk.storage import stage

BLOCK_NAMES = {
    "cve_core": features.CVE_CORE_NAMES,
    "cwe": features.CWE_NAMES,
    "dependency": (*features.DEPENDENCY_ROW_NAMES, *profiles.PACKAGE_NAMES),
    "repo": profiles.REPO_NAMES,
    "time": features.TIME_NAMES,
    "text": features.TEXT_NAMES,
    "user": profiles.HISTORY_NAMES,
}
BLOCKS = tuple(BLOCK_NAMES)


def feature_names(blocks: Sequence[str] = BLOCKS, vectors: bool = False) -> list[str]:
    """Feature columns of the given blocks in matrix order; reduced vectors belong to the text block."""
    names = []
    for block in BLOCKS:
        if block in blocks:
            names += BLOCK_NAMES[block]
            if block == "text" and vectors:
                names += VECTOR_NAMES
    return names


FEATURE_NAMES = tuple(feature_names())


def _clean(name: str, data_type: T.DataType) -> Column:
    """Null, NaN and infinities become 0."""
    column = F.col(name)
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        bad = F.isnan(column) | (F.abs(column) == float("inf"))
        return F.when(bad | column.isNull(), 0.0).otherwise(column).alias(name)
    return F.coalesce(column, F.lit(0)).alias(name)


def _shared(canonical: DataFrame, block: str) -> dict[str, Column]:
    """Features that profiles read under the same name, by row-local block."""
    if block == "cve_core":
        cores = {name: number(field(canonical, name, 0.0)) for name in ("cvss_score", "epss_score")}
        return {**cores, "has_patch": whole(field(canonical, "has_patch", 0))}
    return {"transitive_dep_count": whole(field(canonical, "transitive_dep_count", 0))} if block == "dependency" else {}


def feature_matrix(
    canonical: DataFrame,
    as_of: str | datetime,
    blocks: Sequence[str] = BLOCKS,
    *,
    keep: Sequence[str] = ("finding_id",),
    row_id: str = "finding_id",
    leave_one_out: bool = False,
    vectors: str | None = None,
    vector_model: PipelineModel | None = None,
    mark: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Kept columns plus all features of the active blocks.

    ``vectors`` names a column with text vectors; its reduced form then adds 100
    columns to the text block, by the components of ``vector_model`` or, without
    one, by components fitted on this table.

    The grouped blocks stage the rows with the short columns the row-local blocks
    read; long texts are reduced to a few numbers before. The wide columns are made
    when the matrix is read, and only for the rows its reader asks for: a filter on
    kept columns is passed on to the staged rows. ``mark`` may add columns to the
    staged rows; they are kept too.
    """
    grouped = [name for block, name in (("dependency", "package"), ("repo", "repo"), ("user", "user")) if block in blocks]
    row_blocks = [block for block in features.ROW_BLOCKS if block in blocks]
    use_vectors = vectors is not None and "text" in blocks
    names = feature_names(blocks, use_vectors)
    carried = [*keep, row_id, *([vectors] if use_vectors else ()), *(profiles.SOURCE_COLUMNS if grouped else ())]
    present = [name for name in dict.fromkeys(carried) if name in canonical.columns]
    # what both kinds of blocks read, as the features have it; reading it once more changes nothing
    shared = {name: column for block in row_blocks for name, column in _shared(canonical, block).items() if grouped}
    readings = features.text_readings(canonical, as_of, row_blocks)
    short = canonical.withColumns({**readings, **shared})
    inputs = dict.fromkeys([*present, *shared, *[name for block in row_blocks for name in features.ROW_INPUTS[block]], *readings])
    rows = short.select(*[name for name in inputs if name in short.columns])
    if grouped:
        rows = profiles.grouped_features(rows, grouped, keep=rows.columns, row_id=row_id, leave_one_out=leave_one_out, mark=mark)
    elif mark:
        rows = mark(stage(rows, "rows"))
    marks = [name for name in rows.columns if name not in short.columns and name not in names]
    made = [name for name in names if name in rows.columns and name not in inputs]
    wide = features.row_features(rows, as_of, row_blocks, keep=list(dict.fromkeys([*present, *marks, *made])), ready=list(readings))
    if use_vectors:
        fitted = vector_model or fit_vectors(canonical, vectors)
        wide = apply_vectors(wide, vectors, fitted, keep=[name for name in wide.columns if name != vectors])
    types = {f.name: f.dataType for f in wide.schema.fields}
    kept = [name for name in dict.fromkeys([*keep, *marks]) if name not in names]
    return wide.select(*kept, *[_clean(name, types[name]) for name in names])


def align_features(matrix: DataFrame, names: Sequence[str], keep: Sequence[str] = ("finding_id",)) -> DataFrame:
    """Columns a trained model expects, in its order: missing ones 0, others dropped."""
    present = set(matrix.columns)
    return matrix.select(*keep, *[F.col(name) if name in present else F.lit(0).alias(name) for name in names])
