"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

* **Features.** Letters in lower case, everything else a word boundary; n-grams of
  1 to 3 characters, which reach over the boundary but not past it, are hashed into
  BUCKETS buckets. A text's vector has (1 + log tf) * idf per bucket, of length 1.
* **Document frequencies** are counted over all rows that may be learned from.
* **Weights** come from follow-the-regularised-leader with an elastic net: one
  learning rate per weight, L1 sets weights to zero, L2 shrinks the others. At most
  TRAIN_ROWS rows take part, spread evenly over the labels.
* **Temperature.** An eighth of these rows is not trained on; the temperature that
  gives them the largest likelihood divides the scores before the softmax.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from llm import wordkernel
from llm.frames import read_table, require, sql_identifier
from llm.registry import register

BUCKETS = 1 << 16
SIZES = (1, 2, 3)
#: Labelled rows that weights and temperature are fitted on, at most, all labels together.
TRAIN_ROWS = 8000
EPOCHS = 2
#: One row in so many is kept for the temperature.
CALIBRATION_PART = 8
UNKNOWN = "und"

_SEED = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower-case form if words hold it (letters and the marks on them), else 0; whether it is a letter."""
    lower, is_letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            lower[code] = ord(low) if len(low) == 1 else code
            is_letter[code] = True
        elif unicodedata.category(char) in ("Mn", "Mc"):
            lower[code] = code
    return lower, is_letter


@dataclass(frozen=True)
class Grams:
    """Sparse counts of some texts: ``bucket, count`` of text ``i`` are ``bounds[i]:bounds[i + 1]``."""

    bucket: np.ndarray
    count: np.ndarray
    bounds: np.ndarray
    has_letter: np.ndarray


def grams(texts: list[str]) -> Grams:
    """Bucket counts of whole texts, worked on together."""
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    owner = np.repeat(np.arange(len(texts)), lengths)
    # a text's own NUL characters are boundaries as well
    lower, is_letter = _letters()
    real = np.zeros(len(texts), bool)
    real[owner[is_letter[points]]] = True
    letters = lower[points]
    solid = letters != 0
    keep = solid | np.concatenate(([True], solid[:-1])) if len(solid) else solid
    letters, owner = letters[keep], owner[keep]
    # every text starts with a boundary too, so that its first word has one on either side
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    codes = np.insert(letters.astype(np.uint64), first, 0)
    owners = np.insert(owner, first, owner[first])
    keys = []
    for size in SIZES:
        n = len(codes) - size + 1
        if n <= 0:
            continue
        ok = owners[:n] == owners[size - 1 :]
        # a boundary only at either end, never alone
        for k in range(1, size - 1):
            ok &= codes[k : k + n] != 0
        if size < 3:
            ok &= (codes[:n] != 0) | (codes[size - 1 :] != 0)
        hashed = codes[:n] + _SEED[size - 1]
        for k in range(1, size):
            hashed = hashed * _SEED[0] + codes[k : k + n]
        hashed = wordkernel.mix(hashed[ok])
        keys.append((owners[:n][ok] * BUCKETS) + (hashed % np.uint64(BUCKETS)).astype(np.int64))
    unique, count = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    bounds = np.searchsorted(unique, np.arange(len(texts) + 1) * BUCKETS)
    return Grams(unique % BUCKETS, count, bounds, real)


def _batches(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """(from, to, texts) of bounded pieces of a text column; null texts are empty."""
    texts = [text or "" for text in column.to_pylist()]
    for low, high in wordkernel.pieces(texts):
        yield low, high, texts[low:high]


def _values(found: Grams, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of length 1 per text."""
    values = (1 + np.log(found.count)) * idf[found.bucket]
    squares = np.concatenate(([0.0], np.cumsum(values * values)))
    norms = np.sqrt(np.maximum(np.diff(squares[found.bounds]), 1e-300))
    return values / np.repeat(norms, np.diff(found.bounds))


@dataclass(frozen=True)
class LanguageModel:
    """``labels`` in code point order; ``weights`` has a row per bucket and the bias last."""

    labels: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def probabilities(self, found: Grams) -> np.ndarray:
        scores = np.zeros((len(found.bounds) - 1, len(self.labels)))
        values = _values(found, self.idf)
        full = np.flatnonzero(np.diff(found.bounds))
        if len(full):
            terms = values[:, None] * self.weights[found.bucket]
            scores[full] = np.add.reduceat(terms, found.bounds[full], axis=0)
        return softmax((scores + self.weights[-1]) / self.temperature)


def softmax(scores: np.ndarray) -> np.ndarray:
    powers = np.exp(scores - scores.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


class Ftrl:
    """Multinomial logistic regression, one example at a time; the last feature is a bias without penalty."""

    def __init__(self, features: int, labels: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.alpha, self.beta = alpha, beta
        self.z = np.zeros((features + 1, labels))
        self.n = np.zeros((features + 1, labels))
        self.l1 = np.full((features + 1, 1), l1)
        self.l2 = np.full((features + 1, 1), l2)
        self.l1[-1] = self.l2[-1] = 0.0

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1[rows], 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2[rows])

    def learn(self, bucket: np.ndarray, value: np.ndarray, label: int) -> None:
        rows, x = np.append(bucket, len(self.z) - 1), np.append(value, 1.0)
        weights = self.weights(rows)
        scores = x @ weights
        error = np.exp(scores - scores.max())
        error /= error.sum()
        error[label] -= 1.0
        slope = x[:, None] * error
        n = self.n[rows]
        more = n + slope * slope
        self.z[rows] += slope - (np.sqrt(more) - np.sqrt(n)) / self.alpha * weights
        self.n[rows] = more


def best_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature between 1/20 and 20 with the largest likelihood, by golden section on its logarithm.

    The wanted probability of the right label is (n + 1) / (n + labels) instead of 1,
    so that rows without any error don't ask for endless certainty.
    """
    n, k = scores.shape
    if not n:
        return 1.0
    target = np.full(scores.shape, 1.0 / (n + k))
    target[np.arange(n), labels] = (n + 1.0) / (n + k)

    def loss(log_t: float) -> float:
        scaled = scores / math.exp(log_t)
        scaled = scaled - scaled.max(axis=1, keepdims=True)
        return float((np.log(np.exp(scaled).sum(axis=1)) - (target * scaled).sum(axis=1)).mean())

    low, high, ratio = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return math.exp((low + high) / 2)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """(texts that hold each bucket, number of texts), counted in the tasks and added up by bucket."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in source:
            for low, high, texts in _batches(batch.column(0)):
                totals += np.bincount(grams(texts).bucket, minlength=BUCKETS)
                rows += high - low
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, BUCKETS)), pa.array(np.append(totals[held], rows))], ["bucket", "n"])

    counted = docs.select(F.col(sql_identifier(text_col)).alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    # one row per bucket at most
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    totals = np.zeros(BUCKETS + 1, np.int64)
    for row in rows:
        totals[row["bucket"]] = row["n"]
    return totals[:-1], int(totals[-1])


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of ``rows`` (``key, text, label``), as even over the labels as they allow.

    Rows are ordered by a hash of their key, equal keys by a hash of the text. A
    first cut by the hash keeps what is numbered per label small: the cuts, a row per
    label, are broadcast, as the model with its weights per label is.
    """
    place = F.xxhash64(F.lit("language"), "key")
    hashed = rows.withColumn("place", F.shiftrightunsigned(place, 1))
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    each = F.greatest(F.lit(1), F.floor(F.lit(most) / F.count(F.lit(1)).over(Window.partitionBy())))
    share = F.least(F.lit(1.0), (1.25 * F.col("each") + 100) / F.col("size"))
    cuts = sizes.withColumn("each", each).select("label", "each", (share * float(2**63 - 1)).alias("cut"))
    chosen = hashed.join(F.broadcast(cuts), "label").filter(F.col("place") <= F.col("cut"))
    order = Window.partitionBy("label").orderBy("place", F.xxhash64("text"))
    return chosen.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= F.col("each")).select("place", "nth", "text", "label")


def train(
    docs: DataFrame, label: Column | str = "lang", id_col: str = "doc_id", text_col: str = "text", most_rows: int = TRAIN_ROWS, epochs: int = EPOCHS
) -> LanguageModel:
    """Fit a model on the rows of ``docs`` with a label.

    Document frequencies are taken from all of them, weights and temperature from
    at most ``most_rows`` (or one per label, if there are more labels), chosen by a
    hash of the id. Vectors are made where the rows are; one task goes through them
    ``epochs`` times in the order of the hash, so the result doesn't depend on
    partitions. Rows without a letter teach nothing. Without labelled rows the model
    has no labels and predicts ``und``.
    """
    require(docs, id_col, text_col)
    named = label if isinstance(label, Column) else F.col(sql_identifier(label))
    rows = docs.select(F.col(sql_identifier(id_col)).cast("string").alias("key"), F.col(sql_identifier(text_col)).alias("text"), named.alias("label"))
    rows = rows.filter(F.col("label").isNotNull())
    frequency, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + frequency)) + 1.0
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def vectors(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for low, high, texts in _batches(batch.column("text")):
                found = grams(texts)
                values, buckets = _values(found, shared.value).astype("<f4"), found.bucket.astype("<i4")
                cut = [slice(found.bounds[i], found.bounds[i + 1]) for i in range(high - low)]
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(name) for name in ("place", "nth", "label")],
                        pa.array([buckets[c].tobytes() for c in cut], pa.binary()),
                        pa.array([values[c].tobytes() for c in cut], pa.binary()),
                        pa.array(found.has_letter),
                    ],
                    ["place", "nth", "label", "buckets", "values", "lettered"],
                )

    def learn(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, kept = [], []
        for batch in source:
            for i, (name, buckets, values) in enumerate(zip(*[batch.column(k).to_pylist() for k in ("label", "buckets", "values")], strict=True)):
                example = (name, np.frombuffer(buckets, "<i4"), np.frombuffer(values, "<f4").astype(float))
                (kept if batch.column("nth")[i].as_py() % CALIBRATION_PART == 0 else examples).append(example)
        labels = sorted({name for name, _, _ in examples})
        index = {name: k for k, name in enumerate(labels)}
        if not labels:
            return
        model = Ftrl(BUCKETS, len(labels))
        for _ in range(epochs):
            for name, buckets, values in examples:
                model.learn(buckets, values, index[name])
        weights = model.weights()
        kept = [example for example in kept if example[0] in index]
        scores = np.array([values @ weights[buckets] + weights[-1] for _, buckets, values in kept]).reshape(-1, len(labels))
        temperature = best_temperature(scores, np.array([index[name] for name, _, _ in kept], int))
        held = np.append(np.flatnonzero(weights[:-1].any(axis=1)), BUCKETS)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(held),
                pa.array([weights[k].tobytes() for k in held], pa.binary()),
                pa.array([labels if k == BUCKETS else None for k in held], pa.list_(pa.string())),
                pa.array(np.full(len(held), temperature)),
            ],
            ["bucket", "weights", "labels", "temperature"],
        )

    made = _sample(rows, most_rows).mapInArrow(vectors, "place long, nth int, label string, buckets binary, values binary, lettered boolean")
    ordered = made.filter("lettered").repartition(1).sortWithinPartitions("place", "label", "nth")
    # bounded by buckets x labels
    found = ordered.mapInArrow(learn, "bucket long, weights binary, labels array<string>, temperature double").collect()
    shared.unpersist()
    names = next((tuple(row["labels"]) for row in found if row["labels"] is not None), ())
    weights = np.zeros((BUCKETS + 1, len(names)))
    for row in found:
        weights[row["bucket"]] = np.frombuffer(row["weights"])
    return LanguageModel(names, idf, weights, found[0]["temperature"] if found else 1.0)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", into: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the likeliest label and its calibrated probability to every row; no shuffle.

    A null text or one without a letter gets ``und`` and 0, as does everything if
    the model has no labels. Whole texts are read, however long; equal texts get
    equal answers; of equally likely labels the first in code point order is given.
    Columns named ``into`` and ``score`` are replaced.
    """
    require(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(column: pa.Array) -> pa.Array:
        labels, scores = [], []
        for low, high, texts in _batches(column):
            found = grams(texts)
            if not shared.value.labels:
                labels += [UNKNOWN] * (high - low)
                scores += [0.0] * (high - low)
                continue
            chances = shared.value.probabilities(found)
            best = chances.argmax(axis=1)
            labels += [shared.value.labels[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), found.has_letter.tolist(), strict=True)]
            scores += np.where(found.has_letter, chances[np.arange(high - low), best], 0.0).tolist()
        return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["label", "score"])

    answer = F.arrow_udf(predict, "struct<label: string, score: double>").asNondeterministic()(F.col(sql_identifier(text_col)))
    names = [name for name in docs.columns if name not in (into, score)]
    held = docs.select(F.struct(*[F.col(sql_identifier(name)) for name in names]).alias("row") if names else F.lit(1).alias("row"), answer.alias("answer"))
    kept = [F.col(f"row.{sql_identifier(name)}") for name in names]
    return held.select(*kept, F.col("answer.label").alias(into), F.col("answer.score").alias(score))


@register("op13_language_id")
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(docs.filter(~held_out))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
