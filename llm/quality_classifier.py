"""Quality classifier: document evidence on top of hierarchical empirical-Bayes site rates."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from llm import quality_rules
from llm.frames import read_table, require, sheltered, sql_identifier, stage
from llm.registry import register

#: At most this many labelled documents train the classifier, chosen by hash: the one bounded sample.
MOST_LABELLED = 50_000
#: Probability from which a document counts as good.
THRESHOLD = 0.5
#: Strength of a prior in documents stays between these.
STRENGTHS = (1.0, 1e6)

FEATURES = ("log_words", "few_words", "word_length", "symbols", "many_symbols", "repeated", "much_repeated", "dup_lines", "many_dup_lines", "letters", "few_letters")


def _features(entry: str) -> dict[str, Column]:
    m = {name: F.col(f"{entry}.{name}").cast("double") for name in quality_rules.MEASURES}
    words, lines = F.greatest(m["n_words"], F.lit(1.0)), F.greatest(m["n_lines"], F.lit(1.0))
    ramp = lambda share, at: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (share - at) / at))
    symbols, repeated = m["n_symbols"] / words, m["n_repeat_words"] / words
    dup, letters = m["n_dup_lines"] / lines, m["n_letter_words"] / words
    return {
        "log_words": F.log1p(m["n_words"]),
        "few_words": ramp(m["n_words"], 12.0),
        "word_length": F.least(m["word_chars"] / words, F.lit(30.0)),
        "symbols": F.least(symbols, F.lit(2.0)),
        "many_symbols": ramp(symbols, 0.1),
        "repeated": repeated,
        "much_repeated": ramp(repeated, 0.2),
        "dup_lines": dup,
        "many_dup_lines": ramp(dup, 0.3),
        "letters": letters,
        "few_letters": ramp(1 - letters, 0.25),
    }


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def train(labelled: DataFrame, most_labelled: int = MOST_LABELLED) -> tuple[list[float], float, float]:
    """(weights, intercept, base rate) of a logistic model from FEATURES and ``label``.

    At most ``most_labelled`` rows of the smallest hashes are used, in one order.
    With labels of one kind or none, the evidence is zero everywhere.
    """
    used = labelled.select(*FEATURES, F.col("label").cast("double").alias("label"), F.xxhash64("doc_id").alias("order"))
    sample = stage(used.orderBy("order", *FEATURES, "label").limit(most_labelled).coalesce(1), "labelled")
    total, good = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    base = (good + 1.0) / (total + 2.0)
    if not 0 < good < total:
        return [0.0] * len(FEATURES), _logit(base), base
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample.coalesce(1))
    model = LogisticRegression(featuresCol="features", labelCol="label", regParam=0.003, maxIter=100).fit(rows)
    return [float(w) for w in model.coefficients], float(model.intercept), base


def _strength(groups: int, rows: float, rows_squared: float, between: float, within: float) -> float:
    """Documents that a prior weighs, from the one-way analysis of variance of rates in groups.

    Within-group variance over between-group variance: with no more spread among
    groups than chance gives, the strongest prior.
    """
    if groups < 2 or rows <= groups:
        return STRENGTHS[1]
    inside = within / (rows - groups)
    typical = (rows - rows_squared / rows) / (groups - 1)
    spread = (between / (groups - 1) - inside) / typical
    if spread <= 0 or inside <= 0:
        return STRENGTHS[1] if spread <= 0 else STRENGTHS[0]
    return min(max(inside / spread, STRENGTHS[0]), STRENGTHS[1])


@sheltered
def classify(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    label_col: str = "quality",
) -> DataFrame:
    """Probability that a document is good, one row per document.

    Returns ``doc_id, host, path, evidence, host_rate, path_rate, probability,
    kept``. Evidence is the classifier's log-odds less those of the labelled base
    rate. Its probabilities, summed per path and host, are the sites' counts of
    good documents: a host's rate shrinks towards the rate of all documents, a
    path's towards its host's, by the prior strength that the spread among hosts
    (paths within hosts) supports, so a sparse site stays near its prior. A
    document's own share is taken out of its site before its evidence is added to
    the log-odds of its path.

    Sites are aggregated per path in one grouping; hosts come from the paths.
    A null host or path is a site of its own. Null and empty texts are judged by
    their zero measures. Ids labelled more than once count by the larger share,
    good on a tie; labels of unknown or null ids, and null labels, are not used.
    Without labels of both kinds the evidence is zero. Repeated rows count and
    come back as often as they stand. An empty table gives no rows. Other columns
    are not read.
    """
    require(docs, id_col, text_col, host_col, path_col)
    require(labels, id_col, label_col)
    named = docs.select(
        F.col(sql_identifier(id_col)).alias("doc_id"),
        F.col(sql_identifier(host_col)).cast("string").alias("host"),
        F.col(sql_identifier(path_col)).cast("string").alias("path"),
        F.col(sql_identifier(text_col)).alias("text"),
    )
    measured = quality_rules.ledger(named, "text", "__entry")
    rows = stage(measured.select("doc_id", "host", "path", *[value.alias(name) for name, value in _features("__entry").items()]), "measured")
    known = (
        labels.select(F.col(sql_identifier(id_col)).alias("doc_id"), F.col(sql_identifier(label_col)).cast("double").alias("label"))
        .filter("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    )
    weights, intercept, base = train(rows.join(known, "doc_id"))
    score = F.lit(intercept)
    for weight, name in zip(weights, FEATURES, strict=True):
        score = score + F.lit(weight) * F.col(name)
    # log-odds beyond these bounds say nothing more, and keep probabilities off 0 and 1
    score = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), score))
    judged = rows.select("doc_id", "host", "path", score.alias("score")).withColumn("p", 1 / (1 + F.exp(-F.col("score"))))
    # whole millionths, so that sums don't depend on the order of tasks
    judged = judged.withColumn("p", F.round(F.col("p") * 1_000_000).cast("long"))

    paths = stage(
        judged.groupBy("host", "path").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("p").alias("s"),
            F.sum((F.col("p") * F.col("p")).cast("decimal(38,0)")).alias("q"),
        ),
        "paths",
    )
    unit = 1e6
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum("q").alias("host_q"))
    sites = stage(hosts, "hosts")
    whole = sites.agg(
        F.count(F.lit(1)).alias("groups"), F.sum("host_n").alias("n"), F.sum("host_s").alias("s"), F.sum("host_q").cast("double").alias("q"),
        F.sum((F.col("host_n") * F.col("host_n")).cast("decimal(38,0)")).cast("double").alias("nn"),
        _exact(F.col("host_s") * 1.0 * F.col("host_s") / F.col("host_n")).alias("ss"),
    ).first()
    inner = paths.agg(
        F.count(F.lit(1)).alias("groups"), F.sum((F.col("n") * F.col("n")).cast("decimal(38,0)")).cast("double").alias("nn"),
        _exact(F.col("s") * 1.0 * F.col("s") / F.col("n")).alias("ss"),
    ).first()
    n, mean, host_strength, path_strength = whole["n"] or 0, base, STRENGTHS[1], STRENGTHS[1]
    if n:
        total = whole["s"] / unit
        mean = total / n
        squares, host_squares, path_squares = whole["q"] / unit**2, whole["ss"] / unit**2, inner["ss"] / unit**2
        host_strength = _strength(whole["groups"], n, whole["nn"], host_squares - n * mean * mean, squares - host_squares)
        path_strength = _strength(inner["groups"], n, inner["nn"], path_squares - host_squares, squares - path_squares)
    mean = min(max(mean, 1e-6), 1 - 1e-6)

    site = paths.select("host", "path", "n", "s").join(
        sites.select(F.col("host").alias("__host"), "host_n", "host_s"), F.col("host").eqNullSafe(F.col("__host"))
    ).select(F.col("host").alias("__host"), F.col("path").alias("__path"), "n", "s", "host_n", "host_s")
    joined = judged.join(site, F.col("host").eqNullSafe(F.col("__host")) & F.col("path").eqNullSafe(F.col("__path")))
    host_rate = (host_strength * mean + (F.col("host_s") - F.col("p")) / unit) / (host_strength + F.col("host_n") - 1)
    path_rate = (path_strength * F.col("host_rate") + (F.col("s") - F.col("p")) / unit) / (path_strength + F.col("n") - 1)
    evidence = F.col("score") - F.lit(_logit(base))
    log_odds = F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate")))
    rated = joined.withColumn("host_rate", host_rate).withColumn("path_rate", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), path_rate)))
    final = rated.withColumn("evidence", evidence).withColumn("probability", 1 / (1 + F.exp(-log_odds)))
    return final.select(
        "doc_id", "host", "path",
        *[F.round(name, 6).alias(name) for name in ("evidence", "host_rate", "path_rate", "probability")],
        (F.col("probability") >= threshold).alias("kept"),
    )


def _exact(value: Column) -> Column:
    """A sum of large doubles in whole numbers, the same in any order."""
    return F.sum(F.round(value).cast("decimal(38,0)")).cast("double")


@register("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
