"""Model training, explanation and reduced text vectors on the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from findrisk.batch import SCORE_INPUTS, evaluate_model, explain_cve, explain_top, fit_model, prompt_top, rank_all, score_findings, split_findings
from findrisk.operators import contributions, embeddings, training
from findrisk.operators.assembly import FEATURE_NAMES
from findrisk.operators.canonical import create_label, drop_unlabelled
from findrisk.operators.prompts import PATTERN_TASK, pattern_prompt
from findrisk.operators.scoring import PARTS, WEIGHTS, by_risk, hybrid_score, ranked_table, score_terms
from findrisk.plans.feature_queries import _LABEL_SQL
from findrisk.plans.findings import AS_OF, canonical, findings, on, scored
from findrisk.plans.registry import query, settle_sql, settled
from findrisk.storage import stage


def trained(spark: SparkSession, sf_dir: str, keep=(), split: str = "time"):
    """Model fitted on the oldest 80 percent of labelled findings (or a random share), and the whole split matrix."""
    parted = split_findings(findings(spark, sf_dir), AS_OF, split=split, keep=keep)
    return fit_model(parted, validation_share=0.1), parted


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, split = trained(spark, sf_dir)
    return contributions.contributions(model, training.feature_vectors(model, split.filter("split = 'test'")))


@query("train_predict")
def train_predict_query(spark, sf_dir):
    """Probability, blended score and tier of every labelled finding from a freshly trained model."""
    model, split = trained(spark, sf_dir, keep=("repo_criticality",))
    scores = training.predict(model, split, keep=("finding_id", "label", "split", *SCORE_INPUTS))
    return hybrid_score(scores).select("finding_id", "label", "split", "ml_score", "risk_score", "tier")


# What the score adds to the model's share, where neither the cap nor the floor applies.
_SPLIT_SQL = f"""labelled AS (SELECT finding_id, {_LABEL_SQL} AS label, published_date FROM scored WHERE {_LABEL_SQL} IS NOT NULL),
placed AS (SELECT finding_id, label, row_number() OVER (ORDER BY published_date NULLS LAST, md5(finding_id), finding_id) AS k, count(*) OVER () AS n FROM labelled)"""
_REST_SQL = """CASE WHEN is_withdrawn = 0 AND NOT (cvss_score >= 9 AND exposure_score > 0.5)
  THEN round(0.2::DOUBLE * normalized_cvss + 0.15::DOUBLE * normalized_epss + 0.1::DOUBLE * exposure_score + 0.1::DOUBLE * repo_criticality, 6) END"""


@query(
    "train_predict_check",
    on("scored", f"""{_SPLIT_SQL}
SELECT finding_id, label, CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split, 1 AS in_range, 1 AS tier_fits, {_REST_SQL} AS rest
FROM placed JOIN scored USING (finding_id)"""),
)
def train_predict_check_query(spark, sf_dir):
    """The same rows as train_predict: split, range and tier, and the score less the model's share of it."""
    model, split = trained(spark, sf_dir, keep=("repo_criticality",))
    scores = stage(hybrid_score(training.predict(model, split, keep=("finding_id", "label", "split", *SCORE_INPUTS))), "scores")
    open_score = (F.col("is_withdrawn") == 0) & ~((F.col("cvss_score") >= 9) & (F.col("exposure_score") > 0.5))
    risk = F.col("risk_score")
    tier = F.when(risk > 0.8, "CRITICAL").when(risk > 0.6, "HIGH").when(risk > 0.4, "MEDIUM").otherwise("LOW")
    return scores.select(
        "finding_id", "label", "split",
        ((F.col("ml_score") > 0) & (F.col("ml_score") < 1)).cast("int").alias("in_range"),
        (F.col("tier") == tier).cast("int").alias("tier_fits"),
        F.when(open_score, F.round(risk - 0.45 * F.col("ml_score"), 6)).alias("rest"),
    )


# Whole-number inputs, so that every value has a bin of its own and SQL can search the same splits.
_PLAIN_INPUTS = ("severity_numeric", "num_references", "cwe_count", "transitive_dep_count", "num_sources", "has_patch", "num_affected_ranges")


@query(
    "train_first_split",
    on("canonical", f"""cells AS (SELECT name, v, 0.5::DOUBLE - label AS g FROM (UNPIVOT (SELECT {_LABEL_SQL} AS label, {', '.join(f'CAST({name} AS DOUBLE) AS {name}' for name in _PLAIN_INPUTS)} FROM canonical
  WHERE {_LABEL_SQL} IS NOT NULL) ON {', '.join(_PLAIN_INPUTS)} INTO NAME name VALUE v)),
bins AS (SELECT name, v, sum(g) AS g, 0.25::DOUBLE * count(*) AS h FROM cells GROUP BY name, v),
sides AS (SELECT name, v, sum(g) OVER o AS lg, sum(h) OVER o AS lh, sum(g) OVER p AS tg, sum(h) OVER p AS th FROM bins
  WINDOW o AS (PARTITION BY name ORDER BY v), p AS (PARTITION BY name)),
gains AS (SELECT *, pow(greatest(abs(lg) - 0.5, 0), 2) / (lh + 1) + pow(greatest(abs(tg - lg) - 0.5, 0), 2) / (th - lh + 1) - pow(greatest(abs(tg) - 0.5, 0), 2) / (th + 1) AS gain
  FROM sides WHERE lh >= 1 AND th - lh >= 1),
best AS (SELECT * FROM gains ORDER BY gain DESC, name, v LIMIT 1)
SELECT name AS feature, v AS threshold, {settle_sql('-0.05 * sign(lg) * greatest(abs(lg) - 0.5, 0) / (lh + 1)')} AS below,
  {settle_sql('-0.05 * sign(tg - lg) * greatest(abs(tg - lg) - 0.5, 0) / (th - lh + 1)')} AS above, {settle_sql('lh')} AS hessian_below, {settle_sql('th')} AS hessian FROM best"""),
)
def train_first_split_query(spark, sf_dir):
    """One round of one level over all labelled findings in several blocks: the penalised split SQL finds by trying all."""
    table = drop_unlabelled(create_label(canonical(spark, sf_dir))).select("finding_id", "label", *_PLAIN_INPUTS)
    model = training.train(table, _PLAIN_INPUTS, rounds=1, max_depth=1, subsample=1.0, colsample=1.0, most_rows=None, block_rows=20_000)
    (tree,) = model.trees
    low, high = tree.left[0], tree.right[0]
    row = (_PLAIN_INPUTS[tree.feature[0]], tree.threshold[0], tree.value[low], tree.value[high], tree.cover[low], tree.cover[0])
    return settled(spark.createDataFrame([row], "feature string, threshold double, below double, above double, hessian_below double, hessian double"))


@query("train_evaluate")
def train_evaluate_query(spark, sf_dir):
    """Quality of that model on the newest labelled findings."""
    return evaluate_model(*trained(spark, sf_dir))


@query("train_score_findings")
def train_score_findings_query(spark, sf_dir):
    """Every finding, labelled or not, scored by a model trained on a random split and ranked."""
    model, _ = trained(spark, sf_dir, split="random")
    return by_risk(ranked_table(score_findings(findings(spark, sf_dir), model, AS_OF)))


@query("explain_top_findings")
def explain_top_findings_query(spark, sf_dir):
    """The riskiest of all findings with their largest factors in words."""
    model, _ = trained(spark, sf_dir)
    return explain_top(findings(spark, sf_dir), model, AS_OF).drop("factors")


@query(
    "explain_one_cve",
    on("canonical", "SELECT finding_id, cve_id, 5 AS factors, 1 AS agree FROM canonical WHERE cve_id = (SELECT min(cve_id) FROM canonical)"),
)
def explain_one_cve_query(spark, sf_dir):
    """All findings of one CVE: the lines of the explanation against the factors."""
    model, _ = trained(spark, sf_dir)
    table = findings(spark, sf_dir)
    cve_id = table.agg(F.min("cve_id")).first()[0]
    told = explain_cve(table, model, AS_OF, cve_id)
    agree = F.forall("factors", lambda p: F.contains("explanation", F.concat(F.lit("  - "), p["name"], F.lit(" "))))
    return told.select("finding_id", "cve_id", F.size("factors").alias("factors"), agree.cast("int").alias("agree"))


@query("prompt_top_findings", "SELECT 10 AS prompts, CAST(50 AS BIGINT) AS factor_lines, 1 AS agree")
def prompt_top_findings_query(spark, sf_dir):
    """Prompts of the ten riskiest findings: their factor lines against the explanations of the same findings."""
    model, _ = trained(spark, sf_dir)
    table = findings(spark, sf_dir)
    ranked = rank_all(table, model, AS_OF)
    written = prompt_top(table, model, AS_OF, ranked=ranked)
    told = explain_top(table, model, AS_OF, ranked=ranked).select("finding_id", "factors")
    lines = F.filter("factors", lambda p: F.contains("prompt", F.concat(F.lit("  - "), p["name"], F.lit(": "))))
    both = written.join(told, "finding_id").select(F.size(lines).alias("lines"))
    return both.agg(
        F.count(F.lit(1)).cast("int").alias("prompts"),
        F.sum("lines").alias("factor_lines"),
        F.min((F.col("lines") == 5).cast("int")).alias("agree"),
    )


@query("tree_contributions")
def tree_contributions_query(spark, sf_dir):
    """Base, margin, size and sum of the contributions of every test finding."""
    table = explained(spark, sf_dir)
    return table.select(
        "finding_id",
        "base",
        "margin",
        F.size("contributions").alias("features"),
        F.aggregate("contributions", F.lit(0.0), lambda total, value: total + value).alias("contribution_sum"),
    )


@query(
    "tree_contributions_check",
    on("canonical", f"""labelled AS (SELECT finding_id, published_date FROM canonical WHERE {_LABEL_SQL} IS NOT NULL),
placed AS (SELECT finding_id, row_number() OVER (ORDER BY published_date NULLS LAST, md5(finding_id), finding_id) AS k, count(*) OVER () AS n FROM labelled)
SELECT finding_id, 129 AS features, 1 AS adds_up FROM placed WHERE k > floor(n * 0.8::DOUBLE)"""),
)
def tree_contributions_check_query(spark, sf_dir):
    """Contributions of every test finding against the margin the model itself reports."""
    model, split = trained(spark, sf_dir)
    tested = split.filter("split = 'test'")
    own = training.margins(model, tested, into="raw")
    explained_rows = contributions.contributions(model, training.feature_vectors(model, tested))
    total = F.aggregate("contributions", F.col("base"), lambda so_far, value: so_far + value)
    return explained_rows.join(own, "finding_id").select(
        "finding_id", F.size("contributions").alias("features"), (F.abs(total - F.col("raw")) < 1e-9).cast("int").alias("adds_up")
    )


@query("global_importance")
def global_importance_query(spark, sf_dir):
    return contributions.global_importance(explained(spark, sf_dir), FEATURE_NAMES)


def _ranked_factors(factors: DataFrame) -> DataFrame:
    """One row per finding and factor, numbered from 0; every finding has factors.

    The outer form: before the plain one Spark filters on the size of the array,
    and so works the whole array out a second time next to the scan.
    """
    return factors.select("finding_id", F.posexplode_outer("factors").alias("rank", "factor"))


@query("top_factors")
def top_factors_query(spark, sf_dir):
    factors = contributions.top_factors(explained(spark, sf_dir), FEATURE_NAMES)
    return _ranked_factors(factors).select(
        "finding_id", "rank", F.col("factor.name").alias("feature"), F.col("factor.value").alias("contribution")
    )


@query("explanation_text")
def explanation_text_query(spark, sf_dir):
    return contributions.explanation_text(contributions.top_factors(explained(spark, sf_dir), FEATURE_NAMES))


@query("pattern_prompt")
def pattern_prompt_query(spark, sf_dir):
    return pattern_prompt(contributions.global_importance(explained(spark, sf_dir), FEATURE_NAMES))


# The same operators over contributions SQL can state: how far each term of the
# score lies from the middle of its range.
_TERMS = ("ml", "cvss", "epss", "exposure", "repo_criticality")
_TERMS_SQL = "terms AS (SELECT * FROM (UNPIVOT (SELECT finding_id, {} FROM scored) ON {} INTO NAME name VALUE v))".format(
    ", ".join(f"{WEIGHTS[name]}::DOUBLE * {PARTS[name]} - {WEIGHTS[name] / 2}::DOUBLE AS {name}" for name in _TERMS), ", ".join(_TERMS)
)
_BEST_SQL = f"{_TERMS_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY abs(v) DESC, name) AS k FROM terms)"


def term_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = score_terms()
    values = [terms[name] - WEIGHTS[name] / 2 for name in _TERMS]
    return scored(spark, sf_dir).select("finding_id", F.array(*values).alias("contributions"))


@query("importance_of_terms", on("scored", f"{_TERMS_SQL} SELECT name AS feature, {settle_sql('avg(abs(v))')} AS importance FROM terms GROUP BY name"))
def importance_of_terms_query(spark, sf_dir):
    return settled(contributions.global_importance(term_contributions(spark, sf_dir), _TERMS))


@query("factors_of_terms", on("scored", f"{_BEST_SQL} SELECT finding_id, CAST(k - 1 AS INTEGER) AS rank, name AS feature, {settle_sql('v')} AS contribution FROM best WHERE k <= 3"))
def factors_of_terms_query(spark, sf_dir):
    factors = contributions.top_factors(term_contributions(spark, sf_dir), _TERMS, 3)
    return settled(
        _ranked_factors(factors).select(
            "finding_id", "rank", F.col("factor.name").alias("feature"), F.col("factor.value").alias("contribution")
        )
    )


@query(
    "explanation_of_terms",
    on("scored", f"""{_BEST_SQL} SELECT finding_id, 'Risk Score Explanation:' || chr(10) || string_agg('  - ' || name ||
  CASE WHEN v > 0 THEN ' increases risk by ' ELSE ' decreases risk by ' END || printf('%.4f', abs(v)), chr(10) ORDER BY k) AS explanation FROM best GROUP BY finding_id"""),
)
def explanation_of_terms_query(spark, sf_dir):
    return contributions.explanation_text(contributions.top_factors(term_contributions(spark, sf_dir), _TERMS))


@query(
    "pattern_prompt_of_terms",
    on("scored", f"""{_TERMS_SQL}, means AS (SELECT name, avg(abs(v)) AS m FROM terms GROUP BY name),
placed AS (SELECT *, row_number() OVER (ORDER BY m DESC, name) AS k FROM means)
SELECT concat_ws(chr(10), '# Feature importance', string_agg(k || '. ' || name || ': ' || printf('%.4f', m), chr(10) ORDER BY k), '# Task', '{PATTERN_TASK[0]}') AS prompt FROM placed"""),
)
def pattern_prompt_of_terms_query(spark, sf_dir):
    return pattern_prompt(contributions.global_importance(term_contributions(spark, sf_dir), _TERMS))


@query("text_embed_pca")
def text_embed_pca_query(spark, sf_dir):
    return embeddings.reduce_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", keep=("vec_id",))


@query(
    "text_embed_energy",
    f"""WITH cells AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT i, avg(x) AS m FROM cells GROUP BY i)
SELECT vec_id, {settle_sql('sum((x - m) * (x - m))')} AS energy FROM cells JOIN means USING (i) GROUP BY vec_id""",
)
def text_embed_energy_query(spark, sf_dir):
    """Squared length of each reduced vector: with all components kept it is that of the centred input."""
    table = text_embed_pca_query(spark, sf_dir)
    squares = [F.col(name) * F.col(name) for name in table.columns if name != "vec_id"]
    return settled(table.select("vec_id", reduce(lambda a, b: a + b, squares).alias("energy")))


@query("text_embed_batches", "SELECT vec_id, 1 AS same FROM embeddings")
def text_embed_batches_query(spark, sf_dir):
    """Vectors reduced in two batches by one fit against all reduced at once."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    fitted = embeddings.fit_vectors(table, "embedding")
    whole = embeddings.apply_vectors(table, "embedding", fitted, keep=("vec_id",))
    halves = [embeddings.apply_vectors(table.filter(F.col("vec_id") % 2 == half), "embedding", fitted, keep=("vec_id",)) for half in (0, 1)]
    both = halves[0].unionByName(halves[1])
    values = lambda df, name: df.select("vec_id", F.array(*embeddings.VECTOR_NAMES).alias(name))
    return values(whole, "a").join(values(both, "b"), "vec_id").select("vec_id", (F.col("a") == F.col("b")).cast("int").alias("same"))
