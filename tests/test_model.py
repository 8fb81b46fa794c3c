from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from findrisk import batch
from findrisk.batch import evaluate_model, explain_cve, explain_top, prompt_top, score_findings, train_model
from findrisk.operators import contributions, embeddings, training
from findrisk.operators.scoring import ranked_table, top_findings
from findrisk.plans.findings import AS_OF, findings
from findrisk.storage import stage

NAMES = ["x0", "x1", "x2", "x3"]


@pytest.fixture(scope="module")
def matrix(spark):
    draw = [((F.col("id") * (i * 2 + 3) * 7919) % 101 / 10).cast("double").alias(name) for i, name in enumerate(NAMES)]
    table = spark.range(800).select(F.col("id").cast("string").alias("finding_id"), *draw)
    return stage(table.withColumn("label", ((F.col("x0") > 5) != ((F.col("x1") > 3) & (F.col("x2") < 7))).cast("int")))


@pytest.fixture(scope="module")
def model(matrix):
    return training.train(matrix, NAMES, rounds=4, max_depth=4, eta=0.3)


@pytest.fixture(scope="module")
def explained(model, matrix):
    return stage(contributions.contributions(model, training.feature_vectors(model, matrix)))


def test_contributions_add_up_to_the_margin(model, matrix, explained):
    raw = training.margins(model, matrix, into="raw")
    worst = explained.join(raw, "finding_id").agg(F.max(F.abs(F.col("margin") - F.col("raw"))), F.count(F.lit(1))).first()
    assert worst[0] < 1e-9 and worst[1] == 800


def _conditional(tree, node, x, known):
    """Expected value of a tree when only some features are known."""
    left, right = tree.left[node], tree.right[node]
    if left == node:
        return tree.value[node]
    feature, threshold = tree.feature[node], tree.threshold[node]
    if feature in known:
        return _conditional(tree, left if x[feature] <= threshold else right, x, known)
    share = tree.cover[left] / tree.cover[node]
    return share * _conditional(tree, left, x, known) + (1 - share) * _conditional(tree, right, x, known)


def test_contributions_are_the_shapley_values(model, matrix, explained):
    got = {r.finding_id: r.contributions for r in explained.filter("finding_id < '2'").limit(25).collect()}
    for row in matrix.filter(F.col("finding_id").isin(list(got))).collect():
        x = [row[name] for name in NAMES]

        def value(known):
            return sum(_conditional(tree, 0, x, known) for tree in model.trees)

        for i in range(4):
            rest = [j for j in range(4) if j != i]
            exact = sum(
                factorial(size) * factorial(3 - size) / factorial(4) * (value({*s, i}) - value(set(s)))
                for size in range(4)
                for s in combinations(rest, size)
            )
            assert got[row.finding_id][i] == pytest.approx(exact, abs=1e-9)


def test_global_importance_is_the_mean_size(explained):
    sizes = np.abs(np.array([r.contributions for r in explained.collect()])).mean(axis=0)
    found = {r.feature: r.importance for r in contributions.global_importance(explained, NAMES).collect()}
    assert [found[name] for name in NAMES] == pytest.approx(list(sizes))


def test_top_factors_and_text(explained):
    row = explained.first()
    factors = contributions.top_factors(explained, NAMES, 2).filter(F.col("finding_id") == row.finding_id)
    order = sorted(zip(NAMES, row.contributions), key=lambda p: -abs(p[1]))[:2]
    assert [(f.name, f.value) for f in factors.first().factors] == order
    lines = contributions.explanation_text(factors).first().explanation.split("\n")
    name, value = order[0]
    assert lines[1] == f"  - {name} {'increases' if value > 0 else 'decreases'} risk by {abs(value):.4f}"


def test_saved_model_predicts_the_same(model, matrix, tmp_path):
    training.save_model(model, str(tmp_path / "model"))
    loaded = training.load_model(str(tmp_path / "model"))
    assert training.model_features(loaded) == NAMES
    extra = matrix.drop("x3").withColumn("unused", F.lit(1))  # aligned: x3 becomes 0
    assert training.predict(loaded, extra).exceptAll(training.predict(model, extra)).count() == 0


def test_validation_rows_stop_early(matrix):
    held_out = matrix.withColumn("valid", F.col("finding_id").cast("int") % 5 == 0).withColumn("label", (F.col("finding_id").cast("int") * 7919 % 13 > 5).cast("int"))
    model = training.train(held_out, NAMES, rounds=60, max_depth=4, eta=0.9, validation="valid")
    assert len(model.trees) < 60


def test_best_prefix_and_cut_model(spark, matrix, tmp_path):
    """The trees that stay give the largest area of all prefixes, and a cut model sums exactly its trees."""
    marked = matrix.withColumn("valid", F.xxhash64("finding_id") % 4 == 0)
    noisy = stage(marked.withColumn("label", F.when(F.xxhash64("x0", "finding_id") % 3 == 0, 1 - F.col("label")).otherwise(F.col("label"))))
    settings = dict(rounds=12, max_depth=3, eta=0.5, l1=0.0)
    best = training.train(noisy, NAMES, validation="valid", patience=12, **settings)
    full = training.train(noisy.filter("not valid"), NAMES, **settings)
    rows = noisy.filter("valid").collect()
    labels = np.array([row["label"] for row in rows])
    areas, totals = [], np.zeros(len(rows))
    for tree in full.trees:
        totals = totals + np.array([_conditional(tree, 0, [row[n] for n in NAMES], set(range(4))) for row in rows])
        areas.append(np.mean([(a > b) + (a == b) / 2 for a in totals[labels == 1] for b in totals[labels == 0]]))
    n = len(best.trees)
    assert areas[n - 1] == pytest.approx(max(areas)) and max(areas[: n - 1], default=0) < max(areas)
    assert best.trees == full.trees[:n]
    cut = training.first_trees(full, 2)
    held_out = spark.createDataFrame(rows)
    want = {row["finding_id"]: sum(_conditional(tree, 0, [row[n] for n in NAMES], set(range(4))) for tree in full.trees[:2]) for row in rows}
    assert {r.finding_id: r.margin for r in training.margins(cut, held_out).collect()} == pytest.approx(want)
    training.save_model(cut, str(tmp_path / "cut"))
    loaded = training.load_model(str(tmp_path / "cut"))
    assert loaded.settings == full.settings and loaded.settings["l2"] == 1.0
    assert training.predict(loaded, matrix).exceptAll(training.predict(cut, matrix)).count() == 0


def test_text_vectors_travel_with_the_model(spark, tmp_path):
    """Scored whole or in two batches, by the model or its saved form, a finding gets the same score."""
    vector = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.sin(F.xxhash64("finding_id", i).cast("double") % 97))
    table = findings(spark, "/root/testdata/sf0.001").limit(500).withColumn("v", F.when(F.xxhash64("finding_id") % 7 != 0, vector))
    raw = stage(table)
    model, _ = train_model(raw, AS_OF, rounds=2, max_depth=3, blocks=("cve_core", "text"), vectors="v", leave_one_out=True)
    assert len(training.model_features(model)) > 100
    training.save_model(model, str(tmp_path / "m"))
    loaded = training.load_model(str(tmp_path / "m"))
    settings = dict(blocks=("cve_core", "text"), vectors="v")
    whole = score_findings(raw, model, AS_OF, **settings).select("finding_id", "ml_score")
    parts = [score_findings(raw.filter(F.xxhash64("finding_id") % 2 == k), loaded, AS_OF, **settings) for k in (-1, 0, 1)]
    both = parts[0].select("finding_id", "ml_score").union(parts[1].select("finding_id", "ml_score")).union(parts[2].select("finding_id", "ml_score"))
    assert whole.exceptAll(both).count() == 0 and both.count() == raw.count()


def test_null_vectors_become_zeros(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [3.0, -1.0]), (4, [0.0, 0.5])], "vec_id long, v array<double>")
    rows = {r.vec_id: r for r in embeddings.reduce_vectors(table, "v", keep=("vec_id",)).collect()}
    assert all(rows[2][name] == 0.0 for name in embeddings.VECTOR_NAMES)
    assert any(rows[1][name] != 0.0 for name in embeddings.VECTOR_NAMES)


def test_train_save_load_and_score_end_to_end(spark, tmp_path):
    raw = stage(findings(spark, "/root/testdata/sf0.001").filter("user_action <> 'monitoring'").limit(600).drop("finding_id"))
    model, parted = train_model(raw, AS_OF, rounds=2, max_depth=3, validation_share=0.2)
    assert len(training.model_features(model)) == 129
    assert {r.split: r["count"] for r in parted.groupBy("split").count().collect()} == {"train": 480, "test": 120}
    quality = evaluate_model(model, parted).first()
    assert quality.total_samples == 120 and 0 <= quality.auc <= 1
    training.save_model(model, str(tmp_path / "model"))
    scored = stage(score_findings(raw, training.load_model(str(tmp_path / "model")), AS_OF))
    assert scored.filter("risk_score between 0 and 1 and tier is not null").count() == 600
    assert scored.select("finding_id").distinct().count() == 600
    rows = top_findings(ranked_table(scored), 600).collect()
    assert [r.risk_score for r in rows] == sorted((r.risk_score for r in rows), reverse=True)
    assert {"cve_id", "release", "has_patch", "tier"} <= set(ranked_table(scored).columns)
    told = explain_top(raw, model, AS_OF, n=4, factors=2).collect()
    assert [r.risk_score for r in told] == [r.risk_score for r in rows[:4]]
    assert all(len(r.factors) == 2 and r.explanation.count("\n") == 2 for r in told)
    asked = prompt_top(raw, model, AS_OF, n=4, factors=2).collect()
    lines = {r.finding_id: r.prompt for r in asked}
    assert all(f"  - {f.name}: {f.value:+.4f}" in lines[r.finding_id] for r in told for f in r.factors)
    one = explain_cve(raw, model, AS_OF, told[0].cve_id, factors=3).collect()
    assert {r.cve_id for r in one} == {told[0].cve_id} and len(one) == scored.filter(F.col("cve_id") == told[0].cve_id).count()
    first = next(r for r in one if r.finding_id == told[0].finding_id)
    assert first.risk_score == told[0].risk_score and [f.name for f in first.factors[:2]] == [f.name for f in told[0].factors]


def test_random_split_is_the_other_choice(spark):
    raw = stage(findings(spark, "/root/testdata/sf0.001").filter("user_action <> 'monitoring'").limit(300))
    _, parted = train_model(raw, AS_OF, split="random", blocks=("cve_core", "time"), rounds=1, max_depth=2)
    assert parted.filter("split = 'test'").count() == pytest.approx(60, abs=2)
    with pytest.raises(ValueError):
        train_model(raw, AS_OF, split="odd", blocks=("time",))


def test_reduced_vectors_keep_the_variance(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(50, 6)) @ np.diag([5, 3, 1, 1, 0.5, 0.1]) + 7
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(data)], "vec_id long, v array<double>")
    result = embeddings.reduce_vectors(table, "v", keep=("vec_id",)).orderBy("vec_id").collect()
    reduced = np.array([[r[f"text_embed_{i}"] for i in range(100)] for r in result])
    singular = np.linalg.svd(data - data.mean(axis=0), compute_uv=False)
    assert np.sqrt((reduced[:, :6] ** 2).sum(axis=0)) == pytest.approx(singular)
    assert not reduced[:, 6:].any()


def test_one_vector_cannot_be_reduced(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, v array<double>")
    row = embeddings.reduce_vectors(table, "v", keep=("vec_id",)).first()
    assert all(row[f"text_embed_{i}"] == 0.0 for i in range(100))


def test_deep_trees_are_explained(spark, matrix):
    """Paths longer than any table of patterns could hold: the parts still add up to the margin."""
    draw = [((F.col("finding_id").cast("int") * (i * 2 + 3) * 7919) % 101 / 10).cast("double").alias(f"d{i}") for i in range(16)]
    names = [f"d{i}" for i in range(16)]
    noise = F.pmod(F.xxhash64("finding_id"), F.lit(2)).cast("int")
    table = stage(matrix.select("finding_id", *draw, noise.alias("label")))
    model = training.train(table, names, rounds=2, max_depth=15, eta=0.3, subsample=1.0, colsample=1.0, l1=0.0, l2=0.0, least_hessian=0.0)
    longest = max(group["features"].shape[1] for group in contributions.compile_trees(model)["groups"])
    assert longest > 6
    parts = contributions.contributions(model, training.feature_vectors(model, table))
    raw = training.margins(model, table, into="raw")
    assert parts.join(raw, "finding_id").agg(F.max(F.abs(F.col("margin") - F.col("raw")))).first()[0] < 1e-9


def test_rows_that_meet_the_same_conditions_share_a_table_entry(spark, matrix):
    """The tabulated values are those of every row by itself, and the conditions are weighed once per pattern, not per row."""
    import numpy as np

    rng = np.random.default_rng(3)
    draw = [F.pmod(F.xxhash64("finding_id", F.lit(i)), F.lit(50)).cast("double").alias(f"d{i}") for i in range(6)]
    names = [f"d{i}" for i in range(6)]
    table = stage(matrix.select("finding_id", *draw, F.pmod(F.xxhash64("finding_id"), F.lit(2)).cast("int").alias("label")))
    model = training.train(table, names, rounds=3, max_depth=4, eta=0.3, l1=0.0, l2=0.0, least_hessian=0.0)
    compiled = contributions.compile_trees(model)
    values = rng.integers(0, 50, (500, 6)).astype(float)
    weighed = []
    plain = contributions._values
    contributions._values = lambda group, met: weighed.append(len(met)) or plain(group, met)
    try:
        together = contributions._explain_batch(compiled, values)
        most = max(weighed)
    finally:
        contributions._values = plain
    alone = np.concatenate([contributions._explain_batch(compiled, values[i : i + 1]) for i in range(len(values))])
    assert np.abs(together - alone).max() < 1e-12 and np.abs(alone).max() > 0
    assert most <= 16


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_matrix_is_made_only_for_the_rows_asked_for(spark):
    """Rows are staged before they become wide, and a filter is applied to them before statistics are attached."""
    _, parted = train_model(findings(spark, "/root/testdata/sf0.001"), AS_OF, rounds=1)
    assert "split" in parted.columns and parted.filter("split = 'test'").count() < parted.count()
    chosen = parted.filter(F.col("finding_id").isin("1-1", "2-1"))
    staged = chosen._jdf.queryExecution().optimizedPlan().collectLeaves().head().output().mkString(",")
    assert "cvss_vector" in staged and "is_cwe_79" not in staged and "attack_vector_network" not in staged
    lines = _plan(chosen).splitlines()
    lowest_join = max(i for i, line in enumerate(lines) if "BroadcastHashJoin" in line)
    assert any("Filter" in line and "finding_id" in line for line in lines[lowest_join:])


def test_bounded_training_rows_are_chosen_by_a_filter(spark, matrix):
    keys = matrix.select("finding_id")
    chosen = training._bounded(matrix, 100, keys)
    assert chosen.count() == 100 and "Join" not in _plan(chosen)
    order = F.pmod(F.xxhash64(F.lit("rows"), F.col("finding_id")), F.lit(1 << 62))
    first = {row[0] for row in keys.orderBy(order, "finding_id").limit(100).collect()}
    assert {row[0] for row in chosen.select("finding_id").collect()} == first


def test_few_chosen_findings_are_looked_for_by_value(spark, matrix):
    from findrisk import batch

    top = matrix.orderBy("finding_id").limit(7)
    for n in (7, batch.LISTED + 1):
        assert batch._chosen(matrix, top, n).count() == 7
    assert "Join" not in _plan(batch._chosen(matrix, top, 7))


def test_findings_ranked_once_serve_explanations_and_prompts(spark, monkeypatch):
    raw = stage(findings(spark, "/root/testdata/sf0.001").filter("user_action <> 'monitoring'").limit(200))
    model, _ = train_model(raw, AS_OF, rounds=2, max_depth=2)
    alone = [sorted(f(raw, model, AS_OF, n=3).collect()) for f in (explain_top, prompt_top)]
    scored = []
    monkeypatch.setattr(batch, "_score_matrix", lambda *a, f=batch._score_matrix: scored.append(1) or f(*a))
    ranked = batch.rank_all(raw, model, AS_OF)
    assert [sorted(f(raw, model, AS_OF, n=3, ranked=ranked).collect()) for f in (explain_top, prompt_top)] == alone
    assert scored == [1]
