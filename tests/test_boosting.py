import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from findrisk.operators import boosting, training
from findrisk.operators.boosting import Settings
from findrisk.storage import stage

NAMES = ["a", "b", "c"]


def rows_of(seed, n):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 6, n), rng.integers(0, 40, n) / 4, rng.normal(size=n).round(1)])
    label = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 3) * (x[:, 2] > 0) - 0.3 * (x[:, 1] - 5)))).astype(int)
    return x, label


def frame(spark, x, label):
    rows = [(f"f{i}", int(y), *map(float, row)) for i, (row, y) in enumerate(zip(x, label))]
    return stage(spark.createDataFrame(rows, "finding_id string, label int, a double, b double, c double").repartition(3))


def by_hand(x, label, s, rounds):
    """Boosting from its definition: every threshold of every feature, row by row; margins after all rounds."""
    n, margin = len(x), np.zeros(len(x))
    thin = lambda g: math.copysign(max(abs(g) - s.l1, 0.0), g)

    def tree(rows, depth, g, h):
        gs, hs = sum(g[i] for i in rows), sum(h[i] for i in rows)
        leaf = -s.eta * thin(gs) / (hs + s.l2)
        if depth == s.max_depth:
            return {i: leaf for i in rows}
        best = None
        for k in range(x.shape[1]):
            for t in sorted({x[i, k] for i in rows})[:-1]:
                left = [i for i in rows if x[i, k] <= t]
                lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                if lh < s.least_hessian or hs - lh < s.least_hessian:
                    continue
                gain = thin(lg) ** 2 / (lh + s.l2) + thin(gs - lg) ** 2 / (hs - lh + s.l2) - thin(gs) ** 2 / (hs + s.l2)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, k, t)
        if best is None or best[0] <= 1e-9:
            return {i: leaf for i in rows}
        _, k, t = best
        low, high = [i for i in rows if x[i, k] <= t], [i for i in rows if x[i, k] > t]
        return tree(low, depth + 1, g, h) | tree(high, depth + 1, g, h)

    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-margin))
        # the unit of the library, so that both see the same sums
        g, h = np.rint((chance - label) * 2**20) / 2**20, np.rint(chance * (1 - chance) * 2**20) / 2**20
        steps = tree(list(range(n)), 0, g, h)
        margin = margin + np.array([steps[i] for i in range(n)])
    return margin


@pytest.mark.parametrize("settings", [Settings(3, 0.3, 1.0, 1.0, 1.0, 0.5), Settings(2, 0.5, 1.0, 1.0, 0.0, 0.0, 0.5), Settings(4, 0.1, 1.0, 1.0, 5.0, 2.0)])
def test_margins_equal_brute_force(spark, settings):
    x, label = rows_of(1, 120)
    table = frame(spark, x, label)
    model = training.train(
        table, NAMES, rounds=4, max_depth=settings.max_depth, eta=settings.eta, subsample=1.0, colsample=1.0,
        l2=settings.l2, l1=settings.l1, least_hessian=settings.least_hessian,
    )
    got = {r.finding_id: r.margin for r in training.margins(model, table).collect()}
    want = by_hand(x, label, settings, 4)
    assert np.abs(want).max() > 0.1
    assert [got[f"f{i}"] for i in range(len(x))] == pytest.approx(list(want), abs=1e-9)


def test_blocks_and_partitions_give_the_same_trees(spark):
    x, label = rows_of(2, 900)
    table = frame(spark, x, label).withColumn("valid", F.xxhash64("finding_id") % 5 == 0)
    settings = dict(rounds=13, max_depth=4, eta=0.4, subsample=0.7, colsample=0.67, validation="valid", patience=13)
    one = training.train(table, NAMES, **settings)
    many = training.train(table.repartition(7), NAMES, block_rows=130, **settings)
    assert one.trees and one.trees == many.trees
    assert len({tuple(tree.feature) for tree in one.trees}) > 1


def test_rounds_end_after_patience_in_blocks_too(spark):
    x, label = rows_of(3, 400)
    noise = np.random.default_rng(0).integers(0, 2, 400)
    table = frame(spark, x, noise).withColumn("valid", F.xxhash64("finding_id") % 3 == 0)
    settings = dict(rounds=40, eta=0.8, validation="valid", patience=3)
    one, many = training.train(table, NAMES, **settings), training.train(table, NAMES, block_rows=100, **settings)
    assert one.trees == many.trees and len(one.trees) < 37


def test_shrinkage_of_leaves(spark):
    x, label = rows_of(4, 200)
    table = frame(spark, x, label)
    sizes = [
        max(abs(v) for tree in training.train(table, NAMES, rounds=1, subsample=1.0, colsample=1.0, l1=l1, l2=l2).trees for v in tree.value)
        for l1, l2 in ((0.0, 0.0), (0.0, 20.0), (10.0, 0.0), (1e6, 0.0))
    ]
    assert sizes[0] > sizes[1] > 0 and sizes[0] > sizes[2] > 0 and sizes[3] == 0


def test_bins_by_value_or_quantile(spark):
    rows = [(f"f{i}", i % 2, float(i % 5), float(i), 1.0) for i in range(2000)]
    table = spark.createDataFrame(rows, "finding_id string, label int, a double, b double, c double").repartition(4)
    few, many, one = boosting.cut_points(table, NAMES, 16)
    assert few.tolist() == [0, 1, 2, 3] and one.tolist() == []
    assert len(many) == 15 and np.abs(many - np.arange(1, 16) * 125).max() <= 20


def test_sampling_is_about_the_share_and_differs_by_round():
    s = Settings()
    keys = np.arange(20_000)
    first, second = boosting.sampled(keys, 0, s), boosting.sampled(keys, 1, s)
    assert abs(first.mean() - 0.8) < 0.02 and (first != second).mean() > 0.2
    assert len(boosting.columns_of(0, 129, s)) == 103 and boosting.columns_of(0, 129, s).tolist() != boosting.columns_of(1, 129, s).tolist()


def test_area_counts_pairs():
    rng = np.random.default_rng(1)
    margin, label = rng.integers(0, 9, 80).astype(float), rng.integers(0, 2, 80)
    pairs = [(a > b) + (a == b) / 2 for a in margin[label == 1] for b in margin[label == 0]]
    assert boosting.area(margin, label) == pytest.approx(np.mean(pairs))
    assert boosting.area(margin, np.ones(80)) == 0.5


def test_bound_of_training_rows_is_exact(spark):
    table = spark.range(5000).select(F.col("id").cast("string").alias("finding_id"))
    first = training._bounded(table, 700)
    assert first.count() == 700 and first.exceptAll(training._bounded(table.repartition(7), 700)).count() == 0
    assert training._bounded(table, 5000).count() == 5000 and training._bounded(table, None).count() == 5000


def test_one_label_few_rows_and_no_rows(spark):
    table = frame(spark, np.zeros((4, 3)), [1, 1, 1, 1])
    model = training.train(table, NAMES, rounds=3, subsample=1.0, l1=0.0)
    assert all(r.ml_score > 0.5 for r in training.predict(model, table).collect())
    none = training.train(table.limit(0), NAMES, rounds=3)
    assert [r.ml_score for r in training.predict(none, table).collect()] == [0.5] * 4


def _drawn_tree(rng, depth, features):
    tree = boosting.Tree()
    tree.add(0.5, 1.0)
    level = [0]
    for _ in range(depth):
        following = []
        for node in level:
            if rng.random() < 0.1:
                continue
            tree.feature[node], tree.threshold[node] = int(rng.integers(features)), float(rng.integers(0, 400))
            tree.left[node], tree.right[node] = tree.add(rng.normal(), 1.0), tree.add(rng.normal(), 1.0)
            following += [tree.left[node], tree.right[node]]
        level = following
    return tree


@pytest.mark.parametrize(("trees", "depth"), [(40, 6), (6, 10), (2, 0), (0, 0)])
def test_forest_finds_the_same_leaves_as_its_trees(trees, depth):
    rng = np.random.default_rng(5)
    grown = [_drawn_tree(rng, depth, 5) for _ in range(trees)]
    rows = rng.integers(-1, 401, (boosting.CHUNK_ROWS + 100, 5)).astype(float)
    rows[:3] = np.array([np.nan, np.inf, -np.inf])[:, None]
    expected = np.zeros(len(rows))
    for tree in grown:
        expected += np.array(tree.value)[tree.leaves(rows, False)]
    assert (boosting.Forest(grown).margins(rows) == expected).all()


def test_trees_grow_from_all_rows_by_default(spark):
    n = 100_500
    table = spark.range(n).select(F.col("id").cast("string").alias("finding_id"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 7).cast("double").alias("a"))
    (tree,) = training.train(table, ["a"], rounds=1, subsample=1.0, colsample=1.0).trees
    # a row without any tree has a hessian of a quarter
    assert tree.cover[0] == 0.25 * n


def test_rounds_are_judged_on_all_held_rows_by_default(spark, monkeypatch):
    n, seen = 25_000, []
    monkeypatch.setattr(boosting, "boost", lambda rows, *a, **k: seen.append(rows.filter("valid").count()) or [])
    table = spark.range(n).select(F.col("id").cast("string").alias("finding_id"), F.lit(1).alias("label"), F.lit(1.0).alias("a"), (F.col("id") > 0).alias("valid"))
    training.train(table, ["a"], validation="valid")
    assert seen == [n - 1]


def test_bytes_of_bins_give_the_sums_of_their_features():
    rng = np.random.default_rng(6)
    sizes = [1, 2, 2, 128, 3, 5, 2, 90, 2, 1, 40, 7, 2, 2, 2, 2, 2, 2, 2, 11]
    cuts = [np.arange(size - 1.0) for size in sizes]
    matrix = np.column_stack([rng.integers(0, size, 3000) for size in sizes]).astype(float)
    packs = boosting.Packs(cuts)
    codes = packs.codes(matrix, cuts)
    assert len(codes) < 8
    for feature, size in enumerate(sizes):
        for cut in range(size - 1):
            assert (packs.beyond(codes, feature, cut) == (matrix[:, feature] > cut)).all()
    columns, weight = list(range(0, len(sizes), 2)), rng.integers(-9, 9, 3000).astype(float)
    used = packs.used(columns)
    sums = np.stack([np.stack([np.bincount(codes[k], w, 256) for w in (weight, weight + 1)]) for k in used])[None]
    found = packs.by_feature(sums, used, columns)
    for k, column in enumerate(columns):
        for part, w in enumerate((weight, weight + 1)):
            assert (found[0, k, :, part] == np.bincount(matrix[:, column].astype(int), w, 128)).all()


def test_area_by_ranges_is_that_of_all_rows(spark):
    x, label = rows_of(7, 800)
    table = frame(spark, x, label)
    trees = training.train(table, NAMES, rounds=12, eta=0.3).trees
    cuts = boosting.cut_points(table, NAMES)
    packs = boosting.Packs(cuts)
    held = boosting._binned(table, NAMES, "label", True, cuts, packs, 90)
    expected, margin = [], np.zeros(len(x))
    for tree in trees:
        margin += np.array(tree.value)[tree.leaves(x, False)]
        expected.append(boosting.area(margin, label))
    assert len(set(expected)) > 6
    # as many ranges as for a million rows, one range, and trees that add nothing
    assert boosting._areas(held, 1_000_000, trees, trees, packs) == boosting._areas(held, 800, trees, trees, packs) == expected
    assert boosting._areas(held, 1_000_000, [boosting.Tree([0], [0], [0.0], [0], [0], [0.0], [1.0])], [], packs) == []


def test_working_tables_of_training_are_deleted(spark, monkeypatch):
    x, label = rows_of(8, 300)
    table = frame(spark, x, label).withColumn("valid", F.xxhash64("finding_id") % 5 == 0)
    staged, keep = [], boosting.stage
    noted = lambda df, name="table", **options: staged.append(keep(df, name, **options)) or staged[-1]
    monkeypatch.setattr(boosting, "stage", noted)
    monkeypatch.setattr(training, "stage", noted)
    training.train(table, NAMES, rounds=21, validation="valid", patience=21, block_rows=100)
    assert len(staged) == 7
    for one in staged:
        with pytest.raises(Exception, match="NOT_EXIST|not exist"):
            one.count()
