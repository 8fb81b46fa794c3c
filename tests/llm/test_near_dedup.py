import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import near_dedup as near


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def expected(rows, size, percent=80):
    """By comparing all pairs."""
    sets = [shingles(text, size) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return {doc_id: (len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(rows)}


def corpus(seed):
    """Chains and families of edited texts, so that groups hold links of every strength."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(4000)
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 8, 40, 120, 400]))]
        texts.append(base)
        chain = base
        for k in range(rng.choice([0, 1, 5, 30])):
            origin = chain if rng.random() < 0.5 else base
            chain = list(origin)
            for _ in range(rng.randrange(0, 1 + len(chain) // 25)):
                chain[rng.randrange(len(chain))] = word()
            texts.append(chain)
            if k == 3:
                texts.append(list(chain))
    rng.shuffle(texts)
    return [(i * 7 % 10007, " ".join(t).title() if i % 5 == 0 else "\n".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed, size", [(1, 4), (2, 5)])
def test_groups_as_by_all_pairs(spark, seed, size):
    rows = corpus(seed) + [(20000, ""), (20001, None), (20002, " \n"), (20003, "one"), (20004, "ONE"), (20005, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("c", F.lit("x")).repartition(5)
    want = expected(rows, size)
    for i in (20000, 20001, 20002):
        want[i] = (0, i)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(docs, shingle_words=size).collect()}
    assert got == want


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (3, "A b c d e f g"), (None, "x y z"), (None, "x y z"), (9, None), (9, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("group", F.lit("kept"))
    got = near.near_dedup(docs)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got.collect())
    assert kept == [(False, 3, "A b c d e f g"), (False, 8, ""), (False, 9, ""), (False, 9, ""), (True, 0, "x y z")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near.near_duplicates(docs).count() == 0
    assert near.near_dedup(docs).count() == 0


def test_components_of_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.c: r.component for r in near.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_keys_guarantee_the_distance():
    """Signatures that differ in MOST_DIFFERENT components share a key, however these lie."""
    rng = random.Random(3)
    for _ in range(500):
        differ = set(rng.sample(range(near.CHUNKS * near.CHUNK), near.MOST_DIFFERENT))
        assert any(not differ & set(kept) for _, kept in near.KEYS)


def family(seed, n):
    """Edits of one text by up to a third of its words: links of every strength, several components."""
    rng = random.Random(seed)
    base = ["w%d" % rng.randrange(9999) for _ in range(150)]
    texts = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 18)):
            words[rng.randrange(150)] = "x%d" % rng.randrange(10**6)
        texts.append(" ".join(words))
    return list(enumerate(texts))


@pytest.mark.parametrize("bucket, block, weight", [(2048, 2_000_000, 2000), (7, 3000, 150)])
def test_graded_family(spark, monkeypatch, bucket, block, weight):
    monkeypatch.setattr(near, "BUCKET_BLOCK", bucket)
    monkeypatch.setattr(near, "FAMILY_BLOCK", block)
    monkeypatch.setattr(near, "CLASS_WEIGHT", weight)
    rows = family(4, 90)
    want = expected(rows, 4)
    assert len({component for _, component in want.values()}) > 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(docs, shingle_words=4).collect()}
    assert got == want


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 20_000, rng.integers(0, 9000)).astype(np.uint64)) for _ in range(9)]
    got = near.overlaps(sets[:4], sets[4:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]
    assert near.overlaps([], sets).shape == (0, 9)


def test_one_family_is_cut_in_key_ranges(spark, monkeypatch):
    """Blocks are prefix sums along the components; no task takes a whole family."""
    rows = [(7, c, c // 3, 5 + c % 40) for c in range(4000)] + [(8, 9000 + c, 9000, 1) for c in range(5)]
    state = spark.createDataFrame(rows, "family long, c long, component long, n_shingles long").repartition(4)
    groups, totals = [], near.running_totals
    monkeypatch.setattr(near, "running_totals", lambda *args: (groups.append(args[-1]), totals(*args))[1])
    got = {r.c: r.block for r in near._family_blocks(state).collect()}
    before = {7: 0, 8: 0}
    for family, c, _, n in rows:
        assert got[c] == before[family] // near.FAMILY_BLOCK
        before[family] += max(n, near.CLASS_WEIGHT)
    assert len(got) == len(rows)
    assert groups == [["family"]]
