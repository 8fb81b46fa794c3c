import zlib

import numpy as np
import pytest

from llm import language_id as lid

SMALL = "/root/testdata/sf0.001"
# enough held-back rows for a temperature that means something
MIDDLE = "/root/testdata/sf0.01"


def counts_by_hand(text):
    """Bucket counts of one text, from the definition."""
    lower, _ = lid._letters()
    words = "".join(chr(lower[ord(c)]) if lower[ord(c)] else " " for c in text).split()
    out = {}
    for word in words:
        padded = [0, *map(ord, word), 0]
        for size in lid.SIZES:
            for i in range(len(padded) - size + 1):
                gram = padded[i : i + size]
                if any(gram) and 0 not in gram[1:-1] and (size > 1 or gram[0]):
                    code = (gram[0] + int(lid._SEED[size - 1])) % 2**64
                    for g in gram[1:]:
                        code = (code * int(lid._SEED[0]) + g) % 2**64
                    bucket = int(lid.wordkernel.mix(np.array([code], np.uint64))[0]) % lid.BUCKETS
                    out[bucket] = out.get(bucket, 0) + 1
    return out


TEXTS = ["Hello, World", "", "  ", "12 + 3", "É été\nüber", "a", "\0b\0c", "日本 İx", "éa", "x" * 5000]


def test_counts_are_those_of_the_definition():
    found = lid.grams(TEXTS)
    for i, text in enumerate(TEXTS):
        cut = slice(found.bounds[i], found.bounds[i + 1])
        assert dict(zip(found.bucket[cut].tolist(), found.count[cut].tolist())) == counts_by_hand(text), text
    assert found.has_letter.tolist() == [any(c.isalpha() for c in text) for text in TEXTS]


def test_ftrl_matches_the_update_written_out():
    rng = np.random.default_rng(5)
    model = lid.Ftrl(6, 3)
    z, n = np.zeros((7, 3)), np.zeros((7, 3))
    l1, l2 = np.array([model.l1[0, 0]] * 6 + [0.0]), np.array([model.l2[0, 0]] * 6 + [0.0])

    def weight(i, k):
        if abs(z[i, k]) <= l1[i]:
            return 0.0
        return -(z[i, k] - np.sign(z[i, k]) * l1[i]) / ((model.beta + np.sqrt(n[i, k])) / model.alpha + l2[i])

    for _ in range(60):
        rows = rng.choice(6, 3, replace=False)
        value, label = rng.random(3), int(rng.integers(3))
        x = dict(zip(rows.tolist(), value.tolist())) | {6: 1.0}
        w = {i: [weight(i, k) for k in range(3)] for i in x}
        scores = np.array([sum(x[i] * w[i][k] for i in x) for k in range(3)])
        chance = np.exp(scores) / np.exp(scores).sum()
        for i in x:
            for k in range(3):
                slope = x[i] * (chance[k] - (k == label))
                z[i, k] += slope - (np.sqrt(n[i, k] + slope**2) - np.sqrt(n[i, k])) / model.alpha * w[i][k]
                n[i, k] += slope**2
        model.learn(rows, value, label)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)
    assert np.allclose(model.weights(), [[weight(i, k) for k in range(3)] for i in range(7)])


def test_l1_leaves_useless_weights_at_zero():
    rng = np.random.default_rng(1)
    model = lid.Ftrl(200, 2, l1=1.0)
    for _ in range(400):
        label = int(rng.integers(2))
        model.learn(np.array([label, int(rng.integers(2, 200))]), np.array([1.0, 0.05]), label)
    weights = model.weights()
    assert weights[:2].all() and not weights[2:-1].any()


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 3, 400)
    scores = rng.normal(size=(400, 3)) * 4
    scores[np.arange(400), labels] += 3
    best = lid.best_temperature(scores, labels)
    target = np.full(scores.shape, 1 / 403)
    target[np.arange(400), labels] = 401 / 403
    loss = lambda t: -(target * np.log(lid.softmax(scores / t))).sum(axis=1).mean()
    assert loss(best) <= min(loss(t) for t in np.exp(np.linspace(np.log(0.05), np.log(20), 300))) + 1e-9
    assert lid.best_temperature(scores[:0], labels[:0]) == 1.0


def test_document_frequencies_cover_all_texts(spark):
    docs = spark.createDataFrame([(t,) for t in [*TEXTS, None] * 3], "text string").repartition(5)
    frequency, n = lid.document_frequencies(docs)
    expected = np.zeros(lid.BUCKETS, int)
    for text in TEXTS * 3:
        for bucket in counts_by_hand(text):
            expected[bucket] += 1
    assert n == 33 and frequency.tolist() == expected.tolist()


def test_held_out_accuracy_and_calibration(spark):
    from llm.queries import QUERIES

    found = {row["doc_id"]: row for row in QUERIES["op13_language_id"](spark, MIDDLE).collect()}
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang").collect()
    assert len(found) == len(docs)
    for row in docs:
        assert found[row["doc_id"]]["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)
    held = [row for row in docs if found[row["doc_id"]]["held_out"] and found[row["doc_id"]]["lang_pred"] != "und"]
    right = sum(found[row["doc_id"]]["lang_pred"] == row["lang"] for row in held)
    assert len(held) > 20 and right / len(held) >= 0.95
    mean = sum(found[row["doc_id"]]["score"] for row in held) / len(held)
    assert abs(mean - right / len(held)) < 0.1


ROWS = [
    (1, "the cat and the hat", "en", "a", 1.0),
    (2, "le chat et le chapeau", "fr", "b", 2.0),
    (2, "le chat et le chapeau", "fr", "b", 2.0),
    (3, "the dog and the fog " * 4000, "en", "c", 3.0),
    (4, None, "en", None, 4.0),
    (5, "12 %% 34", "fr", None, 5.0),
    (None, "the mat and a bat", None, None, None),
    (7, "", None, "z", 7.0),
]
SCHEMA = "doc_id long, text string, lang string, `row` string, `label.x` double"


def test_nulls_empty_and_long_texts_repeats_and_clashing_names(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    model = lid.train(docs)
    assert model.labels == ("en", "fr")
    rows = lid.identify(docs, model).orderBy("doc_id").collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", "lang", "row", "label.x", "lang_pred", "score"}
    assert [(r["doc_id"], r["lang_pred"]) for r in rows] == [
        (None, "en"), (1, "en"), (2, "fr"), (2, "fr"), (3, "en"), (4, "und"), (5, "und"), (7, "und")
    ]
    assert all(0.5 <= r["score"] <= 1 for r in rows[:5]) and [r["score"] for r in rows[5:]] == [0, 0, 0]
    assert rows[2] == rows[3] and [r["row"] for r in rows[1:3]] == ["a", "b"]
    replaced = lid.identify(docs, model, into="row").columns
    assert replaced.count("row") == 1


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_change_the_model(spark, parts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    base, other = lid.train(docs, most_rows=60), lid.train(docs.repartition(parts), most_rows=60)
    assert base.labels == other.labels and base.temperature == other.temperature
    assert np.array_equal(base.weights, other.weights) and np.array_equal(base.idf, other.idf)


def test_sample_is_bounded_and_even(spark):
    rows = spark.createDataFrame([(str(i % 700), "t", "a" if i % 10 else "b") for i in range(2000)], "key string, text string, label string")
    sizes = {r["label"]: r["count"] for r in lid._sample(rows, 300).groupBy("label").count().collect()}
    assert sizes == {"a": 150, "b": 150}


def test_empty_table_has_no_labels(spark):
    docs = spark.createDataFrame([], SCHEMA)
    model = lid.train(docs)
    assert model.labels == ()
    assert lid.identify(docs, model).collect() == []
    one = spark.createDataFrame(ROWS[:1], SCHEMA)
    assert [(r["lang_pred"], r["score"]) for r in lid.identify(one, model).collect()] == [("und", 0.0)]
