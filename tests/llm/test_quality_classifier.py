import random

from pyspark.sql import functions as F

from llm import quality_classifier as quality

GOOD = "Some plain words of a calm and ordinary text that goes on for a while about nothing in particular at all."
JUNK = "buy*** now%%% cheap### &&& win$$$ | click | here *** ### %%% $$$ spam ||| ### ***"


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(15, 80)))
        if not good:
            text = rng.choice([JUNK * rng.randrange(1, 4), "a b c d e " * 20, text.replace(" ", "*** "), "x"])
        docs.append((i, text, f"h{rng.randrange(5)}", rng.choice(["en", "de", None])))
        labels.append((i, int(good), 0))
    return docs, labels


def tables(spark, docs, labels):
    return (
        spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").selectExpr("*", "1 as label", "'h' as host", "0.5 as p"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_held_out_accuracy(spark):
    docs, labels = corpus(1)
    frame, known = tables(spark, docs, [row for row in labels if row[0] % 2])
    got = {r.doc_id: r.kept for r in quality.classify(frame, known).collect()}
    held = [row for row in labels if not row[0] % 2]
    assert sum(got[i] == bool(good) for i, good, _ in held) / len(held) > 0.95


def test_given_table_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    found = quality.classify(docs, labels.filter(half)).join(labels.filter(~half), "doc_id")
    right, clean = found.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double")), F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("double")))).first()
    assert right > 0.95 and clean > 0.97


def test_rates_shrink_by_size(spark):
    """The same evidence in a large bad host, a small bad host and a good host."""
    docs = [(i, JUNK, "bad", "a") for i in range(300)] + [(1000 + i, GOOD + f" {i}", "good", "a") for i in range(300)]
    docs += [(2000, JUNK, "small", "a"), (2001, GOOD, "small", "a"), (2002, GOOD, "bad", "a"), (2003, GOOD, "good", "b"), (2004, GOOD, None, None)]
    labels = [(i, 0, 0) for i in range(0, 300, 3)] + [(1000 + i, 1, 0) for i in range(0, 300, 3)]
    got = {r.doc_id: r for r in quality.classify(*tables(spark, docs, labels)).collect()}
    assert got[2002].host_rate < 0.1 < got[2001].host_rate < got[2003].host_rate
    assert got[2002].evidence == got[2001].evidence == got[2003].evidence
    assert got[2002].probability < got[2001].probability < got[2003].probability
    assert abs(got[2003].path_rate - got[2003].host_rate) < 0.05
    assert got[2004].host is None and 0.2 < got[2004].host_rate < 0.9


def test_odd_rows(spark):
    docs = [(1, None, None, None), (1, None, None, None), (None, "", "h", "p"), (3, "x " * 50_000, "h", None), (4, GOOD, "h", "p")]
    labels = [(1, None, 0), (None, 1, 1), (99, 1, 0), (4, 1, 0), (4, 0, 0)]
    rows = quality.classify(*tables(spark, docs, labels)).collect()
    assert len(rows) == 5 and all(0 < r.probability < 1 and r.evidence == 0 for r in rows)
    frame, known = tables(spark, docs, labels)
    assert quality.classify(frame.limit(0), known).count() == 0
    assert quality.classify(frame, known.limit(0)).count() == 5
