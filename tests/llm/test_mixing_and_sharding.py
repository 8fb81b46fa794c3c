import random
import duckdb
import pytest
from pyspark.sql import functions as F

from llm import mixing, quality_rules, sharding
from llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_as_sql(spark, name):
    lake = duckdb.connect()
    lake.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    result = lake.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    want = sorted(map(str, result.fetchall()))
    assert sorted(map(str, (tuple(r) for r in QUERIES[name](spark, FOLDER).select(*columns).collect()))) == want


def test_shards_with_nulls_ties_and_a_giant(spark):
    rows = [(None, None), (None, "ab"), (7, "x" * 1000), (7, "x" * 1000), (8, ""), (9, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as size")
    got = sorted((r.shard, r.slot, r.doc_id, r.size) for r in sharding.shard(docs, 4).collect())
    # 2010 bytes: the middle byte of the first giant is 504, just past the first cut at 502.5
    assert got == [(0, 0, None, 1), (0, 1, None, 3), (1, 0, 7, 1001), (2, 0, 7, 1001), (3, 0, 8, 1), (3, 1, 9, 3)]
    assert all(r.law == "bytes" and r.grown_shard is None for r in sharding.shard(docs, 4).collect())
    assert sharding.shard(docs.limit(0)).count() == 0


def test_slots_are_gapless_and_order_is_global(spark):
    rows = sharding.op2_sharding(spark, FOLDER).sort("doc_id").collect()
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    for shard in {r.shard for r in rows}:
        assert [r.slot for r in rows if r.shard == shard] == list(range(sum(r.shard == shard for r in rows)))


def test_targets_fill_up_by_weight(spark):
    """The level found by one running sum equals repeated resharing."""
    sizes = [("a", 100), ("b", 5), ("c", 70), ("d", 1), ("e", 400), ("f", 0), ("", 9)]
    frame = spark.createDataFrame([(0, n, s) for n, s in sizes] + [(1, "", 50)], "__null int, __name string, source_size long")
    got = {(r["__null"], r["__name"]): r.target for r in mixing.targets(frame, (3, 1, 2), 150, 2).collect()}
    order = sorted(got)
    weight = {key: (3, 1, 2)[k % 3] for k, key in enumerate(order)}
    size = {(0, n): s for n, s in sizes} | {(1, ""): 50}
    left, open_sources, want = 1.5 * sum(size.values()), set(order), {}
    while open_sources:
        level = left / sum(weight[k] for k in open_sources)
        full = {k for k in open_sources if level * weight[k] >= 2 * size[k]}
        if not full:
            want |= {k: level * weight[k] for k in open_sources}
            break
        want |= {k: 2.0 * size[k] for k in full}
        left -= sum(want[k] for k in full)
        open_sources -= full
    assert got == pytest.approx(want)


def test_mix_takes_words_near_targets_and_agrees_with_itself(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.copies(docs)
    assert got.filter("taken > 2 * size").count() == 0
    for r in got.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= r.most
    again = mixing.copies(docs.repartition(5))
    assert got.select("doc_id", "copies").exceptAll(again.select("doc_id", "copies")).count() == 0


def test_ranks_beyond_any_product_that_fits_a_long(spark):
    rng = random.Random(3)
    unit = mixing.UNIT
    rows = [(rng.randrange(1 << bits), rng.randrange(2 * unit + 1), rng.randrange(unit)) for bits in (1, 20, 31, 40, 55) for _ in range(60)]
    rows += [(b, rate, offset) for b in (0, 1 << 31, (1 << 40) - 1) for rate in (0, 1, unit - 1, unit, 2 * unit) for offset in (0, unit - 1)]
    table = spark.createDataFrame(rows, "b long, rate long, offset long")
    for row in table.withColumn("n", mixing.crossings(F.col("b"), F.col("rate"), F.col("offset"))).collect():
        start = row.b * row.rate + row.offset
        assert row.n == (start + row.rate) // unit - start // unit


def test_mix_keeps_columns_and_odd_rows(spark):
    rows = [(i % 7, "a b c", "s" if i % 3 else None) for i in range(60)] + [(None, None, "s"), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "doc_id as copies", "'x' as target")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    counts = mixing.copies(docs).agg(F.sum("copies")).first()[0]
    assert out.count() == counts > 60
    assert mixing.mix(docs.limit(0)).count() == 0


def test_policies_and_ablation(spark):
    failed = spark.createDataFrame([(0,), (0,), (1,), (3,), (4,), (5,), (None,)], "failed long")
    got = {r.rule: (r.n_failed, r.n_only, r.n_kept) for r in quality_rules.ablation(failed.filter("failed IS NOT NULL"), "v1").collect()}
    assert got == {"few_words": (3, 2, 3), "repeated_words": (1, 0, 3)}
    kept = failed.filter(quality_rules.passes(F.col("failed"), "v1")).count()
    assert kept == 3
    docs = spark.createDataFrame([(1, None), (2, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")], "doc_id long, text string")
    assert [r.doc_id for r in quality_rules.quality_filter(docs).collect()] == [2]
    assert quality_rules.ledger(docs.limit(0)).count() == 0
