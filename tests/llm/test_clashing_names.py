"""Every operator with the caller's columns named like its own working columns."""

import pytest
from pyspark.sql import functions as F

from llm import decontamination, license_scan, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, sharding

EXTRA = ["__id", "__hash", "__copy", "__words", "__text_hash", "__ledger", "__Id2", "__found", "__bad", "__base", "own__id"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (i, text, "en", f"s{i % 2}", *[f"{name}{i}" for name in EXTRA])
        for i, text in enumerate(
            ["one two three four five six seven eight nine ten eleven twelve\n" * 2, "released under the mit license by all of us here today and then some more words", None, "a b c d e f g h i j k l m"] * 2
        )
    ]
    # one name differs from a working column in case only
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", "source string", *[f"`{name}` string" for name in EXTRA]]))


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id long, text string")


OPERATORS = {
    "rules": lambda docs, benchmark: quality_rules.quality_filter(docs),
    "near": lambda docs, benchmark: near_dedup.near_dedup(docs),
    "lines": lambda docs, benchmark: line_dedup.dedup_lines(docs),
    "clean": lambda docs, benchmark: decontamination.decontaminate(docs, benchmark),
    "mix": lambda docs, benchmark: mixing.mix(docs),
    "shard": lambda docs, benchmark: sharding.shard(docs),
    "licenses": lambda docs, benchmark: license_scan.scan(docs),
}


# shards are reported without the caller's other columns
@pytest.mark.parametrize("name", [name for name in OPERATORS if name != "shard"])
def test_own_columns_come_back_unchanged(docs, benchmark, name):
    out = OPERATORS[name](docs, benchmark)
    assert set(docs.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    rows = out.select("doc_id", *[F.col(f"`{extra}`") for extra in EXTRA]).collect()
    assert rows and all(row[extra] == f"{extra}{row['doc_id']}" for row in rows for extra in EXTRA)


@pytest.mark.parametrize("name", OPERATORS)
def test_results_are_those_without_the_columns(docs, benchmark, name):
    plain = docs.drop(*EXTRA)
    shown = [column for column in OPERATORS[name](plain, benchmark).columns]
    one = OPERATORS[name](plain, benchmark).select(*shown).collect()
    other = OPERATORS[name](docs, benchmark).select(*shown).collect()
    assert sorted(map(str, one)) == sorted(map(str, other))


def test_columns_read_may_have_such_names(docs, benchmark):
    named = docs.drop(*EXTRA).withColumnsRenamed({"doc_id": "__id", "text": "__words"})
    kept = near_dedup.near_dedup(named, id_col="__id", text_col="__words")
    assert sorted(row["__id"] for row in kept.collect()) == [0, 1, 2, 3, 6]
    assert decontamination.decontaminate(named, benchmark, id_col="__id", text_col="__words").count() == 6
    found = license_scan.scan(named, text_col="__words", into="__id")
    assert found.columns.count("__id") == 1 and found.schema["__id"].dataType.typeName() == "struct"


def test_classifier_ignores_them(spark, docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (3, 1), (4, 1), (5, 0)], "doc_id long, quality int")
    assert quality_classifier.classify(docs, labels).count() == quality_classifier.classify(docs.drop(*EXTRA), labels).count()
