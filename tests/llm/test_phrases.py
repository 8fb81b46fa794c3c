import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from llm import phrases as ph

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces_of(text):
    found = [re.findall(r"[^ \t]+", piece) for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER))]
    return [words for words in found if words]


def brute(rows, least=ph.LEAST, absorbed=ph.ABSORBED, most=ph.MOST):
    """The definition on (lang, text) rows."""
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for words in pieces_of(text):
            sizes[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for gram, a in f.items():
            if len(gram) == 1 or a < least:
                continue
            if len(gram) == 2 and any(100 * b >= absorbed * a for longer, b in f.items() if len(longer) == 3 and b >= least and gram in (longer[:2], longer[1:])):
                continue
            cuts = [(1_000_000 * a * a // (f[gram[:k]] * f[gram[k:]]), k) for k in range(1, len(gram))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(gram).encode(), f[gram[:k]], f[gram[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def found(docs, **settings_):
    table = ph.collocations(docs, **settings_)
    assert table.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(row) for row in table.collect())


WORDS = st.lists(st.sampled_from(["a", "B", "c", "é", ".", "\t", " ", "\n", "d,e", "", "日本"]), max_size=80).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(WORDS, max_size=5))
def test_chunks_hold_every_ngram_once(texts):
    expected, got = Counter(), Counter()
    for text in texts:
        for words in pieces_of(text):
            for size in (1, 2, 3):
                expected.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    owners, chunks = ph._chunks([text.encode() for text in texts])
    assert owners == sorted(owners)
    for chunk in chunks:
        tokens = chunk.decode().split(" ")
        assert len(tokens) > ph.OVERLAP
        for i in range(len(tokens) - ph.OVERLAP):
            for size in (1, 2, 3):
                if "\n" not in (gram := tuple(tokens[i : i + size])):
                    got[gram] += 1
    assert got == expected


def test_copies_give_equal_chunks():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in rng.integers(0, 500, 4000)]
    passage = " ".join(words[:600])
    texts = [" ".join(words[1000 + 50 * k : 1040 + 50 * k]) + " " + passage + " " + words[-k - 1] for k in range(20)]
    _, chunks = ph._chunks([text.encode() for text in texts])
    shared = sum(n for n in Counter(chunks).values() if n >= 20)
    assert shared > 0.85 * len(chunks) * 600 / 641


def rows_of(seed, n, vocabulary, longest=60):
    rng = np.random.default_rng(seed)
    marks = ["", "", "", "", ".", ",", "\n", "\t", " "]
    weights = 1 / np.arange(1, vocabulary + 1)
    weights /= weights.sum()
    return [
        (["en", "de", None][int(rng.integers(3))], "".join(f"{['W', 'w'][int(rng.integers(2))]}{k}{marks[int(rng.integers(9))]} " for k in rng.choice(vocabulary, rng.integers(0, longest), p=weights)))
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed, vocabulary", [(1, 6), (2, 25), (3, 90)])
def test_equal_to_brute_force(spark, seed, vocabulary):
    rows = rows_of(seed, 250, vocabulary)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    expected = brute(rows)
    assert expected and found(docs) == expected


def test_ties_limits_and_small_bitmaps(spark, monkeypatch):
    rows = rows_of(4, 200, 12)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert found(docs, least=4, absorbed=80, most=7) == brute(rows, 4, 80, 7)
    assert found(docs, least=4, most=None) == brute(rows, 4, most=None)
    # bits that many pairs share let triples through and change nothing
    monkeypatch.setattr(ph, "pair_bitmap", lambda pairs, make=ph.pair_bitmap: make(pairs, 64))
    monkeypatch.setattr(ph, "ROUND_BYTES", 200)
    assert found(docs) == brute(rows)


def test_exact_beyond_64_bits(spark):
    table = spark.range(1).select(F.lit(999_999_999_999_989).alias("a"), F.lit(999_999_999_999_990).alias("l"), F.lit(999_999_999_999_991).alias("r"))
    a, left, right = 999_999_999_999_989, 999_999_999_999_990, 999_999_999_999_991
    assert table.select(ph._score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 1_000_000 * a * a // (left * right)


def test_nulls_empty_long_texts_repeats_and_clashing_names(spark):
    rows = [(k, lang, text, "x", 1, 2) for k, (lang, text) in enumerate(rows_of(6, 60, 8))]
    rows += [(None, None, None, None, None, None), (5, "en", "", "y", 0, 0), (6, "en", " .,\n", None, None, None), (7, "fr", "one", None, None, None)]
    rows += [(8, "en", "a b c " * 20_000, None, 1, None)] + [(9, "de", "u v. u v w", "same", 1, 1)] * 12 + [(10, "de", "aaa " * 30_000, "z", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, chunk string, times int, f int")
    assert found(docs) == brute([row[1:3] for row in rows])


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "lang string, text string")) == []


def test_sql_agrees_with_brute_force():
    rows = rows_of(7, 200, 15) + [(None, None), ("en", "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.sql(ph.SQL).fetchall()) == brute(rows)
