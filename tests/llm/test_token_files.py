import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from llm import token_files as files

DOCS = st.lists(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**64 - 1), st.just(15 << 60)), max_size=300), max_size=6)


@settings(max_examples=150, deadline=None)
@given(DOCS)
def test_round_trip(docs):
    flat = np.array([i for doc in docs for i in doc], np.uint64)
    counts = np.array([len(doc) for doc in docs], np.int64)
    ids, sizes = files.decode(files.encode(flat, counts))
    assert ids.tolist() == flat.tolist()
    assert sizes.tolist() == counts.tolist()


def test_small_ids_are_packed():
    (payload,) = files.encode(np.arange(30_000) % 1000, [30_000])
    assert len(payload) < 30_000 * 1.5


def test_foreign_bytes_are_refused():
    with pytest.raises(ValueError):
        files.decode([b"\0" * 12])


TEXTS = [
    "Hello, World! don't we'll 12 3.5 naïve Straße İstanbul ΟΔΟΣ",
    "a<|endoftext|>b <|startoftext|> x",
    "é ́x   tab\tnew\nline em \x1c\x85 z\x0bq",
    "",
    " \n ",
    "日本語 テキスト 😀😀 ﬁ ǅ",
    "''s 're''d I'M THEY'LL #$%&& --x__y",
    None,
]


def test_words_encode_as_the_whole_text():
    path = public_tokenizers.path(files.VOCABULARY)
    whole, encoder = Tokenizer.from_file(path), files.WordEncoder(path)
    for _ in range(2):  # the second time from memory
        ids, counts = encoder.encode([(t or "").encode() for t in TEXTS], None)
        at = 0
        for text, n in zip(TEXTS, counts):
            assert ids[at : at + n].tolist() == whole.encode(text or "", add_special_tokens=False).ids, text
            at += n


def test_query_against_the_library(spark, tmp_path):
    rows = [(i, TEXTS[i % len(TEXTS)], "x") for i in range(40, 0, -1)] + [(None, "first of all", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `n.x` string")
    files.write_tokens(docs, f"{tmp_path}/t")
    got = {r.doc_id: r for r in files.token_index(spark, f"{tmp_path}/t").collect()}
    whole = Tokenizer.from_file(public_tokenizers.path(files.VOCABULARY))
    start = 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        row = got[doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    back = {r.doc_id: r.ids for r in files.read_tokens(spark, f"{tmp_path}/t").collect()}
    assert back[None] == [*whole.encode("first of all", add_special_tokens=False).ids, 2]


def test_whole_table_against_the_library(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in files.op10_token_files(spark, folder).collect()}
    whole = Tokenizer.from_file(public_tokenizers.path(files.VOCABULARY))
    start = 0
    for row in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect():
        ids = [*whole.encode(row.text or "", add_special_tokens=False).ids, 2]
        assert (got[row.doc_id].start, got[row.doc_id].ids_crc32) == (start, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_empty_table(spark, tmp_path):
    files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/e")
    assert files.token_index(spark, f"{tmp_path}/e").count() == 0


def test_any_mixture_of_signs_encodes_as_the_whole_text():
    """Few words are remembered, so that both generations turn over."""
    path = public_tokenizers.path(files.VOCABULARY)
    whole, encoder, rng = Tokenizer.from_file(path), files.WordEncoder(path, remember=50), random.Random(1)
    parts = ["a", "Word", "é", "É", "ß", "ŉ", "ﬁ", "ſ", "'s", "'", "don't", ".", ",", "!", "...", "9", "12,", "<|", "|>", "<|endoftext|>", "<|EndOfText|>"]
    parts += [" ", "\n", " ", "日", "́", "ª", "º", "ĳ", "İ", "ı", "Ω", "ω", "x.", "é.", "-", ";"]
    for _ in range(300):
        texts = ["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(6)]
        ids, counts = encoder.encode([text.encode() for text in texts], None)
        at = 0
        for text, n in zip(texts, counts):
            assert ids[at : at + n].tolist() == whole.encode(text, add_special_tokens=False).ids, text
            at += n
