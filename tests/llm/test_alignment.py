import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from llm import alignment as al

PATH_A, PATH_B = public_tokenizers.path(al.VOCABULARY_A), public_tokenizers.path(al.VOCABULARY_B)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATH_B)


def by_library(libraries, text):
    """(A's ids, B's ids, groups, links) of a whole text, token by token; None without tokens."""
    if not text:
        return None
    a, b = libraries
    alphabet = al._byte_alphabet()
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in b_ids]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return None
    a_ends, b_ends = np.cumsum([len(t) for t in a_bytes]).tolist(), np.cumsum([len(t) for t in b_bytes]).tolist()
    links = [(x, y) for x, e in zip(a_ids, a_ends) for y, f in zip(b_ids, b_ends) if e == f] if len(text) < 3000 else None
    groups, p, r = [], 0, 0
    both = set(a_ends) & set(b_ends)
    if links is None:
        where = dict(zip(b_ends, b_ids))
        links = [(x, where[e]) for x, e in zip(a_ids, a_ends) if e in both]
    for cut in sorted(both):
        q, s = a_ends.index(cut, p) + 1, b_ends.index(cut, r) + 1
        groups.append(",".join(map(str, a_ids[p:q])) + "|" + ",".join(map(str, b_ids[r:s])))
        p, r = q, s
    return a_ids, b_ids, groups, links


def expected(libraries, texts):
    found = [by_library(libraries, text) for text in texts]
    counts = Counter(link for row in found if row for link in row[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for row in found:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            a_ids, b_ids, groups, links = row
            best = sum(counts[link] == most[link[1]] for link in links)
            out.append((len(a_ids), len(b_ids), len(groups), len(links), best, sum(counts[link] for link in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, counts, most


TEXTS = [
    "Hello, World! don't we'll 12 3.5 naïve Straße İstanbul",
    "a<|endoftext|>b </s> <s> <unk> <0x41> [UNK]",
    "日本語 テキスト 😀😀 ﬁ ǅ 龘 龘x \U0010ffff",
    " leading", "trailing ", "  two  blanks   three ", "\n", "tab\tnew\nline\r\n x \n\n y", " ", "   ",
    "nbsp x   y　z  w  v ᠎ u​ t \x1c s\x85 r \x00 q",
    "block \u2581 here", "plain again", "e\u0301 combined  \u00e9",
    "''s 're ''d I'M THEY'LL #$%&& --x__y", "x" * 300, "1234567890 " * 5, None, "",
    "word " * 3000 + "é龘 " * 500,
]


def rows_of(table):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(row[name] for name in names) for row in table.collect()), key=lambda row: (row[0] is not None, row))


def test_query_against_the_libraries(spark, libraries):
    texts = TEXTS + TEXTS[:4]
    rows = [(i if i else None, text, "x", 1, "l") for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, batch string, pair int, links string").repartition(3)
    values, _, _ = expected(libraries, texts)
    assert any(value[0] == 0 for value in values[:-4]) and rows_of(al.link_support(al.align(docs))) == [(i if i else None, *value) for i, value in enumerate(values)]


def test_given_documents_against_the_libraries(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    local = docs.orderBy("doc_id").collect()
    values, counts, most = expected(libraries, [row["text"] for row in local])
    aligned = al.align(docs.repartition(4), groups=True)
    assert rows_of(al.link_support(aligned.drop("groups"))) == [(row["doc_id"], *value) for row, value in zip(local, values)]
    table = {(r["a"], r["b"]): (r["count"], r["best"]) for r in al.token_map(aligned).collect()}
    assert table == {link: (n, n == most[link[1]]) for link, n in counts.items()}
    for row in aligned.filter("groups_sha256 != ''").collect():
        assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"]


def test_chunks_join_up_in_any_order(libraries):
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "a", "the", "'s", "é", "龘", "\U0001f600", " ", "　", " ", "9", "!", "--", "​", "<s>", "\x1d", "́"]
    aligner = al.Aligner(PATH_A, PATH_B, remember=40)
    for _ in range(60):
        texts = ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(12)]
        for text, row in zip(texts, aligner.align([text.encode() for text in texts])):
            found = by_library(libraries, text)
            if found is None:
                assert row is None, repr(text)
            else:
                assert row[:2] == (len(found[0]), len(found[1])) and row[3].decode() == ";".join(found[2]), repr(text)
                assert np.frombuffer(row[2], aligner.kind).tolist() == [x * aligner.size_b + y for x, y in found[3]]


def test_wide_vocabularies_get_wide_pairs():
    assert al.pair_kind(50_257, 32_000) == "<u4" and al.pair_kind(200_000, 100_000) == "<u8"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert al.link_support(al.align(docs)).collect() == [] and al.token_map(al.align(docs)).collect() == []
