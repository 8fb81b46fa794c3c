"""Alignment of two tokenizers' tokens by the bytes they cover.

A is a byte-level BPE of the tokenizers library, B a sentencepiece BPE with byte
fallback; both see a blank and the text. A's character offsets and B's byte spans are
coarse cuts: they name no place inside a character. Tokens that end inside one, and
B's single-byte tokens, get their place from the bytes they decode to.

A's pre-tokenizer cuts before a single blank between two words, and B has no piece
with a blank behind another character, so no token reaches over it. Texts are cut
there, and a chunk that was met lately is not tokenized again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from llm import wordkernel
from llm.frames import read_table, require, sql_identifier, stage
from llm.registry import register

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Chunks remembered per generation; there are two, the older one is dropped when the newer is full.
REMEMBER = 250_000
#: Chunks that go through the tokenizers as one text.
JOINED = 2000

#: White space of any kind: a superset of what either tokenizer takes for it.
_NARROW = np.zeros(256, bool)
_NARROW[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_WIDE_POINTS = (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_WIDE = re.compile("|".join(map(chr, _WIDE_POINTS)).encode())
_BLOCK = "\u2581"

#: What is known of a chunk: tokens of A, tokens of B, linked pairs, groups as text; None if the bytes differ.
Entry = tuple[int, int, bytes, bytes]


def _byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's characters: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [byte for byte in range(256) if byte not in plain]
    return {chr(byte): byte for byte in plain} | {chr(256 + k): byte for k, byte in enumerate(other)}


class Aligner:
    """Aligns whole texts; remembers chunks."""

    def __init__(self, path_a: str, path_b: str, remember: int = REMEMBER):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[char] for char in token)
        n = self.b.get_piece_size()
        self.b_byte = np.array([self.b.is_byte(i) for i in range(n)])
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace(_BLOCK, " ").encode() for p, byte in zip(pieces, self.b_byte.tolist(), strict=True)]
        parted = [piece for piece, _ in self.a.pre_tokenizer.pre_tokenize_str(" x y")]
        if len(parted) != 2 or any(b" " in piece.lstrip(b" ") for piece in self.b_bytes):
            raise ValueError("a token may reach over the blank between two words")
        self.a_length = np.fromiter(map(len, self.a_bytes), np.int64)
        self.b_length = np.fromiter(map(len, self.b_bytes), np.int64)
        self.size_b = n
        self.kind = pair_kind(len(self.a_bytes), n)
        self.remember = remember
        self.new: dict[int, Entry | None] = {}
        self.old: dict[int, Entry | None] = {}

    def _ends(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(A's ids, byte ends of its tokens, B's ids, their byte ends) of a text that starts with a blank; None if bytes differ."""
        string = text.decode()
        coded = self.a.encode(string, add_special_tokens=False)
        a_ids = np.array(coded.ids, np.int64)
        pieces = [(piece.id, piece.end) for piece in self.b.encode(string[1:], return_type="proto").pieces]
        b_ids, b_end = np.array(pieces, np.int64).reshape(-1, 2).T
        if b"".join([self.a_bytes[i] for i in a_ids.tolist()]) != text or b"".join([self.b_bytes[i] for i in b_ids.tolist()]) != text:
            return None
        # coarse: the byte after a token's last character; spans of B don't count the blank before the text
        char = np.append(np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80), len(text))
        offsets = np.array(coded.offsets, np.int64).reshape(-1, 2)
        a_end, b_end = char[offsets[:, 1]], b_end + 1
        # refined: where the next token starts inside the same character, and for single bytes
        a_fine, b_fine = np.cumsum(self.a_length[a_ids]), np.cumsum(self.b_length[b_ids])
        inside = np.append(offsets[1:, 0] < offsets[:-1, 1], False)
        a_end = np.where(inside, a_fine, a_end)
        b_end = np.where(self.b_byte[b_ids], b_fine, b_end)
        if not (np.array_equal(a_end, a_fine) and np.array_equal(b_end, b_fine)):
            raise ValueError("a tokenizer's offsets contradict the bytes of its tokens")
        return a_ids, a_end, b_ids, b_end

    def _entries(self, chunks: list[bytes]) -> list[Entry | None]:
        """Entries of chunks none of which ends in white space, unless it is the only one."""
        found = self._ends(b"".join(chunks))
        if found is None:
            return [None] if len(chunks) == 1 else [self._entries([chunk])[0] for chunk in chunks]
        a_ids, a_end, b_ids, b_end = found
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        a_at, b_at = np.searchsorted(a_end, cuts), np.searchsorted(b_end, cuts)
        pairs = (a_ids[a_at] * self.size_b + b_ids[b_at]).astype(self.kind)
        a_text, b_text = [str(i) for i in a_ids.tolist()], [str(i) for i in b_ids.tolist()]
        a_high, b_high = (a_at + 1).tolist(), (b_at + 1).tolist()
        a_low, b_low = [0, *a_high[:-1]], [0, *b_high[:-1]]
        groups = [
            f"{a_text[p]}|{b_text[r]};" if q - p == 1 == s - r else f"{','.join(a_text[p:q])}|{','.join(b_text[r:s])};"
            for p, q, r, s in zip(a_low, a_high, b_low, b_high, strict=True)
        ]
        bounds = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        last = np.searchsorted(cuts, bounds)
        out, low = [], 0
        for high in (last + 1).tolist():
            tokens = a_high[high - 1] - a_low[low], b_high[high - 1] - b_low[low]
            out.append((*tokens, pairs[low:high].tobytes(), "".join(groups[low:high]).encode()))
            low = high
        return out

    def _learn(self, codes: list[int], chunks: list[bytes]) -> None:
        # white space at the end would meet the next chunk's blank
        closed = [k for k, chunk in enumerate(chunks) if _NARROW[chunk[-1]] or chunk[-1] >= 0x80 and _WIDE.search(chunk[-3:])]
        alone = set(closed)
        joined = [k for k in range(len(chunks)) if k not in alone]
        for runs in ([closed[i : i + 1] for i in range(len(closed))], [joined[i : i + JOINED] for i in range(0, len(joined), JOINED)]):
            for run in runs:
                for k, entry in zip(run, self._entries([chunks[k] for k in run]), strict=True):
                    self.new[codes[k]] = entry

    def align(self, texts: list[bytes]) -> list[tuple[int, int, bytes, bytes] | None]:
        """Per text: tokens of A, tokens of B, linked pairs, groups; None for empty texts and where bytes differ."""
        if len(self.new) > self.remember:
            self.old, self.new = self.new, {}
        data = b"".join([b" " + text for text in texts]) + b" "
        raw = np.frombuffer(data, np.uint8)
        space = _NARROW[raw]
        for match in _WIDE.finditer(data):
            space[match.start() : match.end()] = True
        begins = np.cumsum([0, *[len(text) + 1 for text in texts]])
        cut = (raw == 0x20) & ~np.append(space[1:], True) & ~np.concatenate(([True], space[:-1]))
        cut[begins] = True
        places = np.flatnonzero(cut)
        start, end = places[:-1], places[1:]
        code = wordkernel.span_codes(data, start, end)
        unique, first, inverse = np.unique(code, return_index=True, return_inverse=True)
        codes = unique.tolist()
        for k in codes:
            if k not in self.new and k in self.old:
                self.new[k] = self.old[k]
        fresh = [k for k, known in enumerate(codes) if known not in self.new]
        low, high = start[first].tolist(), end[first].tolist()
        self._learn([codes[k] for k in fresh], [data[low[k] : high[k]] for k in fresh])
        entries = [self.new[k] for k in codes]
        bounds = np.searchsorted(start, begins)
        out = []
        for i, text in enumerate(texts):
            parts = [entries[k] for k in inverse[bounds[i] : bounds[i + 1]].tolist()]
            if not text or None in parts:
                out.append(None)
            else:
                n_a, n_b, pairs, groups = zip(*parts, strict=True)
                out.append((sum(n_a), sum(n_b), b"".join(pairs), b"".join(groups)[:-1]))
        return out


def pair_kind(size_a: int, size_b: int) -> str:
    """Smallest unsigned type for a pair of ids, ``a * size_b + b``."""
    return "<u4" if size_a * size_b <= 1 << 32 else "<u8"


@lru_cache(maxsize=2)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _local(path_a: str | None, path_b: str | None) -> Aligner:
    import public_tokenizers

    return _aligner(path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(VOCABULARY_B))


def align(
    docs: DataFrame, vocabulary_a: str | None = None, vocabulary_b: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", groups: bool = False,
) -> DataFrame:
    """Align whole texts: ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, batch, links`` per row of ``docs``.

    ``links`` holds the linked pairs in order, packed (``pair_kind``); ``batch``
    numbers pieces of about two megabytes of text; with ``groups`` a column of that
    name holds the groups as ``a1,a2|b1;a3|b2``. Vocabularies are paths that
    executors can read (default: the installed public ones).

    Null and empty texts, and texts whose tokens of either side decode to other
    bytes than a blank and the text (those with U+2581), have zeros and empty texts.
    A long text is a batch of its own; repeated rows stay rows; only the two named
    columns are read; an empty table gives no rows.
    """
    require(docs, id_col, text_col)
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, batch bigint, links binary"
    schema += ", groups string" if groups else ""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _local(vocabulary_a, vocabulary_b)
        width, number = np.dtype(aligner.kind).itemsize, TaskContext.get().partitionId() << 32
        for batch in source:
            texts = [text or b"" for text in batch.column("text").cast(pa.binary()).to_pylist()]
            for low, high in wordkernel.pieces(texts):
                rows = aligner.align(texts[low:high])
                links = [row[2] if row else b"" for row in rows]
                n_links = [len(pairs) // width for pairs in links]
                columns = {
                    "doc_id": batch.column("doc_id").slice(low, high - low),
                    "n_a": pa.array([row[0] if row else 0 for row in rows], pa.int64()),
                    "n_b": pa.array([row[1] if row else 0 for row in rows], pa.int64()),
                    "n_groups": pa.array([row[3].count(b";") + 1 if row else 0 for row in rows], pa.int64()),
                    "n_links": pa.array(n_links, pa.int64()),
                    "groups_sha256": pa.array([hashlib.sha256(row[3]).hexdigest() if row else "" for row in rows], pa.string()),
                    "batch": pa.array(np.full(high - low, number, np.int64)),
                    "links": pa.array(links, pa.binary()),
                }
                if groups:
                    columns["groups"] = pa.array([row[3].decode() if row else "" for row in rows], pa.string())
                yield pa.RecordBatch.from_pydict(columns)
                number += 1

    rows = docs.select(F.col(sql_identifier(id_col)).cast("long").alias("doc_id"), F.col(sql_identifier(text_col)).alias("text"))
    return rows.mapInArrow(batches, schema)


def _batch_pairs(aligned: DataFrame, kind: str) -> DataFrame:
    """``batch, pair, n``: distinct pairs of every batch with their links."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            numbers = batch.column("batch").to_numpy()
            links = batch.column("links").to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for low, high in zip(edges, edges[1:]):
                pairs, n = np.unique(np.frombuffer(b"".join(links[low:high]), kind), return_counts=True)
                if len(pairs):
                    yield pa.RecordBatch.from_pydict({"batch": pa.array(np.full(len(pairs), numbers[low])), "pair": pa.array(pairs.astype(np.int64)), "n": pa.array(n)})

    return aligned.select("batch", "links").mapInArrow(count, "batch bigint, pair bigint, n bigint")


def _count_pairs(rows: DataFrame, size_b: int) -> DataFrame:
    totals = rows.groupBy("pair").agg(F.sum("n").alias("count"))
    # a row per id of B at most
    best = totals.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("count").alias("most"))
    return (
        totals.withColumn("b", F.col("pair") % size_b)
        .join(F.broadcast(best), "b")
        .select("pair", F.floor((F.col("pair") - F.col("b")) / size_b).alias("a"), "b", "count", (F.col("count") == F.col("most")).alias("best"))
    )


def token_map(aligned: DataFrame, vocabulary_a: str | None = None, vocabulary_b: str | None = None) -> DataFrame:
    """``a, b, count, best`` over the whole corpus: links of every pair of ids, and whether no id of A has more with that id of B."""
    aligner = _local(vocabulary_a, vocabulary_b)
    return _count_pairs(_batch_pairs(aligned, aligner.kind), aligner.size_b).drop("pair")


def link_support(aligned: DataFrame, vocabulary_a: str | None = None, vocabulary_b: str | None = None) -> DataFrame:
    """Add ``n_best`` and ``count_sum`` to aligned documents (``align`` without groups).

    Each batch sends its distinct pairs once and gets their corpus counts back; a
    batch's documents and pairs meet in one group, whose size is that of a batch.
    A common pair has one row per batch at most.
    """
    aligner = _local(vocabulary_a, vocabulary_b)
    kind = aligner.kind
    staged = stage(aligned, "aligned")
    pairs = stage(_batch_pairs(staged, kind), "batch-pairs")
    counted = stage(_count_pairs(pairs, aligner.size_b).select("pair", "count", "best"), "pair-counts")
    known = pairs.select("batch", "pair").join(counted, "pair")

    def support(documents: pa.Table, known: pa.Table) -> pa.Table:
        pair = known.column("pair").to_numpy()
        order = np.argsort(pair)
        links = [value.as_buffer() for value in documents.column("links").combine_chunks()] if documents.num_rows else []
        flat = np.frombuffer(b"".join(links), kind).astype(np.int64)
        at = order[np.searchsorted(pair, flat, sorter=order)] if len(pair) else np.zeros(0, np.int64)
        ends = np.cumsum(documents.column("n_links").to_numpy())
        out = documents.drop_columns(["links"])
        for name, values in (("n_best", known.column("best").to_numpy().astype(np.int64)[at]), ("count_sum", known.column("count").to_numpy()[at])):
            sums = np.concatenate(([0], np.cumsum(values)))
            out = out.append_column(name, pa.array(np.diff(sums[ends], prepend=0).astype(np.int64)))
        return out.drop_columns(["batch"])

    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    return staged.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(support, schema)


@register("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link_support(align(read_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
