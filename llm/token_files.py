"""Token-id files in Simple-8b coding.

A token file is a Parquet folder in ascending document order; a row holds one
document's ids as a run of blocks:

* the ids are cut into blocks of BLOCK ids; each block starts a new 64-bit word,
* a word's top four bits are a selector that says how many ids of which width
  fill the other 60 bits, lowest bits first; slots past a block's end are zero,
* an id that no width holds is an escape: selector 15, then the id itself as a
  whole 64-bit word,
* ``payload`` is magic, number of ids, number of blocks, the word offset of every
  block (unsigned 32-bit), then the words, all little-endian.

Block offsets let a reader decode any block on its own and all blocks at once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from findrisk.storage import staging_path
from llm import wordkernel
from llm.frames import read_table, require, shuffle_width, sql_identifier
from llm.registry import register

BLOCK = 128
MAGIC = 0x38425354
#: (ids per word, bits per id) of selectors 0 to 13, densest first.
LAYOUT = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
_COUNT = np.array([n for n, _ in LAYOUT] + [0, 1], np.int64)
_TOP = np.uint64(60)
_LOW = np.uint64((1 << 60) - 1)

VOCABULARY = "word_bpe_49k.json"
END_ID = 2


def _reach(bits: np.ndarray, size: int) -> np.ndarray:
    """Largest of ``size`` neighbouring entries from each position on; nothing past the end."""
    out, done = bits, 1
    while done < size:
        step = min(done, size - done)
        ahead = np.zeros_like(out)
        ahead[:, : BLOCK - step] = out[:, step:]
        out, done = np.maximum(out, ahead), done + step
    return out


def encode(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Payloads of documents whose ids stand one after another in ``ids``, ``counts[i]`` each."""
    ids, counts = np.asarray(ids, np.uint64), np.asarray(counts, np.int64)
    doc_blocks = -(-counts // BLOCK)
    first_block = np.concatenate(([0], np.cumsum(doc_blocks)))
    blocks = int(first_block[-1])
    owner = np.repeat(np.arange(len(counts)), doc_blocks)
    length = np.minimum(BLOCK, counts[owner] - (np.arange(blocks) - first_block[owner]) * BLOCK)
    matrix = np.zeros((blocks, BLOCK), np.uint64)
    matrix[np.arange(BLOCK) < length[:, None]] = ids
    bits = np.frexp(matrix.astype(np.float64))[1].astype(np.int8)
    selector = np.full(matrix.shape, ESCAPE, np.int8)
    for s in range(len(LAYOUT) - 1, -1, -1):
        size, width = LAYOUT[s]
        selector[_reach(bits, size) <= width] = s
    # all blocks advance together, one word per step
    open_blocks, place = np.arange(blocks), np.zeros(blocks, np.int64)
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(open_blocks):
        chosen = selector[open_blocks, place].astype(np.int64)
        made.append((open_blocks, place, chosen))
        place = place + _COUNT[chosen]
        more = place < length[open_blocks]
        open_blocks, place = open_blocks[more], place[more]
    if made:
        block, at, chosen = (np.concatenate(column) for column in zip(*made, strict=True))
        # runs that are in order already
        order = np.argsort(block * BLOCK + at, kind="stable")
        block, at, chosen = block[order], at[order], chosen[order]
    else:
        block = at = chosen = np.zeros(0, np.int64)
    spot = np.concatenate(([0], np.cumsum(1 + (chosen == ESCAPE))))
    words = np.zeros(int(spot[-1]), np.uint64)
    flat = np.concatenate((matrix.reshape(-1), np.zeros(64, np.uint64)))
    inside = np.concatenate((np.repeat(np.arange(blocks), BLOCK), np.full(64, -1)))
    for s, (size, width) in enumerate(LAYOUT):
        rows = np.flatnonzero(chosen == s)
        if len(rows):
            where = (block[rows] * BLOCK + at[rows])[:, None] + np.arange(size)
            values = np.where(inside[where] == block[rows][:, None], flat[where], np.uint64(0))
            shifted = values << (np.arange(size, dtype=np.uint64) * np.uint64(width))
            words[spot[rows]] = np.bitwise_or.reduce(shifted, axis=1) | (np.uint64(s) << _TOP)
    rows = np.flatnonzero(chosen == ESCAPE)
    words[spot[rows]] = np.uint64(ESCAPE) << _TOP
    words[spot[rows] + 1] = matrix[block[rows], at[rows]]
    block_start = np.concatenate((spot[np.searchsorted(block, np.arange(blocks))], spot[-1:]))
    packed = words.astype("<u8").tobytes()
    out = []
    for i, n in enumerate(counts):
        low, high = first_block[i], first_block[i + 1]
        begin, end = int(block_start[low]), int(block_start[high])
        head = np.empty(3 + high - low, "<u4")
        head[:3] = MAGIC, n, high - low
        head[3:] = block_start[low:high] - begin
        out.append(head.tobytes() + packed[8 * begin : 8 * end])
    return out


def decode(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all documents one after another, ids per document)."""
    counts = np.zeros(len(payloads), np.int64)
    doc_blocks = np.zeros(len(payloads), np.int64)
    starts, bodies, base = [], [], 0
    for i, payload in enumerate(payloads):
        magic, counts[i], doc_blocks[i] = np.frombuffer(payload, "<u4", 3)
        if magic != MAGIC:
            raise ValueError("not a token payload")
        body = payload[12 + 4 * int(doc_blocks[i]) :]
        starts.append(np.frombuffer(payload, "<u4", int(doc_blocks[i]), 12).astype(np.int64) + base)
        bodies.append(body)
        base += len(body) // 8
    ids = np.zeros(int(counts.sum()), np.uint64)
    if not base:
        return ids, counts
    words = np.frombuffer(b"".join(bodies), "<u8")
    first_word = np.concatenate(starts)
    first_block = np.concatenate(([0], np.cumsum(doc_blocks)))
    owner = np.repeat(np.arange(len(counts)), doc_blocks)
    within = (np.arange(len(owner)) - first_block[owner]) * BLOCK
    length = np.minimum(BLOCK, counts[owner] - within)
    target = np.concatenate(([0], np.cumsum(counts)))[owner] + within
    selector = (words >> _TOP).astype(np.int64)
    # in a run of words with the escape's selector, every second one is a raw id
    escape_like = selector == ESCAPE
    index = np.arange(len(words))
    run_start = np.maximum.accumulate(np.where(escape_like & ~np.concatenate(([False], escape_like[:-1])), index, -1))
    is_escape = escape_like & ((index - run_start) % 2 == 0)
    is_raw = np.concatenate(([False], is_escape[:-1]))
    nominal = np.where(is_raw, 0, _COUNT[selector])
    before = np.concatenate(([0], np.cumsum(nominal)[:-1]))
    block = np.searchsorted(first_word, index, side="right") - 1
    place = before - before[first_word][block]
    for s, (size, width) in enumerate(LAYOUT):
        rows = np.flatnonzero((selector == s) & ~is_raw)
        if len(rows):
            mask = np.uint64((1 << width) - 1)
            values = ((words[rows] & _LOW)[:, None] >> (np.arange(size, dtype=np.uint64) * np.uint64(width))) & mask
            slots = place[rows][:, None] + np.arange(size)
            real = slots < length[block[rows]][:, None]
            ids[(target[block[rows]][:, None] + slots)[real]] = values[real]
    rows = np.flatnonzero(is_escape)
    ids[target[block[rows]] + place[rows]] = words[rows + 1]
    return ids, counts


class WordEncoder:
    """Encodes texts word by word with a tokenizer that never joins across white space.

    ASCII letters count as lower case, as the tokenizer takes them, and a mark at a
    word's end as a word of its own. Words of a piece of text are told apart by hash,
    and only words not seen lately go through the tokenizer. Words are remembered in
    two generations of ``remember``: once the newer is full, the older one goes, but
    for the words met again since.
    """

    _ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9 ]+")

    def __init__(self, path: str, remember: int = 400_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.model = Tokenizer(self.full.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.full.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.closes[i] = token.endswith("</w>")
        self.alphabet = {byte: self.full.pre_tokenizer.pre_tokenize_str(chr(byte))[0][0] for byte in range(0x21, 0x7F)}
        # the other bytes of UTF-8 as the pre-tokenizer spells them, read off characters that hold them
        for code in (*range(0x80, 0x100), *range(0x100, 0x180)):
            if chr(code).isalpha():
                spelled = self.full.pre_tokenizer.pre_tokenize_str(chr(code))[0][0]
                self.alphabet |= dict(zip(chr(code).encode(), spelled, strict=True))
        self.remember = remember
        self.words: dict[int, bytes] = {}
        self.older: dict[int, bytes] = {}

    def _encode_parts(self, parts: list[str]) -> dict[str, bytes]:
        """Encode pieces that the pre-tokenizer would give, already in its byte alphabet."""
        if not parts:
            return {}
        ids = np.array(self.model.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(parts):
            raise ValueError("the vocabulary does not mark word ends")
        packed, out, low = ids.tobytes(), {}, 0
        for part, high in zip(parts, (4 * ends).tolist(), strict=True):
            out[part] = packed[low:high]
            low = high
        return out

    def _letters(self, word: bytes) -> str | None:
        """The one piece of a word of lower-case Latin letters that no normalization changes; None for other words."""
        text = word.decode()
        if text.isalpha() and max(text) < "\u0180" and text.lower() == text:
            return word.decode("latin-1").translate(self.alphabet)
        return None

    def _split(self, words: list[bytes]) -> list[list[str] | None]:
        """The pre-tokenizer's pieces of each word; None for words that only the whole tokenizer handles."""
        out: list[list[str] | None] = [None] * len(words)
        mixed = []
        for i, word in enumerate(words):
            if word.isalpha() and word.islower():
                out[i] = [word.decode()]
            elif not word.isascii() and (letters := self._letters(word)) is not None:
                out[i] = [letters]
            else:
                mixed.append(i)
        plain = [i for i in mixed if words[i].isascii() and b"<|" not in words[i]]
        text = b" ".join([words[i] for i in plain]).decode()
        if not text.isprintable():
            plain = [i for i in plain if words[i].decode().isprintable()]
            text = b" ".join([words[i] for i in plain]).decode()
        # pieces hold all characters but the blanks, so their lengths tell which word each is of
        pieces = self._ASCII.findall(text.lower())
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        lengths = np.cumsum(np.fromiter((len(words[i]) for i in plain), np.int64, len(plain)))
        low = 0
        for i, high in zip(plain, np.searchsorted(ends, lengths, side="right").tolist(), strict=True):
            out[i] = pieces[low:high]
            low = high
        other, texts = [], []
        for i in mixed:
            word = words[i]
            if not word.isascii() and b"<|" not in word:
                text = word.decode()
                if text.split() == [text]:  # no other white space than ASCII's
                    other.append(i)
                    texts.append(text)
                    out[i] = []
        if other:
            text = self.full.normalizer.normalize_str(" ".join(texts))
            gaps = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 0x20)
            if len(gaps) != len(other) - 1:
                raise ValueError("the tokenizer's normalizer moves word bounds")
            found = self.full.pre_tokenizer.pre_tokenize_str(text)
            places = np.searchsorted(gaps, [low for _, (low, _) in found])
            for (piece, _), k in zip(found, places.tolist(), strict=True):
                out[other[k]].append(piece)
        return out

    def _learn(self, codes: list[int], words: list[bytes]) -> None:
        split, known = self._split(words), self.words
        parts = self._encode_parts(list({piece for pieces in split if pieces for piece in pieces}))
        for code, word, pieces in zip(codes, words, split, strict=True):
            if pieces is None:
                known[code] = np.array(self.full.encode(word.decode(), add_special_tokens=False).ids, np.uint32).tobytes()
            elif len(pieces) == 1:
                known[code] = parts[pieces[0]]
            else:
                known[code] = b"".join([parts[piece] for piece in pieces])

    def encode(self, texts: list[bytes], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids per text), each text closed by ``end_id``."""
        if len(self.words) > self.remember:
            self.words, self.older = {}, self.words
        # a special token is one in its own spelling only
        special = any(b"<|" in text for text in texts)
        words = wordkernel.Words(texts, lower=not special, parted=True)
        unique, first, inverse = np.unique(words.code, return_index=True, return_inverse=True)
        codes, held, older = unique.tolist(), self.words, self.older
        new = []
        for k, code in enumerate(codes):
            if code not in held:
                if code in older:
                    held[code] = older[code]
                else:
                    new.append(k)
        if new:
            raw, start, end = words.bytes, words.start[first].tolist(), words.end[first].tolist()
            self._learn([codes[k] for k in new], [raw[start[k] : end[k]] for k in new])
        known = [self.words[code] for code in codes]
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        offsets = np.cumsum(lengths) - lengths
        table = np.frombuffer(b"".join(known), np.uint32)
        per_word = lengths[inverse]
        before = np.concatenate(([0], np.cumsum(per_word)))
        taken = table[np.repeat(offsets[inverse] - before[:-1], per_word) + np.arange(before[-1])]
        counts = np.diff(before[words.bounds])
        if end_id is None:
            return taken, counts
        out = np.full(len(taken) + len(texts), end_id, np.uint32)
        out[np.arange(len(taken)) + np.repeat(np.arange(len(texts)), counts)] = taken
        return out, counts + 1


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode whole texts and write a token file to ``path``, in ascending id order.

    ``vocabulary`` is the path of a tokenizer file that executors can read
    (default: the installed public one). Rows are dealt out by ranges of ids, so
    file order is id order; null ids come first, equal ids in input order. A null
    text counts as empty and holds only the end id (nothing if ``end_id`` is
    None). An empty table gives an empty file.
    """
    require(docs, id_col, text_col)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder, place = _encoder(vocabulary or public_tokenizers.path(VOCABULARY)), 0
        for batch in source:
            texts = [text or b"" for text in batch.column("text").cast(pa.binary()).to_pylist()]
            for low, high in wordkernel.pieces(texts):
                ids, counts = encoder.encode(texts[low:high], end_id)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low),
                        batch.column("range").slice(low, high - low),
                        pa.array(np.arange(place, place + high - low)),
                        pa.array(counts),
                        pa.array(encode(ids, counts), pa.binary()),
                    ],
                    ["doc_id", "range", "place", "n_tokens", "payload"],
                )
                place += high - low

    dealt = (
        docs.select(
            F.col(sql_identifier(id_col)).cast("long").alias("doc_id"),
            F.col(sql_identifier(text_col)).alias("text"),
            F.monotonically_increasing_id().alias("tie"),
        )
        .repartitionByRange(shuffle_width(docs.sparkSession), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", F.spark_partition_id().alias("range"), "text")
    )
    dealt.mapInArrow(batches, "doc_id bigint, range int, place bigint, n_tokens bigint, payload binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a token file: ``doc_id, range, place, ids``."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids, counts = decode(batch.column("payload").to_pylist())
            ends = np.concatenate(([0], np.cumsum(counts)))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "range", "place")], lists], ["doc_id", "range", "place", "ids"])

    return spark.read.parquet(path).mapInArrow(batches, "doc_id bigint, range int, place bigint, ids array<bigint>")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of a token file, all from the decoded ids.

    ``start`` counts the ids of all documents before this one in file order. Ranges
    are summed on their own; only their totals are summed in sequence.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            payloads = batch.column("payload").to_pylist()
            sums, sizes = [], []
            for low, high in wordkernel.pieces(payloads):
                ids, counts = decode(payloads[low:high])
                data, end = ids.astype("<u4").tobytes(), 0
                for n in counts.tolist():
                    sums.append(zlib.crc32(data[4 * end : 4 * (end + n)]))
                    sizes.append(n)
                    end += n
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "range", "place")], pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "range", "place", "n_tokens", "ids_crc32"],
            )

    rows = spark.read.parquet(path).mapInArrow(batches, "doc_id bigint, range int, place bigint, n_tokens bigint, ids_crc32 bigint")
    # the coded counts are enough for the offsets; decoding is not repeated for them
    totals = spark.read.parquet(path).groupBy("range").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(offsets, "range")
        .select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )


@register("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), path)
    return token_index(spark, path)
