"""Phrase collocations by prefix-free parsing.

* **Parse.** A text is a stream of words with a SEPARATOR where a piece ends, closed
  by two more of them. A window of two tokens whose hash is divisible by SPARSITY is a
  trigger; chunks run from one trigger to the next and share its two tokens. Where
  chunks are cut depends on their content only, so copied passages give equal chunks.
* **Dictionary.** Distinct chunks per language with the number of times they occur in
  the parse. N-grams of up to three words are counted inside distinct chunks only and
  weighted with that number; a chunk owns the n-grams that start before its last two
  tokens, so each place counts once.
* **Pruning.** A phrase of three words can only be frequent if both its halves are.
  Frequent pairs set bits in a bitmap of fixed size; triples whose halves miss it are
  never shuffled. A bit set by another pair lets a triple through, which costs a row
  and changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from llm import wordkernel
from llm.frames import read_table, require, sql_identifier, stage
from llm.registry import register

#: A trigger is met every so many tokens on average.
SPARSITY = 16
#: Tokens that neighbouring chunks share: the longest phrase less one.
OVERLAP = 2
LEAST = 10
#: A phrase goes if a longer one around it is at least this many percent as frequent.
ABSORBED = 50
MOST = 2000
NO_LANGUAGE = "und"
#: Bits of the bitmap of frequent pairs: 8 MB, whatever the size of the corpus.
BITMAP_BITS = 1 << 26
#: Bytes of dictionary text whose n-grams are added up before they leave a task.
ROUND_BYTES = 1 << 24
#: Rows whose texts are put together at once.
ROW_BLOCK = 1 << 17
#: Parts that a language's phrases are ranked in before the parts are ranked together.
RANKING_PARTS = 16

SEPARATOR = b"\n"
_END = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(SEPARATOR[0] if byte in _END else 0x20 if byte == 0x09 else low for byte, low in enumerate(wordkernel.LOWER.tolist()))
_SEPARATORS = re.compile(rb" *\n[ \n]*")
_BLANKS = re.compile(rb" {2,}")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Tokens:
    """Words and separators of some texts, separated by single blanks.

    ``data`` holds the tokens of all texts; token ``i`` is ``start[i]:end[i]``.
    """

    def __init__(self, data: bytes):
        # tokens are parted by exactly one blank
        raw = np.frombuffer(data, np.uint8)
        blanks = np.flatnonzero(raw == 0x20)
        self.data = data
        self.start = np.concatenate(([0], blanks + 1)) if len(raw) else np.zeros(0, np.int64)
        self.end = np.append(blanks, len(raw)) if len(raw) else np.zeros(0, np.int64)
        self.code = wordkernel.span_codes(data, self.start, self.end) if len(raw) else np.zeros(0, np.uint64)
        self.word = raw[self.start] != SEPARATOR[0] if len(raw) else np.zeros(0, bool)


def stream(text: bytes) -> bytes:
    """The lower-cased token stream of one text; empty if it has no word."""
    tokens = _BLANKS.sub(b" ", _SEPARATORS.sub(b" \n ", text.translate(_PLAIN))).strip(b" \n")
    return tokens + b" \n \n" if tokens else b""


def _chunks(texts: list[bytes]) -> tuple[list[int], list[bytes]]:
    """(text, chunk) of every chunk of the parse of ``texts``."""
    streams = [stream(text) for text in texts]
    owner = [i for i, s in enumerate(streams) if s]
    if not owner:
        return [], []
    tokens = Tokens(b" ".join([streams[i] for i in owner]))
    n = np.fromiter((streams[i].count(b" ") + 1 for i in owner), np.int64, len(owner))
    last = np.cumsum(n) - 1
    first = last - n + 1
    pair = wordkernel.mix(wordkernel.mix(tokens.code[:-1] + _STEP) ^ tokens.code[1:])
    trigger = np.append(pair % np.uint64(SPARSITY) == 0, False)
    # a text's first and last window of two tokens are cuts whatever they hold, and none lies over its end
    trigger[last] = False
    trigger[first] = True
    trigger[last - 1] = True
    cuts = np.flatnonzero(trigger)
    # from each cut of a text to the next one of the same text
    text_of = np.searchsorted(last, cuts)
    inner = np.flatnonzero(text_of[1:] == text_of[:-1])
    low, high = tokens.start[cuts[inner]].tolist(), tokens.end[cuts[inner + 1] + 1].tolist()
    data = tokens.data
    return [owner[k] for k in text_of[inner].tolist()], [data[a:b] for a, b in zip(low, high, strict=True)]


def parse(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The dictionary ``lang, chunk, times`` of the parse of whole texts.

    A null language is ``und``, a null text empty; texts without words have no
    chunks. Chunks of a text are added up in the task, then by Spark before and
    after the shuffle, so equal documents send a chunk once per task.
    """
    require(docs, lang_col, text_col)

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = [text or b"" for text in batch.column("text").cast(pa.binary()).to_pylist()]
            langs = batch.column("lang").to_pylist()
            for low, high in wordkernel.pieces(texts):
                owners, chunks = _chunks(texts[low:high])
                times: dict[tuple[str, bytes], int] = {}
                for i, chunk in zip(owners, chunks, strict=True):
                    key = (langs[low + i], chunk)
                    times[key] = times.get(key, 0) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang for lang, _ in times], pa.string()),
                        pa.array([chunk for _, chunk in times], pa.binary()).cast(pa.string()),
                        pa.array(list(times.values()), pa.int64()),
                    ],
                    ["lang", "chunk", "times"],
                )

    rows = docs.select(F.coalesce(F.col(sql_identifier(lang_col)), F.lit(NO_LANGUAGE)).alias("lang"), F.col(sql_identifier(text_col)).alias("text"))
    return rows.mapInArrow(cut, "lang string, chunk string, times bigint").groupBy("lang", "chunk").agg(F.sum("times").alias("times"))


def _rounds(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, np.ndarray]]:
    """(language, chunks joined by blanks, how often each token's chunk occurs) in rounds of bounded size."""
    held: dict[str, tuple[list[bytes], list[int]]] = {}
    size = 0

    def close() -> Iterator[tuple[str, bytes, np.ndarray]]:
        for lang, (chunks, times) in held.items():
            counts = np.fromiter((chunk.count(b" ") + 1 for chunk in chunks), np.int64, len(chunks))
            weight = np.repeat(np.array(times, np.int64), counts)
            # the shared tokens start no n-gram here
            ends = np.cumsum(counts)
            for k in range(1, OVERLAP + 1):
                weight[ends - k] = 0
            yield lang, b" ".join(chunks), weight
        held.clear()

    for batch in source:
        columns = batch.column("lang").to_pylist(), batch.column("chunk").cast(pa.binary()).to_pylist(), batch.column("times").to_pylist()
        for lang, chunk, times in zip(*columns, strict=True):
            chunks, counts = held.setdefault(lang, ([], []))
            chunks.append(chunk)
            counts.append(times)
            size += len(chunk)
            if size >= ROUND_BYTES:
                yield from close()
                size = 0
    yield from close()


def _summed(tokens: Tokens, codes: np.ndarray, at: np.ndarray, weight: np.ndarray, words: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Distinct n-grams as text and their weights' sums, in blocks; n-grams are told apart by hash."""
    unique, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
    totals = np.zeros(len(unique), np.int64)
    np.add.at(totals, inverse, weight)
    low, high = tokens.start[at[first]], tokens.end[at[first] + words - 1]
    raw = np.frombuffer(tokens.data, np.uint8)
    for k in range(0, len(unique), ROW_BLOCK):
        lengths = high[k : k + ROW_BLOCK] - low[k : k + ROW_BLOCK]
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        where = np.repeat(low[k : k + ROW_BLOCK] - offsets[:-1], lengths) + np.arange(offsets[-1])
        texts = pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw[where])])
        yield texts, pa.array(totals[k : k + ROW_BLOCK])


def _pair_codes(tokens: Tokens) -> np.ndarray:
    return wordkernel.mix(wordkernel.mix(tokens.code[:-1] + _STEP) ^ tokens.code[1:])


def _bits(codes: np.ndarray, lang: str, bits: int) -> np.ndarray:
    """Bitmap places of pairs of a language."""
    return (wordkernel.mix(codes ^ np.uint64(wordkernel.digest64(lang.encode()))) % np.uint64(bits)).astype(np.int64)


def _rows(lang: str, words: int, counted: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.RecordBatch]:
    for texts, totals in counted:
        n = len(totals)
        columns = [pa.array([lang]).take(pa.array(np.zeros(n, np.int64))), pa.array(np.full(n, words, np.int32)), texts, totals]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "words", "phrase", "f"])


_GRAM = "lang string, words int, phrase string, f bigint"


def count_short(dictionary: DataFrame) -> DataFrame:
    """``lang, words, phrase, f`` of all phrases of one and two words."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data, weight in _rounds(source):
            tokens = Tokens(data)
            one = np.flatnonzero(tokens.word & (weight > 0))
            yield from _rows(lang, 1, _summed(tokens, tokens.code[one], one, weight[one], 1))
            two = np.flatnonzero(tokens.word[:-1] & tokens.word[1:] & (weight[:-1] > 0))
            yield from _rows(lang, 2, _summed(tokens, _pair_codes(tokens)[two], two, weight[two], 2))

    return dictionary.mapInArrow(count, _GRAM).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def pair_bitmap(pairs: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """One bit per hash of the given ``lang, phrase`` rows; bits are joined in the tasks, then by 64-bit word."""

    def mark(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            langs = np.array(batch.column("lang").to_pylist(), object)
            phrases = np.array(batch.column("phrase").cast(pa.binary()).to_pylist(), object)
            places = []
            for lang in set(langs.tolist()):
                tokens = Tokens(b" ".join(phrases[langs == lang].tolist()))
                places.append(_bits(_pair_codes(tokens)[::2], lang, bits))
            if places:
                place = np.unique(np.concatenate(places))
                yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array(np.left_shift(np.int64(1), place & 63))], ["slot", "bit"])

    # at most bits / 64 rows
    marked = pairs.select("lang", "phrase").mapInArrow(mark, "slot bigint, bit bigint").groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[marked.column("slot").to_numpy()] = marked.column("bits").to_numpy()
    return bitmap


def count_triples(dictionary: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """``lang, words, phrase, f`` of all phrases of three words whose halves both meet the bitmap."""
    shared, bits = dictionary.sparkSession.sparkContext.broadcast(bitmap), 64 * len(bitmap)

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data, weight in _rounds(source):
            tokens = Tokens(data)
            pair = _pair_codes(tokens)
            place = _bits(pair, lang, bits)
            known = (shared.value[place >> 6] >> (place & 63)) & 1 != 0
            word = tokens.word
            at = np.flatnonzero(known[:-1] & known[1:] & word[:-2] & word[1:-1] & word[2:] & (weight[:-2] > 0))
            yield from _rows(lang, 3, _summed(tokens, wordkernel.mix(pair[at] + _STEP) ^ tokens.code[at + 2], at, weight[at], 3))

    return dictionary.mapInArrow(count, _GRAM).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) in whole numbers of up to 38 digits; counts below 10 ** 15 fit."""
    wide = [column.cast("decimal(15,0)") for column in (a, left, right)]
    top = (wide[0] * wide[0]).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide[1] * wide[2]).cast("decimal(38,0)")).cast("long")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, absorbed: int = ABSORBED, most: int | None = MOST
) -> DataFrame:
    """The best-scored phrases of two and three words of every language.

    Returns ``lang, rank, phrase, a, l, r, n, score``: ``a`` is the phrase's number
    of places, ``l`` and ``r`` those of its parts at the weakest cut (the first of
    equally weak ones), ``n`` all words of the language. Phrases seen fewer than
    ``least`` times are no candidates; a pair that stands in a triple seen ``least``
    times and ``absorbed`` percent as often goes. The first ``most`` of each
    language by score, places and text stay (all, if None).

    Whole texts are read. Null texts are empty, a null language is ``und``; repeated
    rows count as often as they stand there; an empty table gives no rows. Only the
    two named columns are read, so extra columns of any name don't matter.
    """
    dictionary = stage(parse(docs, lang_col, text_col), "chunks")
    short = count_short(dictionary)
    # pairs below the limit serve neither as candidates nor as parts of one
    counts = stage(short.filter((F.col("words") == 1) | (F.col("f") >= least)), "short-phrases")
    ones, pairs = counts.filter("words = 1"), counts.filter("words = 2").select("lang", "phrase", "f")
    triples = count_triples(dictionary, pair_bitmap(pairs)).filter(F.col("f") >= least)
    triples = stage(triples.select("lang", "phrase", "f"), "triples")
    parts = counts.filter(F.col("f") >= least).select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))

    word = lambda k: F.substring_index(F.substring_index("phrase", " ", k), " ", -1)
    cuts = {1: (F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1))}
    cuts_of_three = {
        1: (word(1), F.substring_index("phrase", " ", -2)),
        2: (F.substring_index("phrase", " ", 2), word(3)),
    }

    def with_parts(table: DataFrame, made: dict[int, tuple[Column, Column]]) -> DataFrame:
        for k, sides in made.items():
            for name, side in zip("lr", sides, strict=True):
                found = parts.select(F.col("lang").alias("part_lang"), "part", F.col("part_f").alias(f"{name}{k}"))
                table = table.withColumn("side", side)
                table = table.join(found, (F.col("lang") == F.col("part_lang")) & (F.col("side") == F.col("part"))).drop("side", "part", "part_lang")
        scored = [F.struct(_score(F.col("f"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in made]
        return table.withColumn("cut", F.least(*scored) if len(scored) > 1 else scored[0]).select("lang", "phrase", "f", "cut.l", "cut.r", "cut.score")

    around = triples.select("lang", "f", F.explode(F.array(cuts_of_three[1][1], cuts_of_three[2][0])).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    alone = pairs.join(around, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < absorbed * F.col("f"), F.lit(True))).drop("longer")
    candidates = with_parts(alone, cuts).unionByName(with_parts(triples, cuts_of_three))

    best = [F.desc("score"), F.desc("f"), "phrase"]
    if most is not None:
        part = F.pmod(F.xxhash64("phrase"), F.lit(RANKING_PARTS))
        nth = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))
        candidates = candidates.withColumn("part", part).withColumn("nth", nth).filter(F.col("nth") <= most).drop("part", "nth")
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    if most is not None:
        ranked = ranked.filter(F.col("rank") <= most)
    sizes = ones.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(F.broadcast(sizes), "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT k, lang, row_number() OVER () AS piece, words FROM (
  SELECT k, lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS words FROM d) WHERE len(words) > 0),
w AS (SELECT lang, piece, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM p),
s AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY piece ORDER BY i)),
sizes AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS f FROM s GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM s WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM s WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
longer AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
c2 AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r FROM f2
  JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  LEFT JOIN longer ON longer.lang = f2.lang AND longer.w1 = f2.w1 AND longer.w2 = f2.w2
  WHERE f2.f >= {LEAST} AND coalesce(100 * longer.f < {ABSORBED} * f2.f, true)),
c3 AS (
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.f AS a, k, CASE k WHEN 1 THEN x.f ELSE xy.f END AS l, CASE k WHEN 1 THEN yz.f ELSE z.f END AS r
  FROM f3 CROSS JOIN (VALUES (1), (2)) AS cuts(k)
  JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f1 z ON z.lang = f3.lang AND z.w1 = f3.w3
  JOIN f2 xy ON xy.lang = f3.lang AND xy.w1 = f3.w1 AND xy.w2 = f3.w2 JOIN f2 yz ON yz.lang = f3.lang AND yz.w1 = f3.w2 AND yz.w2 = f3.w3),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM (SELECT * FROM c2 UNION ALL SELECT * FROM c3)),
cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM cut)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= {MOST}
"""


@register("op12_phrases", SQL)
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))
