"""Quality rules as a ledger of failure bits and measurements, with versioned policies on top."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from llm import wordkernel
from llm.frames import read_table, require, sheltered, sql_identifier
from llm.registry import register

#: What is measured once per document; all counts.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_bullet_lines", "n_open_lines",
)
REPEAT_WINDOW = 5
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A rule fails a document if ``fails`` holds; whole-number arithmetic only."""

    name: str
    fails: Callable[[dict[str, Column]], Column]


#: Position is the bit; append only, so that ledgers written earlier stay readable.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 10),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule("many_symbols", lambda m: 100 * m["n_symbols"] > 10 * m["n_words"]),
    Rule("duplicate_lines", lambda m: 100 * m["n_dup_lines"] > 40 * m["n_lines"]),
    Rule("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", lambda m: m["word_chars"] > 15 * m["n_words"]),
    Rule("few_letters", lambda m: 100 * m["n_letter_words"] < 50 * m["n_words"]),
    Rule("bullet_lines", lambda m: 100 * m["n_bullet_lines"] > 90 * m["n_lines"]),
    Rule("open_lines", lambda m: 100 * m["n_open_lines"] > 30 * m["n_lines"]),
)
BITS = {rule.name: 1 << i for i, rule in enumerate(RULES)}
BASE = ("few_words", "repeated_words")
#: A policy names the rules that reject a document.
POLICIES = {
    "v1": BASE,
    "v2": (*BASE, "many_symbols", "duplicate_lines", "few_letters"),
    "v3": tuple(BITS),
}
POLICY = "v3"


def policy_mask(version: str) -> int:
    return sum(BITS[name] for name in POLICIES[version])


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BULLETS = (b"*", b"-", "•".encode())
_OPEN = (b"...", "…".encode())


def repeated_positions(codes: np.ndarray, size: int) -> int:
    """Positions covered by runs of ``size`` codes that occur twice or more."""
    hashes = wordkernel.windows(codes, size)
    if len(hashes) < 2:
        return 0
    _, place, count = np.unique(hashes, return_inverse=True, return_counts=True)
    often = count[place] > 1
    if not often.any():
        return 0
    covered = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + size, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def measure(texts: list[bytes]) -> np.ndarray:
    """One row of MEASURES per text."""
    rows = np.zeros((len(texts), len(MEASURES)), np.int64)
    for low, high in wordkernel.pieces(texts):
        words = wordkernel.Words(texts[low:high], lower=False)
        raw = words.raw
        ends = words.text_end

        def per_text(flags: np.ndarray, ends: np.ndarray = ends) -> np.ndarray:
            return np.diff(np.cumsum(flags, dtype=np.int64)[ends - 1], prepend=0)

        rows[low:high, 0] = np.diff(words.bounds)
        rows[low:high, 1] = per_text(((raw & 0xC0) != 0x80) & ~wordkernel.SPACE[raw])
        rows[low:high, 2] = per_text(_SYMBOL[raw])
        letters = np.concatenate(([0], np.cumsum(_LETTER[raw], dtype=np.int64)))
        has_letter = np.concatenate(([0], np.cumsum(letters[words.end] > letters[words.start])))
        rows[low:high, 6] = has_letter[words.bounds[1:]] - has_letter[words.bounds[:-1]]
        for i in range(low, high):
            # bytes.split knows the same six space characters
            lines = [line for line in texts[i].split(b"\n") if line.split()]
            tails = [line.strip() for line in lines]
            codes = words.code[words.bounds[i - low] : words.bounds[i - low + 1]]
            rows[i, 3:6] = len(lines), len(lines) - len(set(lines)), repeated_positions(codes, REPEAT_WINDOW)
            rows[i, 7:9] = sum(t.startswith(_BULLETS) for t in tails), sum(t.endswith(_OPEN) for t in tails)
    return rows


def _measure(texts: pa.Array) -> pa.Array:
    rows = measure([text or b"" for text in texts.cast(pa.binary()).to_pylist()])
    return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(MEASURES))], list(MEASURES))


def ledger(docs: DataFrame, text_col: str = "text", into: str = "ledger") -> DataFrame:
    """Every rule evaluated once per document.

    Adds the struct column ``into`` (replacing one of that name) with all of
    MEASURES and ``failed``, whose bit i is set if rule i fails the document. No
    shuffle; every row stays. A null text counts as empty: all measures 0, so it
    fails ``few_words``. Equal texts get equal ledgers, repeated rows stay rows.
    Lines are split at newlines and counted if they hold a word; a repeated line
    is compared byte for byte.
    """
    require(docs, text_col)
    # marked as not deterministic so that filters on the ledger don't measure twice
    kind = "struct<" + ", ".join(f"{name}: bigint" for name in MEASURES) + ">"
    measured = docs.withColumn(into, F.arrow_udf(_measure, kind).asNondeterministic()(F.col(sql_identifier(text_col))))
    name = sql_identifier(into)
    fields = {measure_: F.col(f"{name}.{measure_}") for measure_ in MEASURES}
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(rule.fails(fields), F.lit(1 << i)).otherwise(0).cast("long"))
    return measured.withColumn(into, F.struct(*[fields[m].alias(m) for m in MEASURES], bits.alias("failed")))


def passes(failed: Column, version: str = POLICY) -> Column:
    """Whether a document with these failure bits stays under a policy."""
    return failed.bitwiseAND(F.lit(policy_mask(version))) == 0


@sheltered
def quality_filter(docs: DataFrame, version: str = POLICY, text_col: str = "text") -> DataFrame:
    """The documents a policy keeps, with the columns of ``docs``."""
    made = "__ledger"
    return ledger(docs, text_col, made).filter(passes(F.col(f"{made}.failed"), version)).select(*[sql_identifier(c) for c in docs.columns])


def ablation(failed: DataFrame, version: str = POLICY, column: str = "failed") -> DataFrame:
    """What each rule of a policy adds, from the ledger alone.

    ``failed`` holds one row per document. Documents are first counted per
    pattern of failure bits (at most 2 ** rules rows); each rule then sums the
    patterns: ``n_failed`` (bit set), ``n_only`` (rejected by no other rule of
    the policy, so kept without it), ``n_kept`` (kept under the whole policy).
    """
    mask = policy_mask(version)
    patterns = failed.groupBy(F.col(sql_identifier(column)).bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BITS[name]).cast("long").alias("bit")) for name in POLICIES[version]]))
    counted = patterns.select("bits", "n", rules.alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("n_kept"),
    )
    return counted.withColumn("policy", F.lit(version))


_SPACE_SQL = "\\x20\\x09-\\x0D"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT k, doc_id, text, regexp_extract_all(text, '[^{_SPACE_SQL}]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE_SQL}]')) AS lines FROM d),
grams AS (
  SELECT k, i, list_aggregate(list_slice(words, i, i + {REPEAT_WINDOW - 1}), 'string_agg', ' ') AS gram
  FROM (SELECT k, words, unnest(range(1, greatest(len(words) - {REPEAT_WINDOW - 2}, 1))) AS i FROM w)),
often AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM grams) WHERE n > 1),
covered AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + {REPEAT_WINDOW})) AS p FROM often) GROUP BY k),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]')))::BIGINT AS n_letter_words,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[{_SPACE_SQL}]*[*\\x{{2022}}-]')))::BIGINT AS n_bullet_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '([.][.][.]|\\x{{2026}})[{_SPACE_SQL}]*$')))::BIGINT AS n_open_lines
  FROM w LEFT JOIN covered USING (k)),
f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_letter_words < 50 * n_words THEN 64 ELSE 0 END + CASE WHEN 100 * n_bullet_lines > 90 * n_lines THEN 128 ELSE 0 END
    + CASE WHEN 100 * n_open_lines > 30 * n_lines THEN 256 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept,
       n_lines, n_letter_words, n_bullet_lines, n_open_lines, failed, (failed & 79) = 0 AS kept_v2
FROM f
"""


@register("op8_quality_rules", SQL)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ledger(read_table(spark, sf_dir, "documents"), into="__ledger").select("doc_id", "__ledger.*")
    base = sum(BITS[name] for name in BASE)
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(base)) != 0).alias("base_failed"),
        passes(F.col("failed")).alias("kept"),
        "n_lines", "n_letter_words", "n_bullet_lines", "n_open_lines", "failed",
        passes(F.col("failed"), "v2").alias("kept_v2"),
    )
