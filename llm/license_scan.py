"""License scan: ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from llm.frames import read_table, require, sheltered, sql_identifier
from llm.license_rules import RULES, Rule
from llm.registry import register

#: Phrases that are looked for in any case, and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Confidence of a detection by its rule's priority, and of a base phrase alone.
CONFIDENCE = {1: 1.0, 2: 0.8, 3: 0.5}
BASE_CONFIDENCE = 0.5

_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
_BETWEEN_ANY_CASE = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
_WORD_ANY_CASE = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]++"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _STOP = "\u0001", "\u0002"


def gate_pattern(rules: list[Rule]) -> str:
    """One expression that any text with a match of a rule or a base phrase contains."""
    words = {rule.keyword for rule in rules} | {phrase for phrase, _ in BASE}
    shortest = sorted(w for w in words if not any(o != w and w.startswith(o) for o in words))
    # keywords start words, so they are only tried behind something that is no word
    return f"(?i)(?:^|{_BETWEEN_ANY_CASE}){_one_of(shortest)}"


def _one_of(words: list[str]) -> str:
    """An expression for any of some words, none the start of another; what they start with is tried once."""
    tails: dict[str, list[str]] = {}
    for word in words:
        tails.setdefault(word[0], []).append(word[1:])
    branches = [(f"{_BETWEEN_ANY_CASE}++" if c == " " else c) + (_one_of(rest) if rest[0] else "") for c, rest in tails.items()]
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(words: Column, pattern: Column) -> Column:
    """Intervals ``start, stop`` of words that match a pattern, from left to right."""
    marked = F.regexp_replace(
        words, F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )")), F.lit(f"{_START}$0{_STOP}")
    )
    parts = F.split(marked, _START)
    begin = F.struct(
        (_blanks(F.element_at(parts, 1)) - 1).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found")
    )

    def step(state: Column, part: Column) -> Column:
        match = F.substring_index(part, _STOP, 1)
        interval = F.struct(state["at"].alias("start"), (state["at"] + _blanks(match) + 1).alias("stop"))
        return F.struct((state["at"] + _blanks(part)).alias("at"), F.concat(state["found"], F.array(interval)).alias("found"))

    return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), begin, step, lambda state: state["found"])


def _detections(words: Column, rules: list[Rule]) -> Column:
    """Matches of all rules whose keyword is there, sorted by start, longest first, then strength."""
    # one folded literal; hundreds of struct expressions would be analysed one by one
    by_keyword: dict[str, list[dict]] = {}
    for i, rule in enumerate(rules):
        entry = {"priority": rule.priority, "rank": i, "label": rule.label, "pattern": rule.pattern}
        by_keyword.setdefault(rule.keyword, []).append(entry)
    # rules of one keyword together, so that a text is searched for it once
    table = F.from_json(
        F.lit(json.dumps([{"keyword": keyword, "rules": entries} for keyword, entries in by_keyword.items()])),
        "array<struct<keyword:string,rules:array<struct<priority:int,rank:int,label:string,pattern:string>>>>",
    )
    there = F.filter(table, lambda group: F.contains(words, group["keyword"]))
    near = F.flatten(F.transform(there, lambda group: group["rules"]))
    found = F.transform(
        near,
        lambda rule: F.transform(
            _places(words, rule["pattern"]),
            lambda place: F.struct(
                place["start"].alias("start"), (-place["stop"]).alias("minus_stop"),
                rule["priority"].alias("priority"), rule["rank"].alias("rank"), rule["label"].alias("label"),
            ),
        ),
    )
    return F.array_sort(F.flatten(found))


def _suppressed(detections: Column) -> Column:
    """Without detections that lie inside one of the same or a stronger priority.

    In the order by start, longest first, a detection lies inside an earlier one
    exactly if the furthest stop so far reaches its own; one pass does, with the
    furthest stop of each priority or stronger.
    """
    kind = "array<struct<start:int,minus_stop:int,priority:int,rank:int,label:string>>"
    none = F.struct(*[F.lit(-1).alias(f"far{p}") for p in CONFIDENCE], F.array().cast(kind).alias("kept"))

    def step(state: Column, new: Column) -> Column:
        stop = -new["minus_stop"]
        reach = F.lit(-1)
        for p in CONFIDENCE:
            reach = F.when(new["priority"] == p, state[f"far{p}"]).otherwise(reach)
        far = [F.when(new["priority"] <= p, F.greatest(state[f"far{p}"], stop)).otherwise(state[f"far{p}"]).alias(f"far{p}") for p in CONFIDENCE]
        return F.struct(*far, F.when(reach >= stop, state["kept"]).otherwise(F.concat(state["kept"], F.array(new))).alias("kept"))

    return F.aggregate(detections, none, step, lambda state: state["kept"])


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), F.lit(label).alias("label")))


@sheltered
def scan(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", into: str = "licenses") -> DataFrame:
    """Add the struct column ``into`` (replacing one of that name) to every document.

    Fields: ``n_words``; ``base`` and ``detections``, arrays of intervals of words
    (``start``, ``stop``, ``label``; detections also ``priority`` and ``rank``);
    ``score``. A-Z are lower-cased; words are runs of digits, letters a-z and
    characters beyond ASCII. Texts without any rule's keyword are passed over; of
    the rest, rules whose keyword is absent. Of overlapping detections one that
    lies inside another of the same or a stronger priority goes; of equal
    intervals the stronger priority, then the earlier rule stays. Partly
    overlapping detections all stay. No shuffle, row by row over whole texts.

    A null or empty text has no words, empty arrays and score 0. Every row stays,
    repeated ones too; an empty table stays empty.
    """
    require(docs, text_col)
    rules = RULES if rules is None else rules
    text = F.coalesce(F.col(sql_identifier(text_col)), F.lit(""))
    lowered = F.translate(text, _UPPER, _LOWER)
    blank = F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, f"{_BETWEEN}++", " ")), F.lit(" "))
    gated = docs.withColumn("__words", F.when(text.rlike(gate_pattern(rules)), blank))
    words = F.col("__words")
    base = F.flatten(F.array(*[_labelled(_places(words, F.lit(phrase)), label) for phrase, label in BASE]))
    empty_base = F.array().cast("array<struct<start:int,stop:int,label:string>>")
    empty = F.array().cast("array<struct<start:int,minus_stop:int,priority:int,rank:int,label:string>>")
    raw = gated.withColumns(
        {
            "__base": F.when(words.isNotNull(), base).otherwise(empty_base),
            "__found": F.when(words.isNotNull(), _suppressed(_detections(words, rules))).otherwise(empty),
        }
    )
    weight = F.lit(0.0)
    strengths = F.transform("__found", lambda d: d["priority"])
    for priority, value in CONFIDENCE.items():
        weight = F.greatest(weight, F.when(F.array_contains(strengths, priority), F.lit(value)).otherwise(0.0))
    weight = F.greatest(weight, F.when(F.size("__base") > 0, F.lit(BASE_CONFIDENCE)).otherwise(0.0))
    spans = F.transform(
        "__found",
        lambda d: F.struct(d["start"].alias("start"), (-d["minus_stop"]).alias("stop"), d["label"].alias("label"), d["priority"].alias("priority"), d["rank"].alias("rank")),
    )
    n_words = F.regexp_count(text, F.lit(_WORD_ANY_CASE)).cast("long")
    return raw.withColumn(
        into, F.struct(n_words.alias("n_words"), F.col("__base").alias("base"), spans.alias("detections"), weight.alias("score"))
    ).drop("__words", "__base", "__found")


@register("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"), into="__licenses").select("doc_id", "__licenses.*")
    starts = F.transform("base", lambda b: b["start"].cast("long"))
    base = F.transform("base", lambda b: b["label"])
    own = F.transform("detections", lambda d: d["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        "score",
        F.size("detections").cast("long").alias("n_detections"),
    )
