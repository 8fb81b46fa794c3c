"""Repeated runs of lines by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from llm import wordkernel
from llm.frames import join_rows, read_table, require, row_key, sheltered, shuffle_width, sql_identifier, stage
from llm.registry import register

#: A run of lines is a repetition if it holds this many words or more.
LEAST_WORDS = 50
#: A run with one of this many parts of all places is looked up by broadcast; so there are no more such runs than this.
HOT_KEYS = 2000

_POWER = 0x9E3779B97F4A7C15 | 1


def spoken_lines(text: bytes) -> list[bytes]:
    """The lines that hold a word, without white space at either end."""
    return [stripped for line in text.split(b"\n") if (stripped := line.strip())]


def _run_hashes(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hash of each run: a polynomial in the lines' scrambled hashes, from sums over all lines before."""
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(codes), _POWER, np.uint64))))
    inverse = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(codes), pow(_POWER, -1, 1 << 64), np.uint64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * powers[:-1])))
    return wordkernel.mix((sums[stops] - sums[starts]) * inverse[starts] ^ (stops - starts).astype(np.uint64))


def window_bounds(words: np.ndarray, firsts: np.ndarray | int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the shortest run of ``least_words`` words ending at each line that has one.

    Documents may stand back to back: ``firsts`` is the first line of each line's document.
    """
    before = np.concatenate(([0], np.cumsum(words)))
    starts = np.searchsorted(before, before[1:] - least_words, side="right") - 1
    inside = starts >= firsts
    return starts[inside], np.flatnonzero(inside) + 1


def _last_minima(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Place of the smallest value in each interval, the last of equals, from minima over powers of two."""
    places = np.arange(len(values))
    best = np.zeros(len(starts), np.int64)
    sizes, width = stops - starts, 1
    while len(starts) and width <= sizes.max():
        now = (sizes >= width) & (sizes < 2 * width)
        left, right = places[starts[now]], places[stops[now] - width]
        best[now] = np.where(values[right] <= values[left], right, left)
        left, right = places[: max(len(places) - width, 0)], places[width:]
        places = np.where(values[right] <= values[left], right, left)
        width *= 2
    return best


def winnow(
    hashes: np.ndarray, words: np.ndarray, least_words: int, firsts: np.ndarray | int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chosen line, its hash, window's hash) of every window of a document, or of documents back to back.

    A window is the shortest run of lines that ends at a line and holds
    ``least_words`` words; its line of the smallest scrambled hash, the last of
    equals, is chosen. Any run of that many words contains the whole window that
    ends at its last line, so two equal runs have a window and a choice in common.
    """
    starts, stops = window_bounds(words, firsts, least_words)
    order = wordkernel.mix(hashes)
    chosen = _last_minima(order, starts, stops)
    return chosen, hashes[chosen], _run_hashes(order, starts, stops)


def extended_windows(
    hashes: np.ndarray, words: np.ndarray, firsts: np.ndarray | int, least_words: int, anchors: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, hash, second hash) of the runs to compare around the chosen lines ``anchors`` (a mask over lines).

    Downwards, a match goes on from window to window, one for each last line.
    Upwards, it takes in lines for which the run without its last line still holds
    too few words: with enough, that shorter run has a window of its own. So all
    lines of a repeated run lie in these runs, and a text has no more of them than
    words.
    """
    starts, stops = window_bounds(words, firsts, least_words)
    kept = anchors[_last_minima(wordkernel.mix(hashes), starts, stops)]
    starts, stops = starts[kept], stops[kept]
    before = np.concatenate(([0], np.cumsum(words)))
    highest = np.searchsorted(before, before[stops - 1] - least_words, side="right")
    document = firsts[stops - 1] if isinstance(firsts, np.ndarray) else firsts
    more = np.maximum(starts - np.maximum(highest, document), 0)
    upwards = np.arange(len(starts) + more.sum()) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
    starts, stops = np.repeat(starts, more + 1) - upwards, np.repeat(stops, more + 1)
    codes = wordkernel.mix(hashes)
    return starts, stops, _run_hashes(codes, starts, stops), _run_hashes(wordkernel.mix(~codes), starts, stops)


def repeated_runs(mine: np.ndarray, other: np.ndarray, shift: int, anchors: np.ndarray) -> list[tuple[int, int]]:
    """Matches at ``anchors`` extended both ways: runs of lines i equal to lines i + shift of the other document."""
    low, high = max(0, -shift), min(len(mine), len(other) - shift)
    edge = np.flatnonzero(np.diff((mine[low:high] == other[low + shift : high + shift]).view(np.int8), prepend=0, append=0)) + low
    starts, stops = edge[0::2], edge[1::2]
    hit = np.unique(np.searchsorted(stops, anchors, side="right"))
    return [(int(starts[k]), int(stops[k])) for k in hit if k < len(starts) and starts[k] <= anchors.max()]


def _lines(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        hashes, words = [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            lines = spoken_lines(text or b"")
            hashes.append(np.array([wordkernel.digest64(line) for line in lines], np.uint64).view(np.int64))
            words.append([len(line.split()) for line in lines])
        yield pa.RecordBatch.from_arrays(
            [batch.column("__id"), batch.column("__hash"), pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32()))],
            ["__id", "__hash", "hashes", "words"],
        )


def _back_to_back(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, its first line, hash, words) of each line of a batch, and the lines' offsets by document."""
    hashes, words = batch.column("hashes"), batch.column("words")
    sizes = pc.list_value_length(hashes).to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    values = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    counts = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(batch.column("d").to_numpy(), sizes), np.repeat(offsets[:-1], sizes), values, counts, offsets


def _windows(least_words: int):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            docs, firsts, hashes, words, _ = _back_to_back(batch)
            chosen, marks, runs = winnow(hashes, words, least_words, firsts)
            columns = [docs[chosen], chosen - firsts[chosen], marks.view(np.int64), runs.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in columns], ["d", "line", "mark", "run"])

    return batches


def _fingerprints(least_words: int):
    """Each chosen line once, however many windows choose it."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            docs, firsts, hashes, words, _ = _back_to_back(batch)
            chosen = np.unique(winnow(hashes, words, least_words, firsts)[0])
            columns = [docs[chosen], chosen - firsts[chosen], hashes[chosen].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in columns], ["d", "line", "mark"])

    return batches


def _extended(least_words: int):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            docs, firsts, hashes, words, offsets = _back_to_back(batch)
            lines = batch.column("anchors")
            anchors = np.zeros(len(docs), bool)
            anchors[np.repeat(offsets[:-1], pc.list_value_length(lines).to_numpy(zero_copy_only=False)) + lines.flatten().to_numpy()] = True
            starts, stops, run, check = extended_windows(hashes, words, firsts, least_words, anchors)
            own = firsts[starts]
            columns = [docs[starts], starts - own, stops - own, run.view(np.int64), check.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in columns], ["d", "start", "stop", "run", "check"])

    return batches


def _joined(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching runs of each document as one."""
    for batch in source:
        out = []
        for runs in batch.column("runs").to_pylist():
            merged: list[dict] = []
            for start, stop in sorted((run["start"], run["stop"]) for run in runs):
                if merged and start <= merged[-1]["stop"]:
                    merged[-1]["stop"] = max(merged[-1]["stop"], stop)
                else:
                    merged.append({"start": start, "stop": stop})
            out.append(merged)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(out, kind)], ["d", "__runs"])


def _later_places(places: DataFrame, key: list[str], place: list[str]) -> DataFrame:
    """The places of a key behind its first one, with the first as ``first``.

    Keys with a 2000th of all places or more, at most 2000 of them, are broadcast,
    so a passage that most documents hold never is one task's work.
    """
    n = F.count(F.lit(1))
    originals = stage(places.groupBy(*key).agg(F.min(F.struct(*place)).alias("first"), n.alias("n")).filter("n > 1"), "originals")
    hot = F.broadcast(originals.filter(F.col("n") >= max(places.count() // HOT_KEYS, 2) + 1).select(*key, F.col("first").alias("hot")))
    marked = places.join(hot, key, "left")
    behind = F.struct(*place) > F.col("first")
    common = marked.filter("hot IS NOT NULL").withColumnRenamed("hot", "first")
    rare = marked.filter("hot IS NULL").drop("hot").join(originals.select(*key, "first"), key)
    return common.unionByName(rare).filter(behind)


def _runs_of_any_place(sorted_lines: DataFrame, least_words: int) -> DataFrame:
    """``d, __runs``: the lines of runs that stand at any earlier place.

    Winnowed fingerprints are joined on the hash of the chosen line; those of one
    place only end there. Windows around the others are extended and joined with
    the first place of what they hold.
    """
    arrays = sorted_lines.select("d", "hashes", "words")
    chosen = stage(arrays.mapInArrow(_fingerprints(least_words), "d bigint, line bigint, mark bigint"), "fingerprints")
    shared = chosen.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark")
    # one row per document, of its own lines
    anchors = chosen.join(shared, "mark", "left_semi").groupBy("d").agg(F.collect_list("line").alias("anchors"))
    shape = "d bigint, start bigint, stop bigint, run bigint, check bigint"
    places = stage(arrays.join(anchors, "d").mapInArrow(_extended(least_words), shape), "windows")
    later = _later_places(places, ["run", "check"], ["d", "start"])
    gathered = later.groupBy("d").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    return gathered.mapInArrow(_joined, "d bigint, __runs array<struct<start:bigint,stop:bigint>>")


def _extend(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        docs, starts, stops = [], [], []
        columns = [batch.column(name) for name in ("d", "shift", "anchors", "mine", "other")]
        for d, shift, anchors, mine, other in zip(*columns, strict=True):
            arrays = [x.values.to_numpy(zero_copy_only=False) for x in (mine, other, anchors)]
            for start, stop in repeated_runs(arrays[0], arrays[1], shift.as_py(), np.sort(arrays[2])):
                docs.append(d.as_py())
                starts.append(start)
                stops.append(stop)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, starts, stops)], ["d", "start", "stop"])


def _runs_of_first_place(sorted_lines: DataFrame, least_words: int) -> DataFrame:
    """``d, __runs``: the runs that extend from a window's first place."""
    places = stage(sorted_lines.select("d", "hashes", "words").mapInArrow(_windows(least_words), "d bigint, line bigint, mark bigint, run bigint"), "windows")
    originals = (
        places.groupBy("mark", "run").agg(F.min(F.struct("d", "line")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    later = places.join(originals, ["mark", "run"]).filter(F.struct("d", "line") > F.col("first"))
    # one row per pair of documents and distance of lines
    matches = later.groupBy("d", F.col("first.d").alias("d0"), (F.col("first.line") - F.col("line")).alias("shift")).agg(
        F.collect_set("line").alias("anchors")
    )
    arrays = sorted_lines.select("d", "hashes")
    aligned = matches.join(arrays.withColumnRenamed("hashes", "mine"), "d").join(
        arrays.withColumnsRenamed({"d": "d0", "hashes": "other"}), "d0"
    )
    runs = aligned.select("d", "shift", "anchors", "mine", "other").mapInArrow(_extend, "d bigint, start bigint, stop bigint")
    return runs.groupBy("d").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("__runs"))


def _cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
    """Each text without the lines of its runs (counted among lines with a word)."""
    out = []
    for text, intervals in zip(texts.cast(pa.binary()).to_pylist(), runs.to_pylist(), strict=True):
        if text is None or not intervals:
            out.append(text)
            continue
        gone = {line for run in intervals for line in range(run["start"], run["stop"])}
        kept, number = [], 0
        for line in text.split(b"\n"):
            if line.strip():
                if number not in gone:
                    kept.append(line)
                number += 1
            else:
                kept.append(line)
        out.append(b"\n".join(kept))
    return pa.array(out, pa.binary()).cast(pa.string())


@sheltered
def dedup_lines(
    docs: DataFrame,
    least_words: int = LEAST_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    into: str = "dropped_runs",
    every_place: bool = False,
) -> DataFrame:
    """Delete later repetitions of runs of lines; every document stays.

    Returns the columns of ``docs`` with the text cut, and ``into`` (replacing a
    column of that name): an array of ``start, stop`` of the deleted runs, counted
    among the text's lines that hold a word, in order; empty if there are none.

    Documents stand in the order of id (null first), then row hash; equal rows in
    any order among themselves. Lines are compared without white space at their
    ends.

    With ``every_place``, a line is deleted if it lies in a run of ``least_words``
    words or more that stands at any earlier place too, in another document or
    further up. The fingerprints of all windows are joined; windows around those with
    more than one place are extended down, from window to window, and up, by the
    lines that belong to no window of the run; all but the first place of each
    extension in the order go. Deleted lines that touch are one run.

    Without, a run is compared with one place only: every window of lines that holds
    ``least_words`` words is looked up by the hash of its chosen line and of the whole
    window; its first place is the original. All later places are joined with that
    one, extended up and down as long as lines are equal, and deleted. Lines at the
    edge of a run that equal another earlier place, but not the first, stay.

    A deleted line always has an equal earlier one, and the earliest never goes.
    Shorter runs stay. Blank lines stay.

    Null texts stay null; empty texts have no lines. Texts of one line can only
    go whole. An empty table stays empty. The matching work is one row per window (with
    ``every_place`` and its extensions: no more than words), each joined with one
    original: no pairs among repetitions. A text is worked on whole, whatever its
    length, in memory in proportion to it.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    text = sql_identifier(text_col)
    keyed = row_key(docs, id_col)
    # the copy number is left out here, so texts are not shuffled for it
    named = keyed.drop("__copy").select("__id", "__hash", F.col(text).alias("text"))
    lined = stage(named.mapInArrow(_lines, "__id bigint, __hash bigint, hashes array<bigint>, words array<int>"), "lines")
    sorted_lines = stage(
        lined.repartitionByRange(shuffle_width(spark), "__id", "__hash")
        .sortWithinPartitions("__id", "__hash")
        .withColumn("d", F.monotonically_increasing_id()),
        "sorted-lines",
    )
    find = _runs_of_any_place if every_place else _runs_of_first_place
    dropped = stage(find(sorted_lines, least_words), "dropped")
    number = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy("d")).alias("__copy")
    cuts = sorted_lines.select("__id", "__hash", "d", number).join(dropped, "d").select("__id", "__hash", "__copy", "__runs")
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    joined = join_rows(keyed, cuts, "left").withColumn("__runs", F.coalesce("__runs", empty))
    cut = joined.withColumn("__text", F.arrow_udf(_cut, "string")(F.col(text), F.col("__runs")))
    columns = [F.col("__text").alias(name) if name == text_col else F.col(sql_identifier(name)) for name in docs.columns if name != into]
    return cut.select(*columns, F.col("__runs").alias(into))


@register("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), every_place=True)
    gone = F.aggregate("dropped_runs", F.lit(0).cast("long"), lambda total, run: total + run["stop"] - run["start"])
    return cut.select(
        "doc_id",
        F.size("dropped_runs").alias("n_runs"),
        gone.alias("run_lines"),
        F.coalesce(F.octet_length("text"), F.lit(0)).alias("kept_bytes"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
    )
