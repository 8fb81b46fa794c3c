"""Near-duplicate groups by a multi-index Hamming join of b-bit MinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from llm import wordkernel
from llm.frames import join_rows, read_table, require, row_key, running_totals, sheltered, shuffle_width, sql_identifier, stage
from llm.registry import register

#: Words per shingle and similarity (percent) of the pipeline and the general operator.
SHINGLE_WORDS = 5
PERCENT = 80
#: A signature has CHUNKS * CHUNK components of 16 bits.
CHUNKS, CHUNK = 12, 4
#: Components that may differ inside a chunk: these are left out of the chunk's keys, in every way.
ERRORS = 1
#: By the pigeonhole principle, of two signatures that differ in this many components or
#: fewer, some chunk differs in ERRORS at most.
MOST_DIFFERENT = CHUNKS * (ERRORS + 1) - 1
#: Members that one task compares with one hub before the hub's text is repeated.
MEMBERS_PER_SALT = 500
#: Rows of a bucket, and shingles of a family, that a task holds of either side when it compares blocks.
BUCKET_BLOCK = 2048
FAMILY_BLOCK = 2_000_000
#: Counted for every class at least, so that a block also holds a bounded number of classes.
CLASS_WEIGHT = 2000

_SIZE = CHUNKS * CHUNK
_SEEDS = wordkernel.mix(np.arange(1, _SIZE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = wordkernel.mix(_SEEDS) | np.uint64(1)
#: (chunk, components kept) of every key of a signature.
KEYS = [
    (chunk, [chunk * CHUNK + i for i in range(CHUNK) if i not in dropped])
    for chunk in range(CHUNKS)
    for dropped in combinations(range(CHUNK), ERRORS)
]


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each text: runs of ``size`` words, or all of fewer words as one."""
    for low, high in wordkernel.pieces(texts):
        words = wordkernel.Words(texts[low:high], lower=True)
        bounds = words.bounds
        for i in range(high - low):
            codes = words.code[bounds[i] : bounds[i + 1]]
            if len(codes) >= size:
                yield np.unique(wordkernel.windows(codes, size))
            elif len(codes):
                yield wordkernel.windows(codes, len(codes)) ^ np.uint64(len(codes))
            else:
                yield codes


def signature(shingles: np.ndarray) -> bytes:
    """The low 16 bits of the smallest hash under each of the signature's functions."""
    least = np.full(_SIZE, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(shingles), 8192):
        hashed = (shingles[low : low + 8192, None] ^ _SEEDS) * _FACTORS
        np.minimum(least, hashed.min(axis=0), out=least)
    return wordkernel.mix(least).astype("<u2").tobytes()


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _fingerprints(size: int, carry: tuple[str, ...]):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = [text or b"" for text in batch.column("text").cast(pa.binary()).to_pylist()]
            n, first, second, signed = [], [], [], []
            for shingles in shingle_sets(texts, size):
                n.append(len(shingles))
                first.append(int(_signed(wordkernel.mix(shingles).sum(dtype=np.uint64, keepdims=True))[0]))
                second.append(int(_signed(np.bitwise_xor.reduce(wordkernel.mix(shingles + np.uint64(7)), keepdims=True) if len(shingles) else np.zeros(1, np.uint64))[0]))
                signed.append(signature(shingles) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *[pa.array(column, pa.int64()) for column in (n, first, second)],
                    pa.array(signed, pa.binary()),
                    *[batch.column(name) for name in ("text_hash", *carry)],
                ],
                ["doc_id", "n_shingles", "set1", "set2", "signature", "text_hash", *carry],
            )

    return batches


def _keys(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        packed = batch.column("signature").to_pylist()
        parts = np.frombuffer(b"".join(packed), "<u2").reshape(len(packed), _SIZE).astype(np.int64)
        out = np.empty((len(packed), len(KEYS)), np.int64)
        for k, (_, kept) in enumerate(KEYS):
            value = np.full(len(packed), k, np.int64)
            for component in kept:
                value = (value << 16) | parts[:, component]
            out[:, k] = value
        ids = np.repeat(batch.column("c").to_numpy(zero_copy_only=False), len(KEYS))
        yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1)), pa.array(ids)], ["key", "c"])


def _near(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures differ in MOST_DIFFERENT components at most."""
    for batch in source:
        a, b = (np.frombuffer(b"".join(batch.column(name).to_pylist()), "<u2").reshape(-1, _SIZE) for name in ("sig_a", "sig_b"))
        close = (a != b).sum(axis=1) <= MOST_DIFFERENT
        yield batch.select(["a", "b"]).filter(pa.array(close))


def _verify(size: int, percent: int):
    """From rows sorted by hub, the hub's own text first: pairs that are similar on full sets."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in source:
            groups = list(zip(batch.column("a").to_pylist(), batch.column("salt").to_pylist(), strict=True))
            members = batch.column("b").to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            left, right = [], []
            for group, member, shingles in zip(groups, members, shingle_sets(texts, size), strict=True):
                if member is None:
                    hub, hub_set = group, shingles
                elif hub == group:
                    both = len(np.intersect1d(hub_set, shingles, assume_unique=True))
                    if 100 * both >= percent * (len(hub_set) + len(shingles) - both):
                        left.append(group[0])
                        right.append(member)
                else:
                    raise ValueError("a member came without its hub")
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return batches


class _Corpus:
    """Distinct shingle sets (classes) of a table, their signatures and one text each."""

    def __init__(self, docs: DataFrame, size: int, id_col: str, text_col: str, carry: tuple[str, ...]):
        text = F.col(sql_identifier(text_col))
        self.size = size
        self.texts = docs.select(text.alias("text"), F.xxhash64(text).alias("text_hash"))
        narrow = docs.select(F.col(sql_identifier(id_col)).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), *carry)
        carried = "".join(f", {name} bigint" for name in carry)
        self.documents = stage(
            narrow.mapInArrow(
                _fingerprints(size, carry),
                "doc_id bigint, n_shingles bigint, set1 bigint, set2 bigint, signature binary, text_hash bigint" + carried,
            ),
            "fingerprints",
        )
        grouped = (
            self.documents.filter("n_shingles > 0")
            .groupBy("set1", "set2", "n_shingles")
            .agg(F.min("doc_id").alias("least_id"), F.min("signature").alias("signature"), F.min("text_hash").alias("text_hash"))
        )
        # written once, so that the ids stay
        self.classes = stage(grouped.withColumn("c", F.monotonically_increasing_id()), "classes")
        self.keys = self.classes.select("signature", "c").mapInArrow(_keys, "key bigint, c bigint")

    def close(self, pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b), those under the signature distance."""
        a = self.classes.select(F.col("c").alias("a"), F.col("signature").alias("sig_a"))
        b = self.classes.select(F.col("c").alias("b"), F.col("signature").alias("sig_b"))
        return pairs.join(a, "a").join(b, "b").mapInArrow(_near, "a bigint, b bigint")

    def texts_of(self, pairs: DataFrame) -> DataFrame:
        """``c, text`` of every class in staged pairs (a, b), written once."""
        wanted = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
        hashes = wanted.join(self.classes.select("c", "text_hash"), "c")
        # equal texts are cut down to one before they move
        return stage(
            self.texts.join(hashes, "text_hash").groupBy("text_hash").agg(F.first("c").alias("c"), F.first("text").alias("text")).select("c", "text"),
            "texts",
        )

    def similar(self, pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
        """Of staged pairs (a, b), those similar on full shingle sets.

        A hub ``a`` with many members is repeated for every MEMBERS_PER_SALT of
        them on average, so no task has to take them all.
        """
        salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_SALT).cast("int").alias("salts"))
        hubs = texts.withColumnRenamed("c", "a").join(salts, "a").select(
            "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text"
        )
        members = pairs.join(salts, "a").join(texts.withColumnRenamed("c", "b"), "b").select(
            "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b", "text"
        )
        dealt = hubs.unionByName(members).repartition(shuffle_width(pairs.sparkSession), "a", "salt")
        return dealt.sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(
            _verify(self.size, percent), "a bigint, b bigint"
        )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges ``a, b``: ``c, component`` (the smallest member) for every end.

    Alternates large and small stars, one shuffle-and-join each, until nothing
    changes; every round is written to the shared folder.
    """
    current = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _digest(current)
    while True:
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stage(large, "edges")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .filter("u <> v")
            .distinct()
        )
        current = stage(small, "edges")
        now = _digest(current)
        if now == seen:
            break
        seen = now
    members = current.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "c")
    return members.union(members.select(F.col("component").alias("c"), "component").distinct())


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _block_pairs(blocks: DataFrame, group: str) -> DataFrame:
    """``group, block, i, j``: the blocks of every pair of blocks i <= j that holds two components.

    ``blocks`` has ``group, block, low, high``, the latter the least and the
    greatest component of a block.
    """
    left = blocks.select(group, F.col("block").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"))
    right = blocks.select(group, F.col("block").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    pairs = left.join(right, group).filter("i <= j AND NOT (low_i = high_i AND low_j = high_j AND low_i = low_j)")
    return pairs.select(group, F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "i", "j")


def _groups(source: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Rows of a sorted partition, cut where any of the columns changes."""
    held: list[pa.RecordBatch] = []
    for batch in source:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(name).to_numpy(zero_copy_only=False) for name in names])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(name)[0] != batch.column(name)[0] for name in names):
            yield pa.Table.from_batches(held)
            held = []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(low, high - low))
            if high < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _across_families(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a bucket under the signature distance, neither connected nor of one family, each from its first bucket."""
    for table in _groups(source, ["key", "i", "j"]):
        block, c = _column(table, "block"), _column(table, "c")
        component, family = _column(table, "component"), _column(table, "family")
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u2").reshape(-1, _SIZE)
        i, j, key = (int(_column(table, name)[0]) for name in ("i", "j", "key"))
        rows, columns = np.flatnonzero(block == i), np.flatnonzero(block == j)
        left, right = [], []
        step = max(1, (1 << 22) // max(1, len(columns)))
        for low in range(0, len(rows), step):
            some = rows[low : low + step]
            open_pair = (component[some, None] != component[columns]) & (family[some, None] != family[columns])
            if i == j:
                open_pair &= some[:, None] < columns
            a, b = np.nonzero(open_pair)
            for at in range(0, len(a), 1 << 20):
                x, y = some[a[at : at + (1 << 20)]], columns[b[at : at + (1 << 20)]]
                same = sig[x] == sig[y]
                close = same.sum(axis=1) >= _SIZE - MOST_DIFFERENT
                x, y, same = x[close], y[close], same[close].reshape(-1, CHUNKS, CHUNK)
                shares = same.sum(axis=2) >= CHUNK - ERRORS
                first = shares.argmax(axis=1)
                inside = same[np.arange(len(first)), first]
                mask = np.where(inside.all(axis=1), 0, inside.argmin(axis=1))
                mine = first * CHUNK + mask == key >> 48
                left.append(np.minimum(c[x], c[y])[mine])
                right.append(np.maximum(c[x], c[y])[mine])
        both = [np.concatenate(side) if side else np.zeros(0, np.int64) for side in (left, right)]
        yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in both], ["a", "b"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    values = [np.concatenate(side) if side else np.zeros(0, np.uint64) for side in (left, right)]
    owners = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right)]
    common = np.intersect1d(values[0], values[1])
    spots = [np.searchsorted(common, v) for v in values]
    found = [(s < len(common)) & (common[np.minimum(s, len(common) - 1)] == v) if len(common) else np.zeros(len(v), bool) for s, v in zip(spots, values, strict=True)]
    entries = []
    for spot, owner, real in zip(spots, owners, found, strict=True):
        order = np.argsort(spot[real], kind="stable")
        entries.append((spot[real][order], owner[real][order]))
    counts = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for low in range(0, len(common), width):
        sides = []
        for (spot, owner), side in zip(entries, (left, right), strict=True):
            a, b = np.searchsorted(spot, [low, low + width])
            matrix = np.zeros((len(side), min(width, len(common) - low)), np.float32)
            matrix[owner[a:b], spot[a:b] - low] = 1
            sides.append(matrix)
        counts += sides[0] @ sides[1].T
    return counts.astype(np.int64)


def _inside_families(size: int, percent: int):
    """Links between components of a family, one for every two components that a pair of blocks connects."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(source, ["family", "i", "j"]):
            block, c, component = (_column(table, name) for name in ("block", "c", "component"))
            sets = list(shingle_sets([text.encode() for text in table.column("text").to_pylist()], size))
            i, j = int(_column(table, "i")[0]), int(_column(table, "j")[0])
            rows, columns = np.flatnonzero(block == i), np.flatnonzero(block == j)
            both = overlaps([sets[k] for k in rows], [sets[k] for k in columns])
            n = np.array([len(x) for x in sets], np.int64)
            union = n[rows][:, None] + n[columns] - both
            linked = (100 * both >= percent * union) & (component[rows][:, None] != component[columns])
            x, y = np.nonzero(linked)
            ends = np.stack([np.minimum(component[rows[x]], component[columns[y]]), np.maximum(component[rows[x]], component[columns[y]])], axis=1)
            _, keep = np.unique(ends, axis=0, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(c[rows[x[keep]]], pa.int64()), pa.array(c[columns[y[keep]]], pa.int64())], ["a", "b"])

    return batches


def _family_blocks(state: DataFrame) -> DataFrame:
    """``family, block, c, component``: the classes of each family cut at equal weights along their components, in key ranges."""
    weighed = state.withColumn("weight", F.greatest(F.col("n_shingles"), F.lit(CLASS_WEIGHT)))
    placed = running_totals(weighed, ["component", "c"], ["weight"], ["family"])
    return placed.select("family", F.floor(F.col("before_weight") / FAMILY_BLOCK).cast("int").alias("block"), "c", "component")


def _links(corpus: _Corpus, percent: int) -> DataFrame:
    """Edges between classes that connect exactly the classes that similar pairs connect.

    A bucket's first class is compared with all its others, as many pairs as
    rows. What is then not connected is compared in blocks, inside tasks that
    give back links only: two classes of one family (connected by pairs under the
    signature distance, similar or not) on their full sets, two classes of
    different families by their signatures first.
    """
    spark = corpus.classes.sparkSession
    shared = stage(corpus.keys.groupBy("key").agg(F.min("c").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    busy = stage(corpus.keys.join(shared, "key").select("key", "c", "hub", "n"), "bucket-rows")
    near = stage(corpus.close(busy.filter("c <> hub").select(F.col("hub").alias("a"), F.col("c").alias("b")).distinct()), "pairs")
    texts = corpus.texts_of(near)
    edges = stage(corpus.similar(near, texts, percent), "links")
    crowded = busy.filter("n > 2").select("key", "c")
    if crowded.isEmpty():
        return edges
    state = stage(
        corpus.classes.select("c", "n_shingles")
        .join(crowded.select("c").union(texts.select("c")).distinct(), "c")
        .join(components(edges), "c", "left")
        .join(components(near).withColumnRenamed("component", "family"), "c", "left")
        .select("c", "n_shingles", F.coalesce("component", "c").alias("component"), F.coalesce("family", "c").alias("family")),
        "state",
    )
    width = shuffle_width(spark)

    # different families: buckets that hold two of them
    rows = crowded.join(state.drop("n_shingles"), "c")
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("family").alias("low"), F.max("family").alias("high")).filter("low <> high")
    blocked = stage(
        rows.join(several.select("key", F.ceil(F.col("n") / BUCKET_BLOCK).alias("blocks")), "key").withColumn(
            "block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
        ),
        "bucket-blocks",
    )
    pairs = _block_pairs(blocked.groupBy("key", "block").agg(F.min("family").alias("low"), F.max("family").alias("high")), "key")
    dealt = blocked.join(pairs, ["key", "block"]).join(corpus.classes.select("c", "signature"), "c")
    dealt = dealt.select("key", "i", "j", "block", "c", "component", "family", "signature").repartition(width, "key", "i", "j")
    fresh = stage(dealt.sortWithinPartitions("key", "i", "j").mapInArrow(_across_families, "a bigint, b bigint").distinct(), "pairs")
    across = stage(corpus.similar(fresh, corpus.texts_of(fresh), percent), "links")

    # one family: those that are not connected as a whole, in blocks along their components
    mixed = state.groupBy("family").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("family")
    members = stage(_family_blocks(state.join(mixed, "family")), "families")
    pairs = _block_pairs(members.groupBy("family", "block").agg(F.min("component").alias("low"), F.max("component").alias("high")), "family")
    dealt = members.join(pairs, ["family", "block"]).join(texts, "c")
    dealt = dealt.select("family", "i", "j", "block", "c", "component", "text").repartition(width, "family", "i", "j")
    inside = stage(
        dealt.sortWithinPartitions("family", "i", "j").mapInArrow(_inside_families(corpus.size, percent), "a bigint, b bigint"), "links"
    )
    return edges.unionByName(across).unionByName(inside)


def _grouped(docs: DataFrame, shingle_words: int, percent: int, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_shingles, group, least_id`` and the carried columns; no group without shingles."""
    require(docs, id_col, text_col)
    corpus = _Corpus(docs, shingle_words, id_col, text_col, carry)
    groups = components(_links(corpus, percent))
    named = stage(
        corpus.classes.join(groups, "c", "left")
        .withColumn("group", F.coalesce("component", "c"))
        .select("set1", "set2", "n_shingles", "least_id", "group"),
        "groups",
    )
    # only groups of several classes differ from the class's own smallest id
    several = named.groupBy("group").agg(F.min("least_id").alias("group_least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    placed = named.join(several.drop("n"), "group", "left").select(
        "set1", "set2", "n_shingles", "group", F.coalesce("group_least", "least_id").alias("least_id")
    )
    rows = corpus.documents.select("doc_id", "n_shingles", "set1", "set2", *carry)
    return rows.join(placed, ["set1", "set2", "n_shingles"], "left").select("doc_id", "n_shingles", "group", "least_id", *carry)


@sheltered
def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Groups of near-equal texts: ``doc_id, n_shingles, component_id, kept``, one row per document.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; a
    document's set is its distinct runs of ``shingle_words`` words, or all its
    words as one if there are fewer. Documents are linked if the sets overlap by
    ``percent`` or more (intersection over union). ``component_id`` is the
    smallest id reachable over links, ``kept`` marks that document.

    Equal sets form one class. Classes meet if, in some chunk of their
    signatures, all but ERRORS components agree; that is certain for signatures
    that differ in MOST_DIFFERENT components or fewer. Of these pairs each is
    checked on the full sets of hashed shingles, save pairs already connected
    over others. No bucket, group or candidate list is cut.

    Null, empty and blank texts have no shingles, are linked with nothing and
    kept. A null id never names a group that has another id; in groups of null
    ids only, the component is null and the rows count as kept. Rows that repeat
    an id are linked like any others, and all that carry their group's id count
    as kept. An empty table gives no rows; other columns are not read.
    """
    found = _grouped(docs, shingle_words, percent, id_col, text_col)
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


@sheltered
def near_dedup(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Exactly one document of each near-duplicate group, with the columns of ``docs``.

    The one with the smallest id stays; of rows with the same id, or of null ids
    only, the one with the smallest row hash. Texts without words are groups of
    their own and all stay.
    """
    key = ("__id", "__hash", "__copy")
    keyed = row_key(docs, id_col).withColumn("__copy", F.col("__copy").cast("long"))
    found = stage(_grouped(keyed, shingle_words, percent, id_col, text_col, key), "grouped")
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), *key)).alias("first")
    kept = found.filter("group IS NOT NULL").groupBy("group").agg(first).select(*[f"first.{name}" for name in key])
    kept = kept.unionByName(found.filter("group IS NULL").select(*key))
    return join_rows(keyed, kept).select(*[sql_identifier(name) for name in docs.columns])


@register("op7_near_dedup")
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=4)
