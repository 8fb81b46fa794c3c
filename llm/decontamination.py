"""Benchmark decontamination on canonical templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from llm.frames import read_table, require, sheltered, sql_identifier, stage
from llm.registry import register

#: Words per template window; items with fewer words are matched as one window.
WINDOW = 8
#: Items with fewer words than this are short: looked for on request only, by exact words.
LEAST_WORDS = 4
#: This many words of an item in a row (the whole item if it has fewer), equal word for word, are a leak.
RUN_WORDS = 13
#: Windows with fewer literal words are compared by their words only.
LEAST_LITERALS = 4
#: Share of an item's windows that must be found, in percent.
COVERAGE_PERCENT = 30
#: Benchmarks whose windows take more memory than this are joined by shuffle instead of broadcast.
BROADCAST_BYTES = 256 << 20
#: Words that are units when they follow a number.
UNITS = (
    "mm cm m km kilometers kilometres meters metres miles mile feet foot inches inch yards yard "
    "mg g kg grams gram kilograms kilogram tons tonnes pounds pound ounces ounce lbs lb "
    "ml l liters litres liter litre gallons gallon cups cup "
    "ms s sec seconds second min minutes minute h hours hour days day weeks week months month years year "
    "percent degrees degree dollars dollar cents cent euros euro usd eur mph kmh kw kwh hz ghz mhz kb mb gb tb"
).split()

_LETTER = "A-Za-z\\x{80}-\\x{10FFFF}"
_END = "\u0002"
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
#: What a document's window can meet by: its words, and its templates.
FORMS = ("words", "tokens", "names")


def _marked(text: Column) -> Column:
    """Words between single blanks, sentence ends as a mark of their own."""
    text = F.coalesce(text, F.lit(""))
    # 3.5 and 1,000 stay one word; 5km and 5% become a number and a unit
    numbers = F.regexp_replace(text, "(?<=[0-9])[.,](?=[0-9])", "·")
    numbers = F.regexp_replace(numbers, "(?<=[0-9])%", " percent ")
    numbers = F.regexp_replace(numbers, f"(?<![0-9{_LETTER}])([0-9]++(?:·[0-9]++)*+)(?=[A-Za-z])", "$1 ")
    text = F.when(text.rlike("[0-9]"), numbers).otherwise(text)
    text = F.regexp_replace(text, "[.!?\\n\\x02]++", f" {_END} ")
    text = F.regexp_replace(text, f"[^0-9{_LETTER}\\x02]++", " ")
    return F.concat(F.lit(f" {_END} "), F.trim(text), F.lit(" "))


def _plain(marked: Column) -> Column:
    return F.trim(F.regexp_replace(marked, f" (?:{_END} )+", " "))


def _template(marked: Column, opening_names: bool) -> Column:
    """Numbers, units after numbers, and capitalised words as typed slots.

    A capitalised word that opens a sentence is a slot with ``opening_names`` only.
    """
    numbers = F.regexp_replace(marked, "(?<= )[0-9]++(?:·[0-9]++)*+(?= )", NUMBER)
    numbers = F.regexp_replace(numbers, f"(?<={NUMBER} )(?i:{'|'.join(UNITS)})(?= )", UNIT)
    marked = F.when(marked.rlike("[0-9]"), numbers).otherwise(marked)
    before = "(?<= )" if opening_names else f"(?<=[^ {_END}] )"
    marked = F.regexp_replace(marked, f"{before}\\p{{Lu}}\\p{{Ll}}++(?= )", NAME)
    return F.lower(_plain(marked))


def _canonical(df: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """``keep, words, tokens, names``: the words of a text and, in the same places, of its templates.

    Whether a sentence opens with a name cannot be told from its capital, so there are
    two templates: in ``tokens`` such words are literal, in ``names`` they are names.
    """
    marked = df.select(*keep, _marked(text).alias("__marked"))
    return marked.withColumns(
        {
            "words": F.split(_plain(F.col("__marked")), " "),
            "tokens": F.split(_template(F.col("__marked"), False), " "),
            "names": F.split(_template(F.col("__marked"), True), " "),
        }
    ).drop("__marked")


def _lowered(words: str) -> Column:
    return F.split(F.lower(F.concat_ws(" ", words)), " ")


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", short_items: bool = False) -> DataFrame:
    """Every window of every item, written once; items equal in id and words count once.

    Items of fewer than LEAST_WORDS words (``short``) are left out unless
    ``short_items``, and then stand as their lower-case words only.

    A window stands as its lower-case words (``verbatim``) and as each of its
    templates that has slots and LEAST_LITERALS literal words. ``hash`` is the hash of
    the words or template, over which documents' windows of ``size`` words meet it.
    """
    items = _canonical(benchmark, F.col(sql_identifier(text_col)), F.col(sql_identifier(id_col)).alias("item_id")).distinct()
    # a text without words splits into one empty word
    least = F.lit(1 if short_items else LEAST_WORDS)
    items = items.withColumn("n_words", F.size("words")).filter((F.col("n_words") >= least) & (F.element_at("words", 1) != ""))
    short = (F.col("n_words") < LEAST_WORDS).alias("short")
    size = F.least(F.col("n_words"), F.lit(WINDOW))
    starts = F.explode(F.sequence(F.lit(1), F.col("n_words") - size + 1)).alias("start")
    placed = items.select("*", size.alias("size"), (F.col("n_words") - size + 1).alias("item_windows"), starts)
    rows = placed.select(
        "item_id",
        "size",
        "item_windows",
        short,
        (F.col("start") - 1).alias("item_position"),
        F.slice("words", F.col("start"), F.col("size")).alias("item_words"),
        *[F.slice(form, F.col("start"), F.col("size")).alias(form) for form in ("tokens", "names")],
    )
    templates = rows.withColumn("template", F.explode(F.array_distinct(F.array("tokens", "names"))))
    literals = F.size(F.filter("template", lambda w: ~w.startswith("<")))
    typed = templates.filter(~F.col("short") & (literals >= LEAST_LITERALS) & (literals < F.col("size")))
    forms = typed.withColumns({"verbatim": F.lit(False), "window": F.col("template")}).unionByName(
        rows.withColumns({"verbatim": F.lit(True), "template": F.col("tokens"), "window": _lowered("item_words")})
    )
    table = forms.select(
        "item_id", "size", "item_windows", "short", "item_position", "verbatim",
        _lowered("item_words").alias("item_words"),
        F.concat_ws(" ", "template").alias("template"),
        F.concat_ws(" ", "window").alias("window"),
        F.xxhash64("window").alias("hash"),
    )
    return stage(table, "benchmark-windows")


def _fits(windows: DataFrame, most_bytes: int) -> bool:
    """Whether the windows take ``most_bytes`` of memory at most, overheads included."""
    texts = F.octet_length("template") + F.octet_length("window") + 4 * F.octet_length(F.concat_ws(" ", "item_words")) + 300
    return (windows.agg(F.sum(texts.cast("long"))).first()[0] or 0) <= most_bytes


def _met_windows(canonical: DataFrame, windows: DataFrame, most_bytes: int) -> DataFrame:
    """The documents' windows that equal a benchmark window in words or template, beside it.

    Every window of a document is hashed in its three forms, for each size the
    benchmark has (WINDOW, and fewer words for its short items). Small benchmarks
    are broadcast to the texts. For others only positions and hashes are shuffled,
    and the words of the texts that met a window are fetched afterwards.
    """
    places = ["doc_id", "text_hash", "position", "form", "hash"]
    # at most two rows per size
    wanted = windows.select("size", "verbatim").distinct().collect()
    sizes = {form: sorted({row.size for row in wanted if row.verbatim == (form == "words")}) for form in FORMS}
    # an outer explode: for an inner one, Spark would put the texts into words twice to see if there are any
    spread = canonical.select("*", F.posexplode_outer("words").alias("position", "word"))
    inside = lambda size: F.col("position") + size <= F.size("words")
    hashed = spread.withColumns(
        {f"{form}{size}": F.xxhash64(F.slice(form, F.col("position") + 1, F.lit(size))) for form in FORMS for size in sizes[form]}
    )
    marks = []
    for form in FORMS:
        for size in sizes[form]:
            # a template without slots is the words, and without opening names the other template
            fresh = {"words": F.lit(True), "tokens": F.col(f"tokens{size}") != F.col(f"words{size}"), "names": F.col(f"names{size}") != F.col(f"tokens{size}")}
            known = fresh[form] if size in sizes["words"] else F.lit(True)
            marks.append(F.struct(F.lit(form).alias("form"), F.when(inside(size) & known, F.col(f"{form}{size}")).alias("hash")))
    if not marks:
        marks = [F.struct(F.lit("words").alias("form"), F.lit(None).cast("long").alias("hash"))]
    marked = hashed.withColumn("mark", F.explode(F.array(*marks))).withColumns({"form": F.col("mark.form"), "hash": F.col("mark.hash")})
    marked = marked.select(*places, *FORMS).filter("hash IS NOT NULL")
    if _fits(windows, most_bytes):
        met = marked.join(F.broadcast(windows), "hash")
    else:
        known = stage(marked.select(*places).join(windows.select("hash").distinct(), "hash"), "met-places")
        texts = canonical.select("text_hash", *FORMS).join(known.select("text_hash").distinct(), "text_hash", "left_semi")
        met = known.join(windows, "hash").join(texts.dropDuplicates(["text_hash"]), "text_hash")
    cut = lambda column: F.slice(column, F.col("position") + 1, F.col("size"))
    form = F.when(F.col("form") == "words", F.concat_ws(" ", cut("words"))).when(F.col("form") == "tokens", F.concat_ws(" ", cut("tokens")))
    same = form.otherwise(F.concat_ws(" ", cut("names"))) == F.col("window")
    return met.filter(same & (F.col("verbatim") == (F.col("form") == "words"))).withColumn("doc_words", cut("words")).drop(*FORMS)


@sheltered
def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    coverage_percent: int = COVERAGE_PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
    short_items: bool = False,
) -> DataFrame:
    """Benchmark items that stand in documents, one row per document and item.

    Returns ``doc_id, text_hash, item_id, n_windows, item_windows, n_slots,
    n_changed, kind``. Texts are cut into words; numbers, units after numbers and
    capitalised words become typed slots, the rest lower case; capitalised words that
    open a sentence are tried as names and as literal words, all of a window alike.
    Every document window is looked up among the benchmark's by its hash: that of its
    lower-case words, whatever their case and punctuation, and those of its
    templates. Hits on one
    alignment of document and item (same distance of positions) are taken
    together. Windows whose words equal the item's always count, those that match
    by template alone if each slot value of the item stands for one value in the
    document throughout the alignment. ``kind`` is ``exact`` if no slot value
    differs in the windows that count, else ``reparameterised``. A leak needs
    ``coverage_percent`` of the item's windows, or RUN_WORDS words in a row (the
    whole item if it has fewer) that equal the item's.

    Null and empty texts hold no item. Items of fewer than LEAST_WORDS words, which
    stand in many documents by chance, are found only with ``short_items``, by their
    exact words and as kind ``short``. Very long texts take no more memory than their
    words; null ids are kept as such. Rows equal in id and text give one
    row per item. Empty tables on either side give no rows. Other columns of both
    tables are not read.
    """
    require(docs, id_col, text_col)
    require(benchmark, item_id_col, item_text_col)
    items = benchmark_windows(benchmark, item_id_col, item_text_col, short_items)
    text = F.col(sql_identifier(text_col))
    canonical = _canonical(docs, text, F.col(sql_identifier(id_col)).alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    hits = _met_windows(canonical.withColumn("words", _lowered("words")), items, broadcast_bytes).select(
        "doc_id", "text_hash", "item_id", "item_windows", "short", "item_position", (F.col("position") - F.col("item_position")).alias("shift"),
        "verbatim", F.struct("verbatim", "template", "item_words", "doc_words").alias("met"),
    )
    # one row per alignment: bounded by the item's own windows
    gathered = hits.groupBy("doc_id", "text_hash", "item_id", "item_windows", "short", "shift").agg(
        F.collect_set("item_position").alias("all_places"),
        F.collect_set(F.when(F.col("verbatim"), F.col("item_position"))).alias("verbatim_places"),
        F.collect_set("met").alias("met"),
    )
    slots = lambda met: F.array_distinct(F.flatten(F.transform(met, lambda m: _slots(F.split(m["template"], " "), m["item_words"], m["doc_words"]))))
    aligned = gathered.withColumns({"all_pairs": slots(F.col("met")), "verbatim_pairs": slots(F.filter("met", lambda m: m["verbatim"]))})
    givers = F.size(F.array_distinct(F.transform("all_pairs", lambda p: F.struct(p["type"], p["item"]))))
    consistent = givers == F.size("all_pairs")
    counted = aligned.withColumns(
        {name: F.when(consistent, F.col(f"all_{name}")).otherwise(F.col(f"verbatim_{name}")) for name in ("places", "pairs")}
    ).filter(F.size("places") > 0)
    # windows in a row that make up RUN_WORDS words
    least_run = F.least(F.lit(RUN_WORDS - WINDOW + 1), F.col("item_windows"))
    in_order = counted.withColumns({"verbatim_places": F.array_sort("verbatim_places"), "least_run": least_run})
    run_ends = F.filter("verbatim_places", lambda place, i: F.get("verbatim_places", i + F.col("least_run") - 1) == place + F.col("least_run") - 1)
    # an item interrupted by other words stands on several alignments
    whole = in_order.withColumn("run", F.size(run_ends) > 0).groupBy("doc_id", "text_hash", "item_id", "item_windows", "short").agg(
        F.max("run").alias("run"),
        F.sum(F.size("places")).alias("n"),
        F.sum(F.size("pairs")).alias("n_slots"),
        F.sum(F.size(F.filter("pairs", lambda p: p["item"] != p["doc"]))).alias("n_changed"),
    )
    return whole.filter(F.col("run") | (100 * F.col("n") >= coverage_percent * F.col("item_windows"))).select(
        "doc_id",
        "text_hash",
        "item_id",
        F.least("n", F.col("item_windows").cast("long")).alias("n_windows"),
        F.col("item_windows").cast("long").alias("item_windows"),
        "n_slots",
        "n_changed",
        F.when(F.col("short"), "short").when(F.col("n_changed") == 0, "exact").otherwise("reparameterised").alias("kind"),
    )


def _slots(window: Column, item: Column, doc: Column) -> Column:
    """(type, item's value, document's value) of each slot in a window."""
    zipped = F.arrays_zip(window.alias("t"), item.alias("i"), doc.alias("d"))
    slots = F.filter(zipped, lambda z: z["t"].startswith("<"))
    return F.transform(slots, lambda z: F.struct(z["t"].alias("type"), z["i"].alias("item"), z["d"].alias("doc")))


@sheltered
def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents that hold no benchmark item, with the columns of ``docs``."""
    found = leaks(docs, benchmark, id_col=id_col, text_col=text_col, **settings)
    bad = stage(found.select(F.col("text_hash").alias("__bad")).distinct(), "leaking-texts")
    hashed = docs.withColumn("__text_hash", F.xxhash64(sql_identifier(text_col)))
    return hashed.join(bad, F.col("__text_hash") == F.col("__bad"), "left_anti").select(*[sql_identifier(name) for name in docs.columns])


@register("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), short_items=True)
    return found.drop("text_hash")
