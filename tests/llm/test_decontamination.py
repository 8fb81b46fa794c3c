from llm import decontamination as clean

ITEMS = [
    (1, "Tom has 12 apples and gives 5 apples to Anna. How many apples does Tom have after giving 5 away?"),
    (2, "Plain literal words only here without any slot at all for this item"),
    (3, "Short five word item here"),
    (4, "tiny"),
    (5, "1 2 3 4 5 6 7 8 9 10"),
    (6, "A train drives 3.5 km in 20 minutes and then stops for good at the old station"),
    (7, None),
]
DOCS = [
    (10, "Before. Tom has 12 apples and gives 5 apples to Anna. How many apples does Tom have after giving 5 away? After."),
    (11, "Then Ben has 30 apples and gives 7 apples to Mary. How many apples does Ben have after giving 7 away? Yes."),
    (12, "Then Ben has 30 apples and gives 7 apples to Mary. How many apples does Lea have after giving 9 away? No."),
    (13, "x PLAIN Literal, words only; here without any slot at all for this item y"),
    (14, "Nothing to see in this text, which has the words plain literal words only and no more."),
    (15, "Here is a Short five word item here."),
    (16, "tiny"),
    (17, "1 2 3 4 5 6 7 8 9 10 11"),
    (18, "11 12 13 14 15 16 17 18 19 20 21"),
    (19, "The train drives 1,250 miles in 3 hours and then stops for good at the old station"),
    (20, ""),
    (21, None),
    (13, "x PLAIN Literal, words only; here without any slot at all for this item y"),
    (None, "plain literal words only here without any slot at all for this item"),
]
WANT = {(10, 1, "exact"), (11, 1, "reparameterised"), (13, 2, "exact"), (15, 3, "exact"), (17, 5, "exact"), (19, 6, "reparameterised"), (None, 2, "exact")}


def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 as item_id", "'k' as key", "'w' as words")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "2 as doc_id", "3 as literals")


def test_exact_and_changed_questions(spark):
    docs, items = tables(spark)
    rows = [(r.doc_id, r.item_id, r.kind) for r in clean.leaks(docs, items).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == WANT


def test_shuffle_join_finds_the_same(spark):
    docs, items = tables(spark)
    assert {(r.doc_id, r.item_id, r.kind) for r in clean.leaks(docs, items, broadcast_bytes=0).collect()} == WANT


def test_filter_keeps_clean_rows(spark):
    docs, items = tables(spark)
    kept = clean.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [12, 14, 16, 18, 20, 21]


def test_empty_tables(spark):
    docs, items = tables(spark)
    assert clean.leaks(docs.limit(0), items).count() == 0
    assert clean.leaks(docs, items.limit(0)).count() == 0
    assert clean.decontaminate(docs, items.limit(0)).count() == len(DOCS)


def test_query_against_plain_search(spark):
    """On the given tables: exactly the documents in which an item's words stand in a row."""
    import re

    folder = "/root/testdata/sf0.01"
    words = lambda text: " " + " ".join(re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+", text.lower())) + " "
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = set()
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        text = words(row.text)
        want |= {(row.doc_id, item_id) for item_id, item in items if item in text}
    got = {(r.doc_id, r.item_id) for r in clean.op4_decontamination(spark, folder).collect()}
    assert want and got == want


def test_no_python_and_broadcast(spark):
    docs, items = tables(spark)
    plan = clean.leaks(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert "BroadcastHashJoin" in plan


def _found(spark, docs, items, **settings):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r.doc_id, r.item_id): r for r in clean.leaks(docs, spark.createDataFrame(items, "item_id long, text string"), **settings).collect()}


def test_copies_in_other_case_and_punctuation(spark):
    text = ITEMS[0][1]
    docs = [(1, f"see {text.lower()} so"), (2, text.upper()), (3, text.replace(".", "").replace("?", "")), (4, text.replace(" ", ". "))]
    got = _found(spark, docs, ITEMS[:1])
    assert {key: (r.kind, r.n_windows, r.item_windows) for key, r in got.items()} == {(i, 1): ("exact", 13, 13) for i in (1, 2, 3, 4)}


def test_one_changed_value_leaves_the_equal_windows(spark):
    item = "Tom buys 12 red apples at the old market on a very cold winter morning and later he sells all of the 12 apples again"
    docs = [(1, item.replace("the 12", "the 13")), (2, item.replace("12", "13")), (3, "Tom buys 7 red apples at the old market, and sells all of the 9 apples again")]
    got = _found(spark, docs, [(1, item)])
    # by hand: 18 windows, of which 15 end before the second number
    assert {key: (r.kind, r.n_windows, r.n_changed) for key, r in got.items()} == {(1, 1): ("exact", 15, 0), (2, 1): ("reparameterised", 18, 1)}


def test_runs_of_words_and_short_items(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    cut = lambda low, n: "start " + " ".join(words[low : low + n]) + " stop"
    items = [(1, " ".join(words)), (2, "Blue whale"), (3, "..."), (4, "yes"), (5, "Who wrote the old red book?")]
    docs = [(1, cut(50, 80)), (2, cut(287, 13)), (3, cut(20, 12)), (4, "a BLUE, whale swims"), (5, "blue and whale"), (6, "Yes"), (7, "..."), (8, "who wrote the old red book")]
    docs.append((9, cut(0, 10) + " " + cut(100, 10)))
    want = {(1, 1): ("exact", 73), (2, 1): ("exact", 6), (8, 5): ("exact", 1)}
    assert {key: (r.kind, r.n_windows) for key, r in _found(spark, docs, items).items()} == want
    want |= {(4, 2): ("short", 1), (6, 4): ("short", 1)}
    assert {key: (r.kind, r.n_windows) for key, r in _found(spark, docs, items, short_items=True).items()} == want


OPENING = [
    (1, "Tom has 12 apples in his basket. Tom gives 5 apples to Mary. How many apples are left in the basket?"),
    (2, "Alice bought 3 pens. Bob bought 4 pens. How many pens did both of them buy in all?"),
    (3, "The Nile is 6650 km long. Sarah walks 20 km a day along it. After how many days is she at its end?"),
]


def test_names_that_open_sentences(spark):
    docs = [
        (11, "Ben has 30 apples in his basket. Ben gives 7 apples to Lea. How many apples are left in the basket?"),
        (12, "Carla bought 8 pens. Dave bought 9 pens. How many pens did both of them buy in all?"),
        (13, "The Rhine is 1230 km long. Peter walks 30 km a day along it. After how many days is she at its end?"),
        # one name for two people, and two names for one
        (21, "Ben has 30 apples in his basket. Lea gives 7 apples to Mary. Nothing else of it."),
        (22, "Carla bought nothing. Dave bought bread. How much did both of them pay for it?"),
    ]
    got = _found(spark, docs, OPENING)
    assert {key: r.kind for key, r in got.items()} == {(10 + i, i): "reparameterised" for i in (1, 2, 3)}


def test_questions_with_other_values(spark):
    """Sixty written questions of twelve shapes, each asked again with other names, numbers and units: nine of ten or more found, no other."""
    import random

    shapes = [
        "{A} has {n} apples in the basket. {A} gives {m} apples to {B}. How many apples are left in the basket?",
        "{A} bought {n} pens. {B} bought {m} pens. How many pens did both of them buy in all?",
        "A train leaves {C} at {n} km an hour and another leaves {D} at {m} km an hour. When do they meet?",
        "{A} is {n} years old. {B} is twice as old as {A}. How old will {B} be in {m} years?",
        "If {n} workers build a wall in {m} days, how long do half as many workers need for the same wall?",
        "{A}, {B} and {C} share {n} marbles so that {A} gets {m} more than {B}. How many does {C} get?",
        "The shop of {A} sells {n} cakes a day. On Sunday {B} buys {m} of them. How many cakes stay on the shelf?",
        "A tank holds {n} liters of water. Every hour {m} liters run out of it. After how many hours is it empty?",
        "{A} reads {n} pages. Then {B} reads {m} pages. Who of the two has read more, and by how much?",
        "How far is it from {C} to {D} if a cyclist needs {n} hours at a speed of {m} km an hour?",
        "{A} pays {n} dollars for a coat and {m} dollars for a hat. What does {A} pay for both together?",
        "In the garden of {A} stand {n} trees. {B} plants {m} more. How many trees are there in the end?",
    ]
    people = "Alma Boris Clara Dan Edith Fritz Greta Hugo Ida Jonas Karla Leo Mona Nils Olga Paul".split()
    towns = "Aachen Bremen Chemnitz Dresden Erfurt Fulda Gotha Halle".split()
    rng = random.Random(17)

    def ask(shape):
        (a, b), (c, d), (n, m) = rng.sample(people, 2), rng.sample(towns, 2), rng.sample(range(2, 5000), 2)
        return shape.format(A=a, B=b, C=c, D=d, n=n, m=m)

    items = [(i, ask(shape)) for i, shape in enumerate(shapes * 5)]
    docs = [(i, f"Some words before. {ask(shape)} Some words after.") for i, shape in enumerate(shapes)]
    docs += [(100 + i, " ".join(sorted(text.split()))) for i, (_, text) in enumerate(items)]
    pairs = set(_found(spark, docs, items))
    # questions of one shape are the same question, whatever their values
    want = {(i, j) for i in range(12) for j in range(60) if j % 12 == i}
    assert len(pairs & want) >= 0.9 * len(want) and not pairs - want


def test_long_text_by_shuffle(spark):
    """No broadcast of any kind, one text of 20,000 words."""
    words = " ".join(f"w{i % 977}x" for i in range(20_000))
    docs = [(1, f"{words}. {OPENING[0][1]} {words}"), (2, words)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = clean.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(OPENING, "item_id long, text string"), broadcast_bytes=0)
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert [(r.doc_id, r.item_id, r.kind) for r in df.collect()] == [(1, 1, "exact")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
