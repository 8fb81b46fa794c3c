import random
import zlib

import numpy as np

from llm import line_dedup as dedup


def expected(rows, least):
    """Windows compared text by text, matches extended line by line."""
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    lines = {i: [line.strip() for line in (rows[i][1] or "").split("\n") if line.strip()] for i in order}
    first, gone = {}, {i: set() for i in order}
    for i in order:
        for stop in range(1, len(lines[i]) + 1):
            start, n = stop, 0
            while start and n < least:
                start -= 1
                n += len(lines[i][start].split())
            if n < least:
                continue
            run = tuple(lines[i][start:stop])
            if run not in first:
                first[run] = (i, start)
                continue
            j, other = first[run]
            a, b, c = start, stop, other
            while a and c and lines[i][a - 1] == lines[j][c - 1]:
                a, c = a - 1, c - 1
            d = other + stop - start
            while b < len(lines[i]) and d < len(lines[j]) and lines[i][b] == lines[j][d]:
                b, d = b + 1, d + 1
            gone[i] |= set(range(a, b))
    return gone


def corpus(seed):
    rng = random.Random(seed)
    pool = [" ".join("w%d" % rng.randrange(500) for _ in range(rng.choice([1, 2, 3, 5, 12]))) for _ in range(60)]
    passages = [[rng.choice(pool) for _ in range(rng.randrange(1, 9))] for _ in range(8)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            lines += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(pool)]
            if rng.random() < 0.2:
                lines.append(rng.choice(["", "  "]))
        rows.append((i, "\n".join(lines)))
    return rows


def test_as_line_by_line(spark):
    for seed in (1, 2):
        rows = corpus(seed) + [(1000, None), (1001, ""), (1002, "\n\n")]
        want = expected(rows, 10)
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id % 3 as d", "'x' as line").repartition(4)
        got = dedup.dedup_lines(docs, least_words=10)
        assert got.columns == [*docs.columns, "dropped_runs"]
        some = 0
        for row in got.collect():
            gone = {line for run in row.dropped_runs for line in range(run.start, run.stop)}
            assert gone == want[_index(rows, row.doc_id)], row.doc_id
            some += len(gone)
            text = dict(rows)[row.doc_id]
            if text is None:
                assert row.text is None
            else:
                assert row.text == _without(text, gone)
        assert some > 50


def _index(rows, doc_id):
    return [r[0] for r in rows].index(doc_id)


def _without(text, gone):
    kept, number = [], 0
    for line in text.split("\n"):
        if not line.strip():
            kept.append(line)
        else:
            if number not in gone:
                kept.append(line)
            number += 1
    return "\n".join(kept)


def test_one_copy_of_equal_rows_stays(spark):
    long = " ".join(map(str, range(60)))
    rows = [(1, long)] * 3 + [(None, long), (5, f"a\n{long}\nb"), (6, f"{long}\n{long}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in dedup.dedup_lines(docs).collect())
    assert got == [(0, long), (1, ""), (1, ""), (1, ""), (5, "a\nb"), (6, "")]


def test_guarantee():
    """Equal runs of enough words share a chosen line and window, whatever stands around them."""
    rng = random.Random(5)
    for _ in range(200):
        run = [rng.randrange(2**63) for _ in range(rng.randrange(1, 8))]
        words = [rng.randrange(1, 20) for _ in run]
        if sum(words) < 20:
            continue
        found = []
        for _ in range(2):
            left, right = rng.randrange(4), rng.randrange(4)
            hashes = np.array([rng.randrange(2**63) for _ in range(left)] + run + [rng.randrange(2**63) for _ in range(right)], np.uint64)
            counts = np.array([rng.randrange(1, 20) for _ in range(left)] + words + [rng.randrange(1, 20) for _ in range(right)])
            chosen, marks, runs = dedup.winnow(hashes, counts, 20)
            found.append(set(zip(marks.tolist(), runs.tolist())))
        assert found[0] & found[1]


def test_query_on_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = expected(rows, dedup.LEAST_WORDS)
    texts = dict(rows)
    got = {r.doc_id: r for r in dedup.op3_line_dedup(spark, folder).collect()}
    for i, (doc_id, text) in enumerate(rows):
        assert got[doc_id].text_crc32 == zlib.crc32(_without(texts[doc_id], want[i]).encode())


def test_empty_table(spark):
    assert dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def expected_of_any_place(rows, least):
    """Every run of enough words, compared with all places before it."""
    seen, gone = set(), []
    for _, text in rows:
        lines = [line.strip() for line in (text or "").split("\n") if line.strip()]
        gone.append(set())
        for start in range(len(lines)):
            for stop in range(start + 1, len(lines) + 1):
                run = tuple(lines[start:stop])
                if sum(len(line.split()) for line in run) >= least:
                    if run in seen:
                        gone[-1] |= set(range(start, stop))
                    seen.add(run)
    return gone


def test_every_earlier_place(spark):
    """A heading that only a later copy has goes too, as any run that stands before."""
    passage, heading = " ".join(map(str, range(60))), "a heading of five words"
    by_hand = [(0, passage), (1, f"{heading}\n{passage}"), (2, f"{heading}\n{passage}\nend"), (3, f"{passage}\nend")]
    for rows, least, want in ((by_hand, 50, [set(), {1}, {0, 1}, {0, 1}]), *((rows, 10, expected_of_any_place(rows, 10)) for rows in (corpus(1), corpus(2)))):
        assert want == expected_of_any_place(rows, least)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        for row in dedup.dedup_lines(docs, least_words=least, every_place=True).collect():
            gone = [line for run in row.dropped_runs for line in range(run.start, run.stop)]
            assert len(gone) == len(set(gone)) and set(gone) == want[row.doc_id], row.doc_id
            assert row.text == _without(rows[row.doc_id][1], gone)


def test_query_takes_every_place(spark):
    import tempfile

    folder, passage = tempfile.mkdtemp(), " ".join(map(str, range(60)))
    spark.createDataFrame([(0, passage), (1, f"h\n{passage}"), (2, f"h\n{passage}")], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    assert sorted((r.doc_id, r.n_runs, r.run_lines) for r in dedup.op3_line_dedup(spark, folder).collect()) == [(0, 0, 0), (1, 1, 1), (2, 1, 2)]


def test_empty_table_of_every_place(spark):
    assert dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string"), every_place=True).count() == 0


def test_choices_of_windows_one_by_one():
    """Bounds, choices and extensions of documents back to back against a search line by line."""
    rng = random.Random(11)
    for _ in range(60):
        sizes = [rng.randrange(0, 12) for _ in range(5)]
        hashes = np.array([rng.randrange(6) for _ in range(sum(sizes))], np.uint64)
        words = np.array([rng.choice([1, 2, 5, 20]) for _ in hashes], np.int64)
        firsts = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
        order = dedup.wordkernel.mix(hashes)
        want, runs = [], set()
        for stop in range(1, len(hashes) + 1):
            low = firsts[stop - 1]
            start = next((k for k in range(stop - 1, low - 1, -1) if words[k:stop].sum() >= 10), None)
            if start is None:
                continue
            want.append(max(range(start, stop), key=lambda k: (-int(order[k]), k)))
            runs |= {(k, stop) for k in range(low, start + 1) if k == start or words[k : stop - 1].sum() < 10}
        assert dedup.winnow(hashes, words, 10, firsts)[0].tolist() == want
        starts, stops, *_ = dedup.extended_windows(hashes, words, firsts, 10, np.ones(len(hashes), bool))
        assert len(starts) == len(runs) <= words.sum() and set(zip(starts.tolist(), stops.tolist())) == runs
        assert len(dedup.extended_windows(hashes, words, firsts, 10, np.zeros(len(hashes), bool))[0]) == 0


def test_query_takes_fingerprints(spark, monkeypatch):
    """Without a fingerprint that two places share, nothing is found: there is no other path."""
    passage = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(8))
    docs = spark.createDataFrame([(i, f"own {i}\n{passage}") for i in range(4)], "doc_id long, text string")
    lost = lambda: sum(len(r.dropped_runs) for r in dedup.dedup_lines(docs, every_place=True).collect())
    assert lost() == 3
    monkeypatch.setattr(dedup, "_fingerprints", lambda least: lambda source: (b for b in ()))
    assert lost() == 0


def test_passage_of_most_documents(spark, monkeypatch):
    """Frequent runs go by broadcast, others by shuffle, with the same result."""
    rng = random.Random(3)
    line = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    common, some = f"{line(30)}\n{line(30)}", f"{line(7)}\n{line(50)}"
    rows = [(i, f"{line(3)}\n{common}\n{line(60)}" if i % 10 else f"{some}\n{line(4)}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = expected_of_any_place(rows, 50)
    for keys in (dedup.HOT_KEYS, 3):
        monkeypatch.setattr(dedup, "HOT_KEYS", keys)
        for row in dedup.dedup_lines(docs, every_place=True).collect():
            assert {k for run in row.dropped_runs for k in range(run.start, run.stop)} == want[row.doc_id]


def test_very_long_texts(spark):
    passage = [f"line {i} of a text that is very long indeed" for i in range(100_000)]
    rows = [(1, "\n".join(passage)), (2, "first\n" + "\n".join(passage) + "\nlast"), (3, "word " * 500_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in dedup.dedup_lines(docs, every_place=True).collect()}
    assert got[2].text == "first\nlast" and [tuple(run) for run in got[2].dropped_runs] == [(1, 100_001)]
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
