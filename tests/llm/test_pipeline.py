import re
import zlib
from collections import Counter

import corpus_pipeline
from llm import mixing, quality_rules
from test_near_dedup import expected as near_groups


def words(text):
    return re.findall(r"[^ \t-\r]+", text or "")


def measures(text):
    """The rules' counts, one text at a time."""
    text = text or ""
    found = words(text)
    runs = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    often = Counter(runs)
    repeated = {i + k for i, run in enumerate(runs) if often[run] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if words(line)]
    return {
        "n_words": len(found), "word_chars": sum(map(len, found)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated),
        "n_letter_words": sum(bool(re.search(r"[A-Za-z\x80-\U0010ffff]", w)) for w in found),
        "n_bullet_lines": sum(bool(re.match(r"[ \t-\r]*[*•-]", line)) for line in lines),
        "n_open_lines": sum(bool(re.search(r"(\.\.\.|…)[ \t-\r]*$", line)) for line in lines),
    }


def passes(m):
    few, chars, n, lines = m["n_words"] < 10, m["word_chars"], m["n_words"], m["n_lines"]
    return not (
        few or 100 * m["n_repeat_words"] > 20 * n or 100 * m["n_symbols"] > 10 * n or 100 * m["n_dup_lines"] > 40 * lines or chars < 2 * n
        or chars > 15 * n or 100 * m["n_letter_words"] < 50 * n or 100 * m["n_bullet_lines"] > 90 * lines or 100 * m["n_open_lines"] > 30 * lines
    )


def plain_words(text):
    return " " + " ".join(re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+", (text or "").lower())) + " "


def mixed(rows):
    """(doc_id, text) as often as the mix takes it."""
    size = {i: len(words(text)) for i, (_, text, _) in enumerate(rows)}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size[i] for i, r in enumerate(rows) if r[2] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    left, open_sources, target = 1.5 * sum(total.values()), set(sources), {}
    while open_sources:
        level = left / sum(weight[s] for s in open_sources)
        full = {s for s in open_sources if level * weight[s] > 2 * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_sources}
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_sources -= full
    out = []
    import hashlib

    for s in sources:
        offset = int(hashlib.md5(f"{mixing.SEED}|{int(s is None)}|{s or ''}".encode()).hexdigest()[:8], 16)
        rate = int(target[s] / total[s] * 2**32 + 0.5) if total[s] else 0
        members = sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: (size[i], rows[i][0]))
        for k, i in enumerate(members):
            out += [rows[i][:2]] * ((((k + 1) * rate + offset) >> 32) - ((k * rate + offset) >> 32))
    return out


def test_run_as_by_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = [r for r in rows if passes(measures(r[1]))]
    groups = near_groups([r[:2] for r in rows], 5)
    rows = [r for r in rows if groups[r[0]][1] == r[0]]
    items = [plain_words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(item in plain_words(r[1]) for item in items)]
    taken = sorted(mixed(rows), key=lambda r: (r[0], len(r[1].encode())))
    sizes = [len(text.encode()) + 1 for _, text in taken]
    before, want, slots = 0, [], Counter()
    for (doc_id, text), size in zip(taken, sizes):
        shard = (2 * before + size) * 16 // (2 * sum(sizes))
        want.append((doc_id, size, zlib.crc32(text.encode()), shard, slots[shard]))
        slots[shard] += 1
        before += size
    got = sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == sorted(want)


def test_ledger_counts_one_text_at_a_time(spark):
    texts = ["a b c d e a b c d e", "x\n\nx\n y \n", "* a\n- b\n• c…", "dots...\nand …  ", "%%% é# ñ|<>", "\x0b\x0c a\rb", "", None, "a " * 3000 + "é" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "7 as n_words", "'z' as ledger")
    for row in quality_rules.ledger(docs).collect():
        assert {name: row.ledger[name] for name in quality_rules.MEASURES} == measures(row.text), row.text


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.createDataFrame(
        [(1, "word " * 3 + "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11 x12 x13 x14 x15 x16 x17 x18", None, None, None, "k"), (None, None, "en", "s", 0, None)],
        "doc_id long, text string, lang string, source string, n_chars long, `__hash.x` string",
    )
    for name, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, docs, "/root/testdata/sf0.001").columns == docs.columns, name
        assert function(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0, name
    assert corpus_pipeline.sharding(spark, docs.limit(0), "").count() == 0
