import re

from llm import license_scan as scan
from llm.license_rules import RULES, Rule

TEXTS = [
    "Licensed under the Apache License, Version 2.0. Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3. Mit license mit LICENSE",
    "Licensed under CC BY-NC 4.0. CC BY 4.0 cc by cc by, CC-BY-SA",
    "SPDX-License-Identifier: GPL-2.0-or-later; LGPL v2.1, AGPLv3",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Creative Commons Attribution-ShareAlike 3.0 Unported License; creative commons non commercial",
    "mit der Lizenz von gestern, ac by cc bye; Kpache license apache licensé gnu general public licensee",
    "GNUKGENERAL gnu general\tpublic\x00license Apache\nLicense 1.1 under the BSD 3-Clause License (new BSD)",
    "mozilla public license " * 40 + "apache license " * 30,
    "",
    " \n",
    None,
    "The file is dedicated to the public domain. All rights reserved.",
]


def normal(text):
    text = (text or "").translate({65 + i: 97 + i for i in range(26)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def expected(text, rules):
    words = normal(text)
    line = " " + " ".join(words) + " "

    def places(pattern):
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", line):
            start = line[: m.start()].count(" ") - 1
            yield start, start + m.group().count(" ") + 1

    base = sorted((a, b, label) for phrase, label in scan.BASE for a, b in places(phrase))
    found = [(a, b, r.priority, i, r.label) for i, r in enumerate(rules) for a, b in places(r.pattern)]
    kept = []
    for x in found:
        inside = lambda y: y[0] <= x[0] and x[1] <= y[1]  # noqa: E731, B023
        stronger = lambda y: y[2] < x[2] or y[2] == x[2] and (y[1] - y[0] > x[1] - x[0] or y[3] < x[3])  # noqa: E731, B023
        if not any(inside(y) and stronger(y) for y in found if y is not x):
            kept.append(x)
    return len(words), base, sorted(kept)


def test_as_by_hand(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "'a' as label", "1 as base", "2 as __n")
    for row in scan.scan(docs).collect():
        got = row.licenses
        n, base, kept = expected(row.text, RULES)
        assert got.n_words == n, row.text
        assert sorted((b.start, b.stop, b.label) for b in got.base) == base, row.text
        assert sorted((d.start, d.stop, d.priority, d.rank, d.label) for d in got.detections) == kept, row.text


def test_labels(spark):
    rules = {r.doc_id: r for r in _query(spark).collect()}
    assert rules[0].labels == "apache,apache-2.0,mit" and rules[0].base_labels == "apache,mit" and rules[0].score == 1.0
    assert (rules[0].first_word, rules[0].last_word, rules[0].n_base) == (3, 11, 2)
    assert rules[2].labels == "cc-by,cc-by-4.0,cc-by-nc-4.0,cc-by-sa" and rules[2].n_base == 5
    assert rules[9].labels == "" and rules[9].score == 0.0 and rules[9].first_word is None
    assert rules[11].n_words == 0


def _query(spark):
    import tempfile

    folder = tempfile.mkdtemp()
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return scan.op5_license_scan(spark, folder)


def test_priorities_and_containment(spark):
    rules = [Rule(2, "wide", "alpha", "alpha beta gamma"), Rule(1, "strong", "beta", "beta"), Rule(3, "weak", "gamma", "gamma"), Rule(2, "later", "alpha", "alpha beta gamma"), Rule(2, "partial", "gamma", "gamma delta")]
    docs = spark.createDataFrame([(1, "Alpha, beta gamma delta"), (1, "Alpha, beta gamma delta")], "doc_id long, text string")
    for row in scan.scan(docs, rules).collect():
        assert [d.label for d in row.licenses.detections] == ["wide", "strong", "partial"]


def test_every_rule_holds_its_keyword():
    gate = re.compile(scan.gate_pattern(RULES))
    for rule in RULES:
        assert re.compile(rule.pattern)
        assert gate.search("a " + rule.keyword)
        # every alternative of the name holds the keyword at the start of a word
        for phrase in _samples(rule.pattern):
            assert f" {rule.keyword}" in f" {phrase}", (rule.keyword, phrase)
    assert len(RULES) > 200


def _samples(pattern):
    """Texts that a pattern matches: every alternative of every group, optional parts left out and put in."""
    import itertools

    tree = re._parser.parse(pattern)

    def texts(node):
        parts = []
        for op, value in node:
            name = str(op)
            if name == "LITERAL":
                parts.append([chr(value)])
            elif name == "SUBPATTERN":
                parts.append(texts(value[3])[:6])
            elif name == "BRANCH":
                parts.append([t for branch in value[1] for t in texts(branch)][:12])
            elif name == "MAX_REPEAT":
                inner = texts(value[2])[:2]
                parts.append(["", *inner] if value[0] == 0 else inner)
            else:
                raise ValueError(name)
        return ["".join(combination) for combination in itertools.islice(itertools.product(*parts), 300)]

    return texts(tree)


def test_base_on_given_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for row in scan.op5_license_scan(spark, folder).collect():
        n, base, kept = expected(texts[row.doc_id], [])
        assert (row.n_words, row.n_base) == (n, len(base))
        assert (row.first_word, row.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))


def test_empty_table_and_plan(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert scan.scan(docs).count() == 0
    plan = scan.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


#: SPDX ids as they stand in tags, and the label of each family.
TAGS = {
    "MIT": "mit", "MIT-0": "mit-0", "ISC": "isc", "Zlib": "zlib", "X11": "x11", "Libpng": "libpng", "EPL-1.0": "epl-1.0", "EPL-2.0": "epl-2.0",
    "CDDL-1.0": "cddl-1.0", "CDDL-1.1": "cddl-1.1", "CPL-1.0": "cpl-1.0", "Artistic-1.0": "artistic-1.0", "Artistic-2.0": "artistic-2.0",
    "BSL-1.0": "bsl-1.0", "MS-PL": "ms-pl", "MS-RL": "ms-rl", "EUPL-1.1": "eupl-1.1", "EUPL-1.2": "eupl-1.2", "OFL-1.1": "ofl-1.1",
    "PostgreSQL": "postgresql", "OpenSSL": "openssl", "NCSA": "ncsa", "Python-2.0": "python-2.0", "PHP-3.01": "php-3.01", "Ruby": "ruby",
    "Vim": "vim", "UPL-1.0": "upl-1.0", "AFL-3.0": "afl-3.0", "OSL-3.0": "osl-3.0", "ECL-2.0": "ecl-2.0", "SSPL-1.0": "sspl-1.0",
    "BUSL-1.1": "busl-1.1", "Elastic-2.0": "elastic-2.0", "ODbL-1.0": "odbl-1.0", "ODC-By-1.0": "odc-by-1.0", "PDDL-1.0": "pddl-1.0",
    "GFDL-1.1-only": "gfdl-1.1", "GFDL-1.2-or-later": "gfdl-1.2", "GFDL-1.3-only": "gfdl-1.3", "JSON": "json", "W3C": "w3c",
    "Unicode-DFS-2016": "unicode-dfs", "MulanPSL-2.0": "mulanpsl-2.0", "BlueOak-1.0.0": "blueoak-1.0.0", "MPL-1.0": "mpl-1.0",
    "MPL-1.1": "mpl-1.1", "MPL-2.0": "mpl-2.0", "Apache-1.0": "apache-1.0", "Apache-1.1": "apache-1.1", "Apache-2.0": "apache-2.0",
    "0BSD": "0bsd", "BSD-2-Clause": "bsd-2-clause", "BSD-3-Clause": "bsd-3-clause", "BSD-4-Clause": "bsd-4-clause", "GPL-1.0-only": "gpl-1.0",
    "GPL-2.0-or-later": "gpl-2.0", "GPL-3.0-only": "gpl-3.0", "LGPL-2.0-only": "lgpl-2.0", "LGPL-2.1-only": "lgpl-2.1", "LGPL-3.0-only": "lgpl-3.0",
    "AGPL-3.0-only": "agpl-3.0", "Unlicense": "unlicense", "WTFPL": "wtfpl", "Beerware": "beerware", "CECILL-2.1": "cecill-2.1",
    "CC0-1.0": "cc0-1.0", "CC-BY-4.0": "cc-by-4.0", "CC-BY-NC-SA-3.0": "cc-by-nc-sa-3.0", "PolyForm-Noncommercial-1.0.0": "polyform-nc",
}
GRANTS = [
    ("released under MIT", "mit"), ("It is MIT licensed.", "mit"), ("available under the terms of the ISC", "isc"), ("Distributed under the EPL-2.0", "epl-2.0"),
    ("licensed under Ruby", "ruby"), ("provided under the terms and conditions of BSL-1.0", "bsl-1.0"), ("available under Python 2.0", ""), ("mit der Lizenz", ""),
]


def test_tags_and_grants_of_ids(spark):
    texts = [(f"// SPDX-License-Identifier: {tag}\n", label) for tag, label in TAGS.items()] + GRANTS
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in scan.scan(docs).collect()}
    for i, (text, label) in enumerate(texts):
        assert [d.label for d in got[i].detections if d.priority == 1] == [label] * bool(label), text
        assert got[i].score == float(bool(label)), text
    # every family that has a version or a name is tagged here; the rest of creative commons differs in its parts only
    labels = {r.label for r in RULES if r.priority == 1 and not r.label.startswith("cc-")}
    assert labels - set(TAGS.values()) <= {"bsd", "gpl"}
