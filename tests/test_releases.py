import pytest
from pyspark.sql import functions as F

from findrisk.operators import prompts, releases

COLUMNS = "finding_id string, repo string, release string, cve_id string, risk_score double, tier string, package_name string, primary_cwe string, user_action string, has_patch int"


def table(spark, rows):
    full = [(f"f{i}", repo, release, cve, risk, "HIGH" if risk > 0.6 else "LOW", "p", cwe, "fixed" if i % 2 else "open", i % 2) for i, (repo, release, cve, risk, cwe) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)


@pytest.fixture(scope="module")
def ranked(spark):
    return table(
        spark,
        [
            ("a", "v1", "C1", 0.9, "CWE-1"), ("a", "v1", "C2", 0.5, "CWE-2"),
            ("a", "v10", "C9", 0.1, "CWE-9"),
            ("a", "v2", "C2", 0.7, "CWE-2"), ("a", "v2", "C3", 0.8, "CWE-3"), ("a", "v2", "C3", 0.2, "CWE-3"),
            ("one", "v1", "C1", 0.3, "CWE-1"), ("none", None, "C1", 0.3, "CWE-1"),
        ],
    )


def test_default_pair_is_textual_order(ranked):
    pair = releases.release_pairs(ranked).collect()
    assert [(p.repo, p.current_release, p.previous_release, p.n_releases) for p in pair] == [("a", "v2", "v10", 3)]


def test_version_order(ranked):
    pair = releases.release_pairs(ranked, order="version").first()
    assert (pair.current_release, pair.previous_release) == ("v10", "v2")


def test_named_releases(ranked):
    first = releases.release_pairs(ranked, current="v1").first()
    assert (first.current_release, first.previous_release) == ("v1", "v1")
    both = releases.release_pairs(ranked, current="v2", previous="v1").first()
    assert (both.current_release, both.previous_release) == ("v2", "v1")
    assert releases.release_pairs(ranked, current="v2", previous="v7").count() == 0


def test_eligibility(ranked):
    reasons = {r.repo: r.reject_reason for r in releases.release_eligibility(ranked).collect()}
    assert reasons == {"a": None, "one": "needs at least two releases", "none": "no release data"}
    named = {r.repo: r.reject_reason for r in releases.release_eligibility(ranked, current="v7").collect()}
    assert named["a"] == "current release not found"


def test_delta_against_itself_is_zero(ranked):
    delta = releases.release_delta(ranked, releases.release_pairs(ranked, current="v1")).first()
    assert (delta.vuln_count_change, delta.avg_risk_change, delta.new_cve_count, delta.resolved_cve_count) == (0, 0.0, 0, 0)


def test_delta_new_and_resolved(ranked):
    pairs = releases.release_pairs(ranked, current="v2", previous="v1")
    delta = releases.release_delta(ranked, pairs).first()
    assert (delta.vuln_count_change, delta.vuln_count_change_pct, delta.new_cve_count, delta.resolved_cve_count) == (1, 0.5, 1, 1)
    assert [(r.rank, r.cve_id, r.risk_score) for r in releases.new_cves(ranked, pairs).orderBy("rank").collect()] == [(1, "C3", 0.8), (2, "C3", 0.2)]
    assert [r.cve_id for r in releases.resolved_cves(ranked, pairs).collect()] == ["C1"]
    assert [r.cwe for r in releases.new_cwes(ranked, pairs).collect()] == ["CWE-3"]
    assert [r.cwe for r in releases.resolved_cwes(ranked, pairs).collect()] == ["CWE-1"]


def test_sets_add_up(ranked):
    """New and common CVEs together are the CVEs of the current release."""
    pairs = releases.release_pairs(ranked, current="v2", previous="v1")
    rows = releases.compared_rows(ranked, pairs)
    current = {r.cve_id for r in rows.filter("release = current_release").collect()}
    previous = {r.cve_id for r in rows.filter("release = previous_release").collect()}
    counts = releases.changed_cve_counts(rows).first()
    assert counts.new_cve_count + len(current & previous) == len(current)


def test_one_cve_with_very_many_rows_is_ranked_right(spark):
    """The cut per CVE must not lose rows of other CVEs or change the order."""
    rows = [("a", "v2", "HOT", 0.2 + (i % 50) / 100, "CWE-1") for i in range(3000)] + [("a", "v2", f"C{i}", 0.69, "CWE-1") for i in range(4)]
    ranked = table(spark, rows + [("a", "v1", "OLD", 0.5, "CWE-1")])
    found = [(r.cve_id, r.risk_score) for r in releases.new_cves(ranked).orderBy("rank").collect()]
    brute = ranked.filter("release = 'v2'").orderBy(F.desc("risk_score"), "finding_id").limit(10).collect()
    assert found == [(r.cve_id, r.risk_score) for r in brute]


def test_release_prompt_says_what_changed(ranked):
    pairs = releases.release_pairs(ranked, current="v2", previous="v1")
    text = prompts.release_prompts(ranked, pairs).first().prompt
    for part in ("# Repository: a", "# Current release: v2", "Findings: +1 (50.0%)", "New weaknesses: CWE-3", "Resolved weaknesses: CWE-1", "  - C3: 0.800 (HIGH), package p"):
        assert part in text


def _history(spark, n_releases=140, seed=5):
    """Many releases per repo, so that bit sets span several words, and gaps in every column."""
    import random

    rng = random.Random(seed)
    rows = []
    for repo in ("a", "b", None):
        for k in range(n_releases if repo == "a" else 3):
            for _ in range(rng.randrange(1, 6)):
                cve = rng.choice([None, *[f"C{i}" for i in range(12)]])
                rows.append((repo, rng.choice([f"v{k:03d}"] * 9 + [None]), cve, rng.randrange(100) / 100, rng.choice([None, "CWE-1", "CWE-2", "CWE-3"])))
    return table(spark, rows), rows


def test_bit_sets_answer_for_any_pair(spark):
    ranked, rows = _history(spark)
    sets = releases.release_sets(ranked, "cve_id")
    assert sets.sets.agg(F.max("word")).first()[0] >= 1
    held = {}
    for repo, release, cve, _, _ in rows:
        if repo and release:
            held.setdefault((repo, release), set()).update({cve} - {None})
    listed = {repo: sorted(release for r, release in held if r == repo) for repo in ("a", "b")}
    for current, previous in ((70, 3), (64, 63), (63, 64), (5, 5), (len(listed["a"]) - 1, 0)):
        pair = spark.createDataFrame([("a", listed["a"][current], listed["a"][previous])], "repo string, current_release string, previous_release string")
        found = {r.value: (r.in_current, r.in_previous) for r in releases.changes(sets, pair).collect()}
        now, then = held["a", listed["a"][current]], held["a", listed["a"][previous]]
        assert {v for v, (c, p) in found.items() if c and not p} == now - then
        assert {v for v, (c, p) in found.items() if p and not c} == then - now
    churn = {(r.repo, r.release): (r.before, r.held, r.new, r.resolved) for r in releases.release_churn(sets).collect()}
    want = {}
    for repo, names in listed.items():
        for before, release in zip(names, names[1:]):
            now, then = held[repo, release], held[repo, before]
            want[repo, release] = (before, len(now), len(now - then), len(then - now))
    assert churn == want


def test_sets_by_shuffle_and_by_broadcast_agree(spark):
    ranked, _ = _history(spark, 20)
    one, other = releases.release_sets(ranked, "cve_id"), releases.release_sets(ranked, "cve_id", broadcast_bytes=0)
    assert one.sets.exceptAll(other.sets).count() == other.sets.exceptAll(one.sets).count() == 0
    assert releases.changes(one).exceptAll(releases.changes(other, broadcast_bytes=0)).count() == 0


def test_history_gives_the_lists_of_the_compared_rows(spark):
    ranked, _ = _history(spark, 9, seed=6)
    history, compared = releases.release_history(ranked), releases.compared_rows(ranked)
    for operator in (releases.new_cves, releases.resolved_cves):
        one, other = operator(history, n=4), operator(compared, n=4)
        assert one.count() and one.exceptAll(other).count() == other.exceptAll(one).count() == 0
    for operator in (releases.new_cwes, releases.resolved_cwes):
        assert operator(ranked).collect() == operator(compared).collect()


def test_one_scan_of_the_table(spark, ranked, monkeypatch):
    """Everything after the first staged table reads what was staged."""
    plans = []
    monkeypatch.setattr(releases, "stage", lambda df, label="table", keep=releases.stage: plans.append(df._jdf.queryExecution().analyzed().toString()) or keep(df, label))
    source = ranked.withColumn("primary_cwe", F.concat("primary_cwe", F.lit("/marked")))
    results = [releases.new_cves(source), releases.resolved_cwes(source), releases.release_delta(source)]
    plans += [result._jdf.queryExecution().analyzed().toString() for result in results]
    assert sum(plan.count("/marked") for plan in plans) == 3


def test_release_prompt_works_statistics_out_once(ranked, monkeypatch):
    calls = []
    monkeypatch.setattr(releases, "release_stats", lambda *a, f=releases.release_stats, **k: calls.append(1) or f(*a, **k))
    pairs = releases.release_pairs(ranked, current="v2", previous="v1")
    text = prompts.release_prompts(ranked, pairs).first().prompt
    assert "Findings: +1 (50.0%)" in text and calls == [1]


def test_release_prompt_names_all_weaknesses(spark):
    rows = [("a", "v2", f"C{i}", 0.5, f"CWE-{i:03d}") for i in range(60)] + [("a", "v1", f"D{i}", 0.5, f"CWE-{i + 500}") for i in range(55)]
    lines = prompts.release_prompts(table(spark, rows)).first().prompt.split("\n")
    assert f"New weaknesses: {', '.join(f'CWE-{i:03d}' for i in range(60))}" in lines
    assert f"Resolved weaknesses: {', '.join(f'CWE-{i + 500}' for i in range(55))}" in lines
