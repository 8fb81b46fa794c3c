"""Plans of the registered queries: no Python, no products, whole tables, pruned scans."""

import re

import pytest
from conftest import SMALL

from findrisk.plans.catalog import CHECKS, QUERIES

PYTHON = {"explain_top_findings", "tree_contributions", "global_importance", "top_factors", "explanation_text", "pattern_prompt"}
CHECKED = {
    "tree_contributions_check", "text_embed_energy", "feature_matrix_vectors", "text_embed_batches", "explain_one_cve", "prompt_top_findings",
    "importance_of_terms", "pattern_prompt_of_terms",
}
MODEL = PYTHON | CHECKED | {"train_predict", "train_evaluate", "train_score_findings", "text_embed_pca"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODEL))
def test_no_python_and_no_products(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert not re.search(r"Python|ArrowEval|InPandas|InArrow", plan), plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["release_top_cves", "new_cves", "resolved_cves", "release_top_packages"])
def test_groups_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan_of(QUERIES[name](spark, SMALL))


@pytest.mark.parametrize("name", ["top_n_riskiest", "top_repos", "table_page", "portfolio_top_cves"])
def test_top_lists_do_not_sort_the_table(spark, name):
    assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, SMALL))


def test_scans_read_only_what_a_query_needs(spark):
    plan = plan_of(QUERIES["severity_tier_heatmap"](spark, SMALL))
    for column in ("l_extendedprice", "p_retailprice", "o_totalprice", "p_type"):
        assert column not in plan


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(QUERIES)
    assert set(QUERIES) - set(CHECKS) == MODEL - CHECKED


@pytest.mark.parametrize("name", ["feature_matrix", "portfolio_context", "features_user_behavior"])
def test_statistics_are_attached_without_shuffling_the_findings(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_factors_are_worked_out_once(spark):
    """A filter on their number would work them out a second time next to the scan."""
    assert "size(" not in plan_of(QUERIES["factors_of_terms"](spark, SMALL))
