"""All registered queries."""

from findrisk.plans import (  # noqa: F401
    dashboard_queries,
    evaluation_queries,
    feature_queries,
    model_queries,
    release_queries,
    score_queries,
    source_queries,
    text_queries,
)
from findrisk.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
