"""All queries of this subpackage."""

from llm import (  # noqa: F401
    alignment,
    decontamination,
    language_id,
    license_scan,
    line_dedup,
    mixing,
    near_dedup,
    phrases,
    quality_classifier,
    quality_rules,
    secret_scan,
    sharding,
    token_files,
)
from llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
