"""The training-text queries, collected for the driver."""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from ledgerline.llm import decontaminate, line_dup, mixing, near_dup, page_text, quality_model, quality_rules, substring_dup, token_shards, url_filter

MODULES: tuple[ModuleType, ...] = (
    quality_model,
    line_dup,
    near_dup,
    mixing,
    page_text,
    quality_rules,
    token_shards,
    substring_dup,
    url_filter,
    decontaminate,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for module in MODULES for name, sql in module.SQL.items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
