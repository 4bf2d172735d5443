"""Queries of the text operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name: module of this subpackage whose query() it runs.
NAMES = {
    "op1_token_counts": "token_counts",
    "op2_topk_search": "topk_search",
    "op3_decontamination": "decontamination",
    "op4_byte_bpe": "bpe",
    "op5_simhash": "simhash",
    "op6_suffix_dedup": "suffix_dedup",
    "op7_quality": "quality",
    "op8_warc": "warc",
    "op9_line_dedup": "line_dedup",
    "op10_language_id": "language_id",
    "op11_token_alignment": "alignment",
    "op12_collocations": "collocations",
    "op13_html_extraction": "html_extraction",
}


def _query(module: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: import_module(f".{module}", __package__).query(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(module) for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    modules = {name: import_module(f".{module}", __package__) for name, module in NAMES.items()}
    found = {name: m.SQL for name, m in modules.items() if hasattr(m, "SQL")}
    return found | {name: m.sql() for name, m in modules.items() if hasattr(m, "sql")}
