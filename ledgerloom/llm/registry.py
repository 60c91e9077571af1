"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

# module -> its first query
QUERIES = {
    "pattern_packing": "op1_pattern_packing",
    "decontamination": "op10_decontamination",
    "language_id": "op7_language_id",
    "toxicity": "op2_toxicity",
    "pii": "op8_pii",
    "spot_signatures": "op6_spot_signatures",
    "bag_minhash": "op5_bag_minhash",
    "chat_snapshots": "op3_chat_snapshots",
    "html_extraction": "op9_html_extraction",
    "token_counts": "op4_token_counts",
    "source_divergence": "op11_source_divergence",
    "simhash_balls": "op12_simhash_balls",
    "vector_codes": "op13_vector_codes",
}

# The search half of the fingerprints.
MORE = {"spot_near_duplicates": "spot_signatures"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), name) for module, name in QUERIES.items()}
    found |= {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MORE.items()}
    return found | {"pipeline": import_module("corpus_pipeline").run}


def oracle_sql() -> dict[str, str]:
    found = {}
    for module, name in QUERIES.items():
        sql = getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    sql = import_module("corpus_pipeline").ORACLE_SQL
    return found | ({"pipeline": sql} if sql else {})
