"""Operators for training-data pipelines at corpus scale.

Each module holds one operator with its own interface, and the thin query
``opN_<name>(spark, sf_dir)`` that applies it to a whole table with production
parameters.  :func:`queries` lists those queries; nothing outside this
subpackage imports it except the guarded hook in ``__spark_entry__``.
"""

from __future__ import annotations

import importlib

#: query name -> module that defines it
QUERIES = {
    "op1_embedding_near_dedup": "op1_embedding_dedup",
    "op2_bpe_roundtrip": "op2_bpe",
    "op3_simhash_near_dedup": "op3_simhash",
    "op4_language_id": "op4_langid",
    "op5_html_extract": "op5_html",
    "op6_mixture_packing": "op6_packing",
    "op7_secret_scan": "op7_secrets",
    "op8_quality_rules": "op8_quality",
    "op9_quote_linking": "op9_quotes",
    "op10_warc_roundtrip": "op10_warc",
}

#: columns of two of them that SQL can tell, over the whole table, with ``BASE_SQL`` of the module
BASE_COLUMNS = {"secret_base_spans": "op7_secrets", "quality_base_counts": "op8_quality"}


def queries() -> dict:
    """Query name -> callable(spark, sf_dir)."""
    return {name: getattr(importlib.import_module(f"{__name__}.{mod}"), name) for name, mod in (QUERIES | BASE_COLUMNS).items()}


def oracle_sql() -> dict:
    """Query name -> DuckDB SQL, for the queries that SQL can express."""
    out = {}
    for name, mod in QUERIES.items():
        sql = getattr(importlib.import_module(f"{__name__}.{mod}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out | {name: importlib.import_module(f"{__name__}.{mod}").BASE_SQL for name, mod in BASE_COLUMNS.items()}
