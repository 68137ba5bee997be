"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("binary_output", "decontamination", "sharding", "quality_rules", "piece_coding", "suffix_dedup", "chat_format",
           "near_dedup", "url_filter", "substring_dedup", "lexical_search", "merkle_manifest", "license_scan")


def load():
    """(queries, sql) of all operators."""
    queries, sql = {}, {}
    for name in MODULES:
        module = import_module(f"meltgrid.llm.{name}")
        for key, value in vars(module).items():
            if key.startswith("op") and callable(value):
                queries[key] = value
                if hasattr(module, "ORACLE_SQL"):
                    sql[key] = module.ORACLE_SQL
    return queries, sql
