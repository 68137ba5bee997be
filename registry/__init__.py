"""Registered queries: each pairs a Spark query with the SQL that checks it."""

from importlib import import_module
from importlib.util import find_spec

MODULES = ("layers", "physics", "scores", "sweeps", "spatial", "resampling", "tests_two", "fields", "reports",
           "evaluations")


def load():
    """(queries, sql, covered inventory ids) after importing every registry module."""
    from registry import base

    for m in MODULES:
        if find_spec(f"registry.{m}"):
            import_module(f"registry.{m}")
    return dict(base.QUERIES), dict(base.SQL), dict(base.COVERS)
