"""Registered queries and their check SQL, by inventory section."""

import importlib

_SECTIONS = ["history", "ingest", "reports", "models", "explain", "streams", "jobs"]


def load():
    """Import every section and return the registry."""
    for section in _SECTIONS:
        importlib.import_module(f"txnlens.catalog.{section}")
    return importlib.import_module("txnlens.catalog.base")
