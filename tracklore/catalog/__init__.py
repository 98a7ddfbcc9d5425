"""Registered queries over the test tables, each with its SQL equivalent where one exists."""

from importlib import import_module

AREAS = ["metrics", "linkage", "names", "ingest", "enrich", "reports", "streams", "search"]


def load_catalog():
    from tracklore.catalog.registry import ORACLES, QUERIES

    for area in AREAS:
        import_module(f"tracklore.catalog.{area}")
    return QUERIES, ORACLES
