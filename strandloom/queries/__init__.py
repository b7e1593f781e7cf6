"""Registered queries, one per operator, and the SQL that checks them."""

from importlib import import_module

MODULES = ("scalars", "rows", "groups", "docs")


def load():
    for name in MODULES:
        import_module(f"strandloom.queries.{name}")
    from strandloom.queries import registry

    return registry.QUERIES, registry.ORACLES
