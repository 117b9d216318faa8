"""Registered queries with the SQL each one is checked against."""

from importlib import import_module

MODULES = ("accuracy", "tracks", "motion", "intervals", "venue", "pose", "sequential", "scoring", "tables")


def load():
    for name in MODULES:
        import_module(f"trackweave.queries.{name}")
    registry = import_module("trackweave.queries.registry")
    return dict(registry.QUERIES), dict(registry.ORACLES)
