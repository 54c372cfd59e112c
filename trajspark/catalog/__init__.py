"""All registered queries and their checking SQL."""

import importlib

MODULES = ["problems", "sequences", "vectors", "datasets", "streams", "stored"]


def _all(what: str) -> dict:
    out = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"trajspark.catalog.{name}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict:
    return _all("ORACLES")
