"""Registered queries, one module per section of the operator inventory."""

from importlib import import_module

MODULES = ("series", "contracts", "relational", "statistics", "windows", "catalogue", "search", "publication", "scalars", "ingest", "streams")


def load_all() -> None:
    for name in MODULES:
        try:
            import_module(f"{__name__}.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{name}":
                raise
