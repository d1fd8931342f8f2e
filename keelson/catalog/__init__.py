"""Registered queries with their check SQL."""

from importlib import import_module

MODULES = ("policy", "cleaning", "compat", "profiling", "split", "metrics", "drift", "files", "prep", "model")


def load():
    """Import every catalogue module and return (queries, oracles)."""
    from keelson.catalog import registry

    for name in MODULES:
        import_module(f"keelson.catalog.{name}_queries")
    return registry.QUERIES, registry.ORACLES
