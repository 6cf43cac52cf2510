"""Registered queries: each operator wired to input relations derived from the given tables."""

from __future__ import annotations

from importlib import import_module

from firnline.catalog.registry import REGISTRY

MODULES = ["scans", "filters", "joins", "aggregates", "ordered", "scalars", "models"]

for _m in MODULES:
    import_module(f"firnline.catalog.{_m}")


def queries():
    return {name: q.run for name, q in REGISTRY.items()}


def oracle_sql():
    return {name: q.oracle() for name, q in REGISTRY.items() if q.sql}
