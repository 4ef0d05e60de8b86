"""Registered queries: every operator over the whole input tables."""

from importlib import import_module
from pkgutil import iter_modules

from .registry import ORACLES, QUERIES

for _module in iter_modules(__path__):
    if _module.name != "registry":
        import_module(f"{__name__}.{_module.name}")

__all__ = ["ORACLES", "QUERIES"]
