"""Queries over the given tables; importing the modules fills the registry."""

from __future__ import annotations

import importlib
import pkgutil


def load_catalog():
    from attestor.workload import catalog

    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
    return catalog.QUERIES, catalog.ORACLES
