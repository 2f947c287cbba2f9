"""Whole jobs composed from the operators, and the named query catalog."""

import importlib
import pkgutil


def load_catalog():
    """Import every query module once and return the catalog."""
    from corpusloom.plans import catalog

    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
    return catalog
