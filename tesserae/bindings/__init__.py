"""The operators bound to the benchmark tables."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every binding module and return the registry."""
    from tesserae.bindings import registry

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return registry
