"""Queries over the driver tables: one module per inventory section."""

import importlib
import pkgutil


def load_all():
    """Import every plan module and return the filled registry."""
    from sonorisk.plans import registry

    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return registry
