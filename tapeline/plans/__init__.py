"""Query catalogue: every module here registers named queries."""

import importlib
import pkgutil


def load_all():
    from tapeline.plans import registry

    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return registry
