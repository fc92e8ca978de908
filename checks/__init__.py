"""Registered queries: the library on whole tables, each with its SQL oracle where one exists."""

import importlib
import pkgutil


def load() -> None:
    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{mod}")
