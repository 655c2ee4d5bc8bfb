"""Named queries over the test tables, grouped by subject."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every query module so that its queries register themselves."""
    for mod in pkgutil.iter_modules(__path__):
        if mod.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{mod.name}")
