"""Registered queries."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every plan module so that its queries register."""
    for m in sorted(i.name for i in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{m}")
