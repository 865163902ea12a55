"""Imports every binding module, so that all queries are registered."""

from __future__ import annotations

import importlib
import pkgutil
from pathlib import Path

from .base import ORACLE, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules([str(Path(__file__).parent)])):
    if _module not in {"base", "registry"}:
        importlib.import_module(f"{__package__}.{_module}")

__all__ = ["ORACLE", "QUERIES"]
