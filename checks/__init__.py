"""Queries over the test tables, one or more per operator, with SQL twins."""

from __future__ import annotations

import importlib
import pkgutil


def all_checks():
    from checks.registry import CHECKS

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module.startswith("q"):
            importlib.import_module(f"checks.{module}")
    return CHECKS
