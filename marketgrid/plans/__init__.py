"""Registered queries: one per operator, each with its SQL check where SQL can express it."""

from __future__ import annotations

import importlib

MODULES = ("alignment", "series", "blocks", "crosssection", "curve", "risk", "portfolio", "scoring",
           "forecasting", "evidence", "states")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
