"""All registered queries."""

from __future__ import annotations

import importlib
import pkgutil

import binloom.plans as plans
from binloom.plans.registry import ORACLE, QUERIES

for _m in pkgutil.iter_modules(plans.__path__):
    if _m.name.startswith("q_"):
        importlib.import_module(f"binloom.plans.{_m.name}")

__all__ = ["ORACLE", "QUERIES"]
