"""All queries of the library and their SQL."""

from __future__ import annotations

import importlib

from decisia.plans.registry import QUERIES, SQL

for _name in ("texts", "rows", "layouts", "scores", "origins", "built"):
    importlib.import_module(f"decisia.plans.{_name}")

__all__ = ["QUERIES", "SQL"]
