"""All registered queries and the SQL that gives the same rows."""

from __future__ import annotations

import importlib

from packetlake.plans.base import ORACLES, QUERIES

for _name in ("detection", "connections", "rules", "stores", "more"):
    importlib.import_module(f"packetlake.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
