"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from .catalog import code, incremental, more, points, retrieval, rules, small, telemetry  # noqa: F401 - they register themselves
from .catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
