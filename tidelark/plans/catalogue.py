"""All queries of the engine: importing this module registers them."""

from __future__ import annotations

from tidelark.plans import columns, decisions, kernels, signals, streams  # noqa: F401
from tidelark.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
