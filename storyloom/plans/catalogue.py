"""Every registered query and its oracle."""

from __future__ import annotations

from storyloom.plans import evaluation, golden, operations, relational, stories, streams, texts  # noqa: F401  each registers its queries
from storyloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
