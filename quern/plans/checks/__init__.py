"""Registered queries: each operator over the given tables, next to equivalent SQL."""

from quern.plans.checks.registry import Check, collect

__all__ = ["Check", "collect"]
