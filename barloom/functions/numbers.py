"""Rounding used at the decision edge."""

from __future__ import annotations

from barloom.functions.sql import F, Sql


def round_half_up(x: Sql, places: int = 0) -> Sql:
    """Round halves toward +infinity (built-in ``round`` sends them away from zero)."""
    f = float(10**places)
    return F.floor(x * f + 0.5) / f


def clamp01(x: Sql) -> Sql:
    return F.greatest(0.0, F.least(1.0, x))
