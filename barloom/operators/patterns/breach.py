"""Drop hits whose target or invalidation was already traded after they completed."""

from __future__ import annotations

from barloom.functions.sql import F, Sql

# Sloped envelopes, whose levels are only valid at one bar.
EXEMPT = ("channel_up", "channel_down", "channel_flat", "rising_wedge", "falling_wedge")


def _traded(level: Sql, below: Sql, lowest: Sql, highest: Sql) -> Sql:
    """Did any later bar touch ``level``, which lies below (or not below) the completion close?"""
    return F.coalesce(F.when(below, lowest <= level).otherwise(highest >= level), F.lit(False))


def is_breached(hit: Sql, bars: Sql) -> Sql:
    done = F.get(bars, F.array_max(F.transform(hit.points, lambda p: p.idx)))
    inv, tgt = hit.invalidation_price, hit.target_price
    return _traded(inv, inv < done.close, done.later_low, done.later_high) | _traded(
        tgt, ~(tgt > done.close), done.later_low, done.later_high
    )


def breach_guard(hits: Sql, bars: Sql) -> Sql:
    return F.filter(hits, lambda h: h.kind.isin(*EXEMPT) | ~is_breached(h, bars))
