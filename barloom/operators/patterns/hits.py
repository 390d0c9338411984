"""The common shape of a detector result."""

from __future__ import annotations

from barloom.functions.sql import F, Sql
from barloom.schema import HIT_TYPE, POINT_TYPE

def point(p: Sql, role, price: Sql | None = None) -> Sql:
    """A named anchor: ``p`` carries idx, ts and (unless given) price."""
    return F.struct(
        p.idx.alias("idx"),
        p.ts.alias("ts"),
        (p.price if price is None else price).alias("price"),
        (F.lit(role) if isinstance(role, str) else role).alias("role"),
    )


def bar_point(bar: Sql, price: Sql, role: str) -> Sql:
    return point(bar, role, price)


def hit(
    detector_no: int,
    kind: Sql | str,
    confidence: Sql | float,
    points: Sql,
    target: Sql | None = None,
    invalidation: Sql | None = None,
) -> Sql:
    null = F.lit(None)
    return F.struct(
        F.lit(detector_no).alias("detector_no"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        ("confidence", confidence),
        points.cast(f"array<{POINT_TYPE}>").alias("points"),
        (null if target is None else target).alias("target_price"),
        (null if invalidation is None else invalidation).alias("invalidation_price"),
    ).cast(HIT_TYPE)


def no_hits() -> Sql:
    return F.array().cast(f"array<{HIT_TYPE}>")


def when_enough(cond: Sql, hits: Sql) -> Sql:
    return F.when(cond, hits).otherwise(no_hits())
