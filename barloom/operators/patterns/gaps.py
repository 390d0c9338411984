"""Open price gaps."""

from __future__ import annotations

from barloom.functions.sql import F, Sql
from barloom.functions.arrays import tail
from barloom.operators.patterns.hits import hit, point, when_enough

# Fixed values.
MAX_GAPS = 3
MIN_BARS = 16


def gap_hits(gaps: Sql, n: Sql) -> Sql:
    """The last three open gaps; the far edge is the level that ends them."""

    def one(g: Sql) -> Sql:
        prev = F.struct(g.prev_idx.alias("idx"), g.prev_ts.alias("ts"), g.zone_low.alias("price"))
        cur = F.struct(g.idx.alias("idx"), g.ts.alias("ts"), g.zone_high.alias("price"))
        return hit(
            10,
            g.kind,
            F.least(
                0.85,
                0.5 + 0.25 * F.least(F.try_divide(g.gap, 2.0 * g.atr), 1.0),
            ),
            F.array(point(prev, "gap_low"), point(cur, "gap_high")),
            None,
            F.when(g.kind == "gap_up", g.zone_low).otherwise(g.zone_high),
        )

    return when_enough(n >= MIN_BARS, F.transform(tail(gaps, MAX_GAPS), one))
