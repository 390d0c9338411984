"""Double and triple tops and bottoms on the last zigzag pivots."""

from __future__ import annotations

from barloom.functions.sql import F, Sql
from barloom.functions.arrays import Candidates, tail, windows
from barloom.operators.patterns.hits import hit, point, when_enough

# Fixed values.
ALIGN_MAX_PCT = 0.015
ALIGN_MAX_ATR = 1.0
MIN_HEIGHT_ATR = 2.0
MAX_PIVOTS = 14
MAX_CONFIDENCE = 0.85


def _structures(pivots: Sql, tests: int, atr: Sql, close: Sql) -> Sql:
    """Live runs of ``tests`` aligned extremes with their opposite pivots between."""
    c = Candidates.of(windows(pivots, 2 * tests - 1), w=lambda w: w)
    c = c.where(lambda x: F.forall(F.sequence(1, F.lit(2 * tests - 2)), lambda k: F.get(x.w, k).kind != F.get(x.w, k - 1).kind)
    )
    outer = lambda x: [x.w[2 * k].price for k in range(tests)]
    inner = lambda x: [x.w[2 * k + 1].price for k in range(tests - 1)]

    def pick(fn, values):
        return values[0] if len(values) == 1 else fn(*values)

    c = c.add(top=lambda x: x.w[0].kind == "high",
        hi=lambda x: F.greatest(*outer(x)),
        lo=lambda x: F.least(*outer(x)),
        mean=lambda x: sum(outer(x)[1:], outer(x)[0]) / F.lit(float(tests)),
    )
    # The neckline is the far opposite pivot: the structure breaks when all of them have gone.
    c = c.add(neck=lambda x: F.when(x.top, pick(F.least, inner(x))).otherwise(pick(F.greatest, inner(x))),
        edge=lambda x: F.when(x.top, x.hi).otherwise(x.lo),
        tol=lambda x: F.least(F.lit(ALIGN_MAX_PCT) * x.hi, F.lit(ALIGN_MAX_ATR) * atr),
    )
    c = c.add(height=lambda x: F.when(x.top, x.mean - x.neck).otherwise(x.neck - x.mean))
    return c.where(lambda x: (x.hi - x.lo <= x.tol)
        & (x.height >= F.lit(MIN_HEIGHT_ATR) * atr)
        & (close > F.least(x.neck, x.edge))
        & (close < F.greatest(x.neck, x.edge)),
    )


def _to_hits(c: Sql, kind: str, roles: tuple[list[str], list[str]], weights, atr: Sql) -> Sql:
    base, align, depth = weights

    def confidence(x: Sql) -> Sql:
        return F.least(
            F.lit(MAX_CONFIDENCE),
            F.lit(base)
            + F.lit(align) * (1.0 - F.try_divide(x.hi - x.lo, x.tol))
            + F.lit(depth) * F.least(F.try_divide(x.height, 3.0 * atr), 1.0),
        )

    def points(x: Sql) -> Sql:
        return F.array(
            *[
                point(x.w[k], F.when(x.top, F.lit(t)).otherwise(F.lit(b)))
                for k, (t, b) in enumerate(zip(*roles, strict=True))
            ]
        )

    return c.to(lambda x: hit(
            2,
            F.when(x.top, F.lit(f"{kind}_top")).otherwise(F.lit(f"{kind}_bottom")),
            confidence(x),
            points(x),
            F.when(x.top, x.neck - x.height).otherwise(x.neck + x.height),
            x.edge,
        ),
    )


def double_triple_hits(zz: Sql, atr: Sql, close: Sql) -> Sql:
    """Triples first; a double all of whose pivots belong to triples is dropped."""
    recent = tail(zz, MAX_PIVOTS)
    triples = _structures(recent, 3, atr, close)
    claimed = F.flatten(triples.to(lambda x: F.transform(x.w, lambda s: s.idx * 2 + s.ord)))
    doubles = _structures(recent, 2, atr, close).where(
        lambda x: ~F.forall(x.w, lambda s: F.array_contains(claimed, s.idx * 2 + s.ord)),
    )
    hits = F.concat(
        _to_hits(
            triples,
            "triple",
            (["top_1", "valley_1", "top_2", "valley_2", "top_3"], ["bottom_1", "peak_1", "bottom_2", "peak_2", "bottom_3"]),
            (0.55, 0.18, 0.12),
            atr,
        ),
        _to_hits(
            doubles, "double", (["top_1", "valley", "top_2"], ["bottom_1", "peak", "bottom_2"]), (0.5, 0.2, 0.15), atr
        ),
    )
    return when_enough(atr > 0, hits)
