"""Least-squares fits over arrays of points that carry ``x`` and ``y``."""

from __future__ import annotations

from barloom.functions.arrays import let
from barloom.functions.sql import F, Sql


def _struct(**fields) -> Sql:
    return F.struct(*fields.items())


def fit_line(points: Sql) -> Sql:
    """struct(slope, intercept, r2).

    No spread in x: horizontal line through the mean, r2 = 0. All y equal: r2 = 1.
    """
    return let(points, _line)


def _line(points: Sql) -> Sql:
    mean = F.aggregate(
        points,
        _struct(x=0.0, y=0.0),
        lambda s, p: _struct(x=s.x + p.x, y=s.y + p.y),
        lambda s: _struct(x=F.try_divide(s.x, F.size(points)), y=F.try_divide(s.y, F.size(points))),
    )

    def around(mean: Sql) -> Sql:
        return F.aggregate(
            points,
            _struct(xx=0.0, xy=0.0, yy=0.0),
            lambda s, p: _struct(
                xx=s.xx + (p.x - mean.x) * (p.x - mean.x),
                xy=s.xy + (p.x - mean.x) * (p.y - mean.y),
                yy=s.yy + (p.y - mean.y) * (p.y - mean.y),
            ),
            lambda s: _struct(
                slope=F.when(s.xx == 0, 0.0).otherwise(s.xy / s.xx),
                intercept=F.when(s.xx == 0, mean.y).otherwise(mean.y - s.xy / s.xx * mean.x),
                r2=F.when(s.xx == 0, 0.0).when(s.yy == 0, 1.0).otherwise(F.try_divide(s.xy * s.xy, s.xx * s.yy)),
            ),
        )

    return let(mean, around)


def on_line(fit: Sql, x: Sql) -> Sql:
    return fit.slope * x + fit.intercept


def fit_parabola(points: Sql) -> Sql:
    """struct(a, b, c, x0, r2, vertex) of y = a(x-x0)^2 + b(x-x0) + c.

    x is centred on the middle of the range: fourth powers of absolute bar numbers
    lose too many digits. Fewer than 3 points or no spread: a = 0, r2 = 0.
    """
    return let(points, _parabola)


def _det(a, b, c, d, e, f, g, h, i):
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def _parabola(points: Sql) -> Sql:
    n = F.size(points)
    centre = (F.get(points, 0).x + F.get(points, n - 1).x) / 2.0

    def sums(x0: Sql) -> Sql:
        return F.aggregate(
            points,
            _struct(s1=0.0, s2=0.0, s3=0.0, s4=0.0, y=0.0, xy=0.0, xxy=0.0),
            lambda s, p: let(
                p.x - x0,
                lambda d: _struct(
                    s1=s.s1 + d,
                    s2=s.s2 + d * d,
                    s3=s.s3 + d * d * d,
                    s4=s.s4 + d * d * d * d,
                    y=s.y + p.y,
                    xy=s.xy + d * p.y,
                    xxy=s.xxy + d * d * p.y,
                ),
            ),
        )

    def solve(s: Sql, x0: Sql) -> Sql:
        def by_cramer(d: Sql) -> Sql:
            return _struct(
                ok=(n >= 3) & (d != 0),
                a=F.try_divide(_det(s.xxy, s.s3, s.s2, s.xy, s.s2, s.s1, s.y, s.s1, n), d),
                b=F.try_divide(_det(s.s4, s.xxy, s.s2, s.s3, s.xy, s.s1, s.s2, s.y, n), d),
                c=F.try_divide(_det(s.s4, s.s3, s.xxy, s.s3, s.s2, s.xy, s.s2, s.s1, s.y), d),
                mean=F.try_divide(s.y, n),
            )

        det = _det(s.s4, s.s3, s.s2, s.s3, s.s2, s.s1, s.s2, s.s1, n)
        return let(let(det, by_cramer), lambda q: score(q, x0))

    def score(q: Sql, x0: Sql) -> Sql:
        errors = F.aggregate(
            points,
            _struct(res=0.0, tot=0.0),
            lambda s, p: let(
                p.x - x0,
                lambda d: _struct(
                    res=s.res + F.pow(p.y - (q.a * d * d + q.b * d + q.c), 2.0),
                    tot=s.tot + F.pow(p.y - q.mean, 2.0),
                ),
            ),
        )
        return let(
            errors,
            lambda e: _struct(
                a=F.when(q.ok, q.a).otherwise(0.0),
                b=F.when(q.ok, q.b).otherwise(0.0),
                c=F.when(q.ok, q.c).otherwise(q.mean),
                x0=x0,
                r2=F.when(~q.ok, 0.0).when(e.tot == 0, 1.0).otherwise(1.0 - F.try_divide(e.res, e.tot)),
                vertex=F.when(q.ok & (q.a != 0), x0 - F.try_divide(q.b, 2.0 * q.a)),
            ),
        )

    return let(centre, lambda x0: let(sums(x0), lambda s: solve(s, x0)))


def on_parabola(q: Sql, x: Sql) -> Sql:
    return let(x - q.x0, lambda d: q.a * d * d + q.b * d + q.c)
