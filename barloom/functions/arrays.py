"""Small combinators over array expressions.

A bounded list of candidates that belongs to one series lives in an array column
and is refined step by step (`add` fields, `F.filter` gates), the way rows of a
table would be, but without a shuffle. ``Candidates`` keeps track of the fields.
"""

from __future__ import annotations

from collections.abc import Callable

from barloom.functions.sql import F, Sql


def let(value: Sql, f: Callable[[Sql], Sql]) -> Sql:
    """Evaluate ``value`` once and hand it to ``f``."""
    return F.transform(F.array(value), f)[0]


class Candidates:
    """An array of structs with known fields."""

    def __init__(self, array: Sql, fields: tuple[str, ...]):
        self.array = array
        self.fields = fields

    @staticmethod
    def of(array: Sql, **fields: Callable[..., Sql]) -> Candidates:
        """Candidates computed from the elements (and positions) of an array."""

        def one(x: Sql) -> Sql:
            return F.struct(*[(n, f(x)) for n, f in fields.items()])

        return Candidates(F.transform(array, one), tuple(fields))

    @staticmethod
    def single(**fields: Sql) -> Candidates:
        return Candidates(F.array(F.struct(*fields.items())), tuple(fields))

    def add(self, **fields: Callable[[Sql], Sql]) -> Candidates:
        """Add (or replace) computed fields."""
        names = tuple(dict.fromkeys((*self.fields, *fields)))

        def widen(x: Sql) -> Sql:
            return F.struct(*[(n, fields[n](x) if n in fields else x[n]) for n in names])

        return Candidates(F.transform(self.array, widen), names)

    def where(self, cond: Callable[[Sql], Sql]) -> Candidates:
        return Candidates(F.filter(self.array, cond), self.fields)

    def first(self) -> Candidates:
        """Only the first one, if any."""
        return Candidates(F.slice(self.array, 1, 1), self.fields)

    def to(self, f: Callable[[Sql], Sql]) -> Sql:
        return F.transform(self.array, f)


def tail(arr: Sql, k: int) -> Sql:
    """Last ``k`` elements (all of them when there are fewer)."""
    return let(arr, lambda a: F.slice(a, F.greatest(1, F.size(a) - (k - 1)), k))


def windows(arr: Sql, k: int) -> Sql:
    """Every run of ``k`` consecutive elements, oldest first."""
    return let(
        arr,
        lambda a: F.transform(
            F.filter(F.sequence(1, F.size(a) + 1), lambda i: i <= F.size(a) - (k - 1)),
            lambda i: F.slice(a, i, k),
        ),
    )


def at(arr: Sql, i) -> Sql:
    """Zero-based element, NULL when out of range."""
    return F.get(arr, i)


def total(arr: Sql, f: Callable[[Sql], Sql]) -> Sql:
    return F.aggregate(arr, 0.0, lambda acc, x: acc + f(x))


def empty_like(arr: Sql) -> Sql:
    return F.slice(arr, 1, 0)
