"""Spark SQL fragments that compose like columns.

The detectors are long chains of higher-order functions. Building such a chain from
``Column`` objects costs one JVM round trip per operator (seconds for a whole
scan); the same chain written as SQL text reaches the parser in one call. ``Sql``
only spells text: operators, functions and lambdas all mean what Spark SQL says
they mean.
"""

from __future__ import annotations

import inspect
import itertools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as pf

_names = itertools.count()


class Sql:
    """One SQL expression."""

    __hash__ = None

    def __init__(self, text: str):
        self.text = text

    def __str__(self) -> str:
        return self.text

    def column(self) -> Column:
        return pf.expr(self.text)

    def __getattr__(self, name: str) -> Sql:
        if name.startswith("__"):
            raise AttributeError(name)
        return Sql(f"{self}.`{name}`")

    def __getitem__(self, key) -> Sql:
        return Sql(f"{self}.`{key}`") if isinstance(key, str) else Sql(f"{self}[{_text(key)}]")

    def cast(self, type_: str) -> Sql:
        return Sql(f"CAST({self} AS {type_})")

    def isNotNull(self) -> Sql:
        return Sql(f"({self} IS NOT NULL)")

    def isNull(self) -> Sql:
        return Sql(f"({self} IS NULL)")

    def isin(self, *values) -> Sql:
        return Sql(f"({self} IN ({', '.join(_text(v) for v in values)}))")

    def alias(self, name: str) -> tuple[str, Sql]:
        """A named field for `F.struct`."""
        return name, self

    def __neg__(self) -> Sql:
        return Sql(f"(-{self})")

    def __invert__(self) -> Sql:
        return Sql(f"(NOT {self})")


def _binary(symbol: str, swap: bool = False) -> Callable:
    def op(self: Sql, other) -> Sql:
        a, b = (_text(other), str(self)) if swap else (str(self), _text(other))
        return Sql(f"({a} {symbol} {b})")

    return op


for _method, _symbol in {
    "add": "+",
    "sub": "-",
    "mul": "*",
    "truediv": "/",
    "mod": "%",
    "and": "AND",
    "or": "OR",
}.items():
    setattr(Sql, f"__{_method}__", _binary(_symbol))
    setattr(Sql, f"__r{_method}__", _binary(_symbol, swap=True))
for _method, _symbol in {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    setattr(Sql, f"__{_method}__", _binary(_symbol))


def _text(value) -> str:
    if isinstance(value, Sql):
        return str(value)
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D" if value >= 0 else f"({value!r}D)"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raise TypeError(f"cannot spell {value!r} in SQL")


class _Case(Sql):
    def __init__(self, branches: tuple[tuple[str, str], ...]):
        self.branches = branches
        super().__init__("CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + " END")

    def when(self, cond, value) -> _Case:
        return _Case((*self.branches, (_text(cond), _text(value))))

    def otherwise(self, value) -> Sql:
        return Sql(self.text[: -len(" END")] + f" ELSE {_text(value)} END")


def _lambda(f: Callable) -> str:
    wanted = [p for p in inspect.signature(f).parameters.values() if p.default is inspect.Parameter.empty]
    names = [f"v{next(_names)}" for _ in wanted]
    body = _text(f(*[Sql(n) for n in names]))
    return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {body}"


class _Functions:
    """``F.name(args)`` spells ``name(args)``; Python callables become SQL lambdas."""

    @staticmethod
    def lit(value) -> Sql:
        return Sql(_text(value))

    @staticmethod
    def col(name: str) -> Sql:
        return Sql(f"`{name}`")

    @staticmethod
    def when(cond, value) -> _Case:
        return _Case(((_text(cond), _text(value)),))

    @staticmethod
    def struct(*fields: tuple[str, Sql]) -> Sql:
        return Sql(f"named_struct({', '.join(f'{_text(n)}, {_text(v)}' for n, v in fields)})")

    def __getattr__(self, name: str) -> Callable[..., Sql]:
        def call(*args) -> Sql:
            return Sql(f"{name}({', '.join(_lambda(a) if callable(a) else _text(a) for a in args)})")

        return call


F = _Functions()
