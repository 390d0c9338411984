"""Ratio-defined pivot patterns as rows: add a row to add a pattern."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from barloom.functions.sql import F, Sql
from barloom.functions.arrays import Candidates, tail, windows
from barloom.operators.patterns.hits import hit, point, when_enough

# Fixed values.
FIB_TOLERANCE = 0.05
MAX_PIVOTS = 12
MIN_LEG_ATR = 2.0
TARGET_RETRACE = 0.382
MAX_CONFIDENCE = 0.85

@dataclass(frozen=True)
class Ratio:
    """|p[num0]-p[num1]| / |p[den0]-p[den1]|, near one of ``anchors`` or inside [low, high]."""

    name: str
    num: tuple[int, int]
    den: tuple[int, int]
    anchors: tuple[float, ...] = ()
    low: float = 0.0
    high: float = 0.0
    tol: float = FIB_TOLERANCE

@dataclass(frozen=True)
class Template:
    """A run of ``len(roles)`` pivots. ``x`` in the callables carries w, dir and the ratios by name."""

    name: str
    roles: tuple[str, ...]
    bullish_low_at: int
    ratios: tuple[Ratio, ...]
    confidence: Callable[[Sql], Sql]
    target: Callable[[Sql], Sql]
    invalidation: Callable[[Sql], Sql]
    guard: Callable[[Sql], Sql] | None = None

def _near(value: Sql, anchor: float) -> Sql:
    """1 on the anchor, 0 at the edge of the tolerance."""
    return 1.0 - F.abs(value - F.lit(anchor)) / F.lit(FIB_TOLERANCE)

def _score(*parts: Sql) -> Sql:
    out = 0.5
    for p in parts:
        out = out + p
    return F.least(F.lit(MAX_CONFIDENCE), out)

def _bonus(value: Sql, low: float, high: float) -> Sql:
    return F.when((value >= low) & (value <= high), 0.1).otherwise(0.0)

def _leg(x: Sql, i: int, j: int) -> Sql:
    return F.abs(x.w[i].price - x.w[j].price)

def _retrace_target(x: Sql, frm: int) -> Sql:
    last = 3 if frm == 2 else 4
    return x.w[last].price + x.dir * F.lit(TARGET_RETRACE) * _leg(x, last, frm)

def _extension_limit(x: Sql, frm: int, to: int, limit: float) -> Sql:
    """Price beyond which leg frm-to is stretched past ``limit`` plus tolerance."""
    return x.w[frm].price - x.dir * F.lit(limit + FIB_TOLERANCE) * _leg(x, frm, to)

_C = Ratio("c", (3, 2), (2, 1), low=0.382, high=0.886)

def _five_point(
    name: str, b: Ratio, d: Ratio, confidence: Callable[[Sql], Sql], extension_limit: float | None = None
) -> Template:
    """X-A-B-C-D. D ends inside XA, or beyond X when an extension limit is given."""
    inside = lambda x: x.dir * (x.w[4].price - x.w[0].price) > 0
    beyond = lambda x: x.dir * (x.w[0].price - x.w[4].price) > 0
    return Template(
        name,
        ("X", "A", "B", "C", "D"),
        0,
        (_C, b, d),
        confidence,
        lambda x: _retrace_target(x, 1),
        (lambda x: x.w[0].price)
        if extension_limit is None
        else (lambda x: _extension_limit(x, 1, 0, extension_limit)),
        inside if extension_limit is None else beyond,
    )

def _b(**kw) -> Ratio:
    return Ratio("b", (1, 2), (0, 1), **kw)

def _d(**kw) -> Ratio:
    return Ratio("d", (1, 4), (0, 1), **kw)

def _positive(x: Sql) -> Sql:
    return F.greatest(0.0, x)

def _nearest(value: Sql, anchors: Sequence[float]) -> Sql:
    """Closeness to the first anchor within tolerance."""
    out = F.when(F.abs(value - F.lit(anchors[0])) <= FIB_TOLERANCE, _near(value, anchors[0]))
    for a in anchors[1:]:
        out = out.when(F.abs(value - F.lit(a)) <= FIB_TOLERANCE, _near(value, a))
    return out

_BC = (0.618, 0.786)

# The shipped rows; their order is the order of results within a window.
HARMONICS: tuple[Template, ...] = (
    Template(
        "abcd",
        ("A", "B", "C", "D"),
        3,
        (Ratio("c", (2, 1), (1, 0), anchors=_BC), Ratio("d", (3, 2), (2, 1), low=1.272, high=1.618)),
        lambda x: _score(0.2 * _nearest(x.c, _BC), _bonus(x.d, 1.272, 1.618)),
        lambda x: _retrace_target(x, 2),
        lambda x: _extension_limit(x, 2, 1, 1.618),
    ),
    _five_point(
        "gartley",
        _b(anchors=(0.618,)),
        _d(anchors=(0.786,)),
        lambda x: _score(0.15 * _positive(_near(x.b, 0.618)), 0.2 * _positive(_near(x.d, 0.786))),
    ),
    _five_point(
        "bat",
        _b(low=0.382, high=0.5),
        _d(anchors=(0.886,)),
        lambda x: _score(0.15, 0.2 * _positive(_near(x.d, 0.886))),
    ),
    _five_point(
        "butterfly",
        _b(anchors=(0.786,)),
        _d(low=1.272, high=1.618),
        lambda x: _score(0.15 * _positive(_near(x.b, 0.786)), _bonus(x.d, 1.272, 1.618)),
        1.618,
    ),
    _five_point(
        "crab",
        _b(low=0.382, high=0.618),
        _d(anchors=(1.618,)),
        lambda x: _score(0.15, 0.2 * _positive(_near(x.d, 1.618))),
        1.618,
    ),
)

def _passes(r: Ratio, value: Sql) -> Sql:
    if r.anchors:
        ok = F.lit(False)
        for a in r.anchors:
            ok = ok | (F.abs(value - F.lit(a)) <= r.tol)
        return ok
    return (value >= r.low - r.tol) & (value <= r.high + r.tol)

def _matches(t: Template, no: int, runs: Sql, atr: Sql) -> Sql:
    """Hits of one template, tagged with the window they came from."""
    k = len(t.roles)
    c = Candidates.of(runs, w=lambda w: w)
    legs_ok = lambda x: F.forall(
        F.sequence(1, k - 1),
        lambda j: F.abs(F.get(x.w, j).price - F.get(x.w, j - 1).price) >= F.lit(MIN_LEG_ATR) * atr,
    )
    c = c.where(legs_ok)
    c = c.add(dir=lambda x: F.when(x.w[t.bullish_low_at].kind == "low", 1.0).otherwise(-1.0),
        **{
            r.name: (lambda x, r=r: F.try_divide(_leg(x, *r.num), _leg(x, *r.den)))
            for r in t.ratios
        },
    )

    def ok(x: Sql) -> Sql:
        out = t.guard(x) if t.guard else F.lit(True)
        for r in t.ratios:
            out = out & _passes(r, x[r.name])
        return out

    c = c.where(ok)
    return c.to(
        lambda x: F.struct(
            F.lit(k).alias("arity"),
            x.w[0].idx.alias("i"),
            F.lit(no).alias("no"),
            hit(
                9,
                F.when(x.dir > 0, F.lit(f"{t.name}_bullish")).otherwise(F.lit(f"{t.name}_bearish")),
                t.confidence(x),
                F.array(*[point(x.w[j], role) for j, role in enumerate(t.roles)]),
                t.target(x),
                t.invalidation(x),
            ).alias("hit"),
        ),
    )

def template_hits(zz: Sql, atr: Sql, templates: Sequence[Template] = HARMONICS) -> Sql:
    """All templates over all runs of the last twelve pivots: by arity, window, row."""
    recent = tail(zz, MAX_PIVOTS)
    found = F.concat(
        *[_matches(t, no, windows(recent, len(t.roles)), atr) for no, t in enumerate(templates)]
    )
    in_order = F.array_sort(
        found,
        lambda a, b: F.when(a.arity != b.arity, a.arity - b.arity).when(a.i != b.i, a.i - b.i).otherwise(a.no - b.no),
    )
    return when_enough(atr > 0, F.transform(in_order, lambda m: m.hit))

#: Columns of a table of templates. Pivots of a window are p0, p1, ... in the formulas, dir is 1 or -1, ratios go by their names.
TEMPLATE_SCHEMA = (
    "no int, name string, roles array<string>, bullish_low_at int, "
    "ratios array<struct<name: string, num: array<int>, den: array<int>, anchors: array<double>, low: double, high: double, tol: double>>, "
    "confidence string, target string, invalidation string, guard string"
)
#: A table of templates becomes expressions of one plan; it may have so many rows.
MOST_TEMPLATES = 500
_WORDS = {*"abs least greatest sqrt ln exp pow coalesce and or not case when then else end between is null".split()}
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(<=|>=|<>|!=|[-+*/%(),<>=]))")


def formula(text: str, values: Mapping[str, Sql]) -> Sql:
    """SQL for an arithmetic formula over named values; anything but numbers, operators, plain functions and these names is an error."""
    out, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r} in formula {text!r}")
        number, name, sign = m.groups()
        if name is not None and name not in values and name.lower() not in _WORDS:
            raise ValueError(f"unknown name {name!r} in formula {text!r}; known are {', '.join(values)}")
        out.append(sign or (str(F.lit(float(number))) if number else str(values[name]) if name in values else name))
        at = m.end()
    return Sql(f"({' '.join(out)})")


def read_templates(table: DataFrame) -> tuple[Template, ...]:
    """Templates from rows of ``TEMPLATE_SCHEMA``, in the order of no and name; extra columns are ignored.

    A ratio with anchors must lie near one of them, one without inside [low, high]; tol defaults to the usual tolerance. A null
    guard lets all pass; any other null, a pivot outside the window, a name twice or an unknown name in a formula is an error.
    """
    rows = table.select("no", "name", "roles", "bullish_low_at", "ratios", "confidence", "target", "invalidation", "guard")
    rows = rows.orderBy("no", "name").limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    if len({r["name"] for r in rows}) < len(rows):
        raise ValueError("templates need names of their own")
    return tuple(_template(r.asDict(recursive=True)) for r in rows)


def _template(row: dict) -> Template:
    missing = [k for k, v in row.items() if v is None and k not in ("no", "guard")]
    if missing:
        raise ValueError(f"template {row['name']!r} lacks {', '.join(missing)}")
    k = len(row["roles"])
    if not re.fullmatch(r"\w+", row["name"]) or not 2 <= k <= MAX_PIVOTS or not 0 <= row["bullish_low_at"] < k:
        raise ValueError(f"template {row['name']!r}: a name is a word, a window has 2 to {MAX_PIVOTS} pivots")
    ratios = []
    for r in row["ratios"]:
        ends = [*(r["num"] or ()), *(r["den"] or ())]
        if not re.fullmatch(r"[a-z]\w*", r["name"] or "") or len(r["num"] or ()) != 2 or len(ends) != 4 or not all(0 <= e < k for e in ends):
            raise ValueError(f"ratio {r['name']!r} of template {row['name']!r} needs a name and two pairs of pivots")
        if r["name"] in ("w", "dir", "hit") or re.fullmatch(r"p\d+", r["name"]) or r["name"] in _WORDS or r["name"] in {x.name for x in ratios}:
            raise ValueError(f"ratio {r['name']!r} of template {row['name']!r} has a name that is taken")
        if not r["anchors"] and (r["low"] is None or r["high"] is None):
            raise ValueError(f"ratio {r['name']!r} of template {row['name']!r} has neither anchors nor limits")
        tol = FIB_TOLERANCE if r["tol"] is None else r["tol"]
        ratios.append(Ratio(r["name"], tuple(r["num"]), tuple(r["den"]), tuple(r["anchors"] or ()), r["low"] or 0.0, r["high"] or 0.0, tol))

    def said(text: str, known: tuple[Ratio, ...] = tuple(ratios)) -> Callable[[Sql], Sql]:
        bound = lambda x: {**{f"p{i}": x.w[i].price for i in range(k)}, "dir": x.dir, **{r.name: x[r.name] for r in known}}
        formula(text, bound(Sql("x")))  # errors come when the table is read
        return lambda x: formula(text, bound(x))

    formulas = [said(row[name]) for name in ("confidence", "target", "invalidation")]
    return Template(row["name"], tuple(row["roles"]), row["bullish_low_at"], tuple(ratios), *formulas, said(row["guard"]) if row["guard"] else None)


def _texts(t: Template) -> tuple:
    """A shipped template as a row, its formulas spelled over p0, p1, ... and the ratios' names."""
    k = len(t.roles)

    class Spelled:
        dir = Sql("dir")
        w = tuple(type("Pivot", (), {"price": Sql(f"p{i}")}) for i in range(k))

        def __getattr__(self, name: str) -> Sql:
            return Sql(name)

    plain = lambda f: re.sub(r"(?<=\d)D\b", "", str(f(Spelled()))) if f else None
    ratios = [(r.name, list(r.num), list(r.den), list(r.anchors), r.low, r.high, r.tol) for r in t.ratios]
    return t.name, list(t.roles), t.bullish_low_at, ratios, plain(t.confidence), plain(t.target), plain(t.invalidation), plain(t.guard)


def template_table(spark: SparkSession, templates: Sequence[Template] = HARMONICS) -> DataFrame:
    """The shipped templates as a table that users store, edit and extend."""
    return spark.createDataFrame([(no, *_texts(t)) for no, t in enumerate(templates)], TEMPLATE_SCHEMA)


__all__ = ["HARMONICS", "Ratio", "Template", "read_templates", "template_hits", "template_table"]
