"""Recursive filters y[t] = a*y[t-1] + b[t] as window sums."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.layout import Layout

# Powers run from exp(-650) to exp(+650), far inside double range.
_MAX_EXPONENT = 1300.0
# a**k below exp(-40) is lost against one unit in the last place.
_FORGET = 40.0


def memory(a: float) -> int:
    """Bars after which the filter has forgotten its start."""
    return math.ceil(_FORGET / -math.log(a))


@dataclass(frozen=True)
class Filter:
    """Decay ``a``, input ``b``, and from which bar on the output is defined."""

    a: float
    b: Column
    from_bar: int = 0

    @property
    def run(self) -> int:
        return int(_MAX_EXPONENT / -math.log(self.a))

    def visible(self, value: Column) -> Column:
        return F.when(F.col("bar_idx") >= self.from_bar, value) if self.from_bar else value


def in_one_run(layout: Layout, f: Filter) -> bool:
    return layout.max_rows is not None and layout.max_rows <= f.run


def scanned(f: Filter, window: WindowSpec, pos: Column, rows: int) -> Column:
    """``a**pos * sum(b * a**-pos)`` as one running sum, with powers centred on the group's middle."""
    k = pos - F.lit(rows // 2)
    return F.pow(F.lit(f.a), k) * F.sum(f.b * F.pow(F.lit(f.a), -k)).over(window)


def affine_scan(layout: Layout, filters: dict[str, Filter]) -> Layout:
    """Add every filter's output column, computed along each group of the layout.

    Where a group may be long enough for the powers to overflow, it is cut into runs;
    each run adds the decayed end value of the run before it (older runs are below
    double precision).
    """
    short = {n: f for n, f in filters.items() if in_one_run(layout, f)}
    if short:
        layout = layout.with_columns(
            {
                n: f.visible(scanned(f, layout.ordered, F.col("pos"), layout.max_rows))
                for n, f in short.items()
            }
        )
    for n, f in filters.items():
        if n not in short:
            layout = _scan_in_runs(layout, n, f)
    return layout


def _scan_in_runs(layout: Layout, name: str, f: Filter) -> Layout:
    a, j = F.lit(f.a), F.col(f"_{name}_j")
    layout = layout.with_columns(
        {
            f"_{name}_run": F.floor(F.col("pos") / F.lit(f.run)),
            f"_{name}_j": F.col("pos") % F.lit(f.run),
        }
    )
    in_run = Window.partitionBy(*layout.keys, f"_{name}_run").orderBy("pos")
    local = f"_{name}_local"
    layout = layout.with_columns({local: scanned(f, in_run, j, f.run)})
    # Ordered by (run, pos), which is bar order and the order the rows are already in.
    so_far = Window.partitionBy(*layout.keys).orderBy(f"_{name}_run", "pos").rowsBetween(Window.unboundedPreceding, -1)
    run_end = F.last(F.when(j == f.run - 1, F.col(local)), ignorenulls=True).over(so_far)
    carried = F.coalesce(run_end, F.lit(0.0)) * F.pow(a, j + 1)
    return layout.with_columns({name: f.visible(F.col(local) + carried)})
