"""All detectors over scan rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from barloom.functions.rows import each
from barloom.functions.sql import F, Sql
from barloom.operators.patterns.basins import cup_handle_hits, rounding_bottom_hits, rounding_unless_cup
from barloom.operators.patterns.breach import breach_guard
from barloom.operators.patterns.channels import channel_hits, wedge_hits
from barloom.operators.patterns.doubles import double_triple_hits
from barloom.operators.patterns.gaps import gap_hits
from barloom.operators.patterns.hits import when_enough
from barloom.operators.patterns.swings import flag_hits, head_shoulders_hits, triangle_hits
from barloom.operators.patterns.templates import HARMONICS, Template, template_hits

# Fixed value: shorter series carry no patterns.
MIN_BARS = 10


def detector_columns(templates: Sequence[Template] = HARMONICS) -> dict[str, Sql]:
    """Each detector family as an array-of-hits column over a scan row, in result order."""
    bars, n, zz = F.col("bars"), F.col("n"), F.col("zz")
    highs, lows, atr, close = F.col("highs"), F.col("lows"), F.col("last_atr"), F.col("last_close")
    columns = {
        "head_shoulders": head_shoulders_hits(highs, lows),
        "double_triple": double_triple_hits(zz, atr, close),
        "triangles": triangle_hits(highs, lows),
        "flags": flag_hits(bars, n),
        "channels": channel_hits(bars, n, F.col("swings"), zz, atr, close),
        "wedges": wedge_hits(bars, n, zz, atr),
        "cup_handle": cup_handle_hits(bars, n, zz, atr, close),
        "rounding_bottom": rounding_bottom_hits(bars, n, atr, close),
        "templates": template_hits(zz, atr, templates),
        "gaps": gap_hits(F.col("gaps"), n),
    }
    return {k: when_enough(n >= MIN_BARS, v) for k, v in columns.items()}


def with_detector(rows: DataFrame, *names: str, templates: Sequence[Template] = HARMONICS) -> DataFrame:
    """Scan rows plus the ``hits`` of the named families, before the breach guard."""
    cols = detector_columns(templates)
    return rows.withColumn("hits", F.concat(*[cols[n] for n in names]).column())


def with_patterns(rows: DataFrame, templates: Sequence[Template] = HARMONICS) -> DataFrame:
    """Scan rows plus ``patterns``: all detectors in fixed order, breached hits removed."""
    cols = detector_columns(templates)
    rows = rows.withColumn("_cup", cols["cup_handle"].column())
    rounding = rounding_unless_cup(F.col("_cup"), cols["rounding_bottom"])
    rows = rows.withColumn(
        "_all",
        F.concat(
            cols["head_shoulders"],
            cols["double_triple"],
            cols["triangles"],
            cols["flags"],
            cols["channels"],
            cols["wedges"],
            F.col("_cup"),
            rounding,
            cols["templates"],
            cols["gaps"],
        ).column(),
    )
    return rows.withColumn("patterns", breach_guard(F.col("_all"), F.col("bars")).column()).drop("_cup", "_all")


def hit_rows(rows: DataFrame, column: str = "patterns") -> DataFrame:
    """One row per hit."""
    return each(rows, column, "symbol", no="hit_no").select("symbol", "hit_no", "x.*")


def hit_points(hits: DataFrame) -> DataFrame:
    """One row per anchor of every hit."""
    keep = ("symbol", "hit_no", "kind")
    return each(hits, "points", *keep, no="point_no").select(*keep, "point_no", "x.ts", "x.price", "x.role")
