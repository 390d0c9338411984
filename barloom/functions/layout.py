"""How a long table of series is cut up so that ordered work stays distributed.

Two layouts share one set of operators:

* ``series_layout`` - one group per symbol. For series whose length is bounded,
  by a lookback or by calendar time over bar length.
* ``block_layout`` - groups of ``block`` consecutive bars plus a halo of earlier
  (and later) bars. For stored tables where one symbol may hold a large share of
  all rows: no task ever sees more than ``block + halo`` bars of a symbol.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.sources.resample import order_columns


def index_bars(candles: DataFrame, chunk_seconds: int | None = None) -> DataFrame:
    """Add ``bar_idx``: the zero-based position of a bar within its symbol.

    With ``chunk_seconds`` positions come from row numbers inside (symbol, time
    chunk) plus the number of rows in earlier chunks, so only the small per-chunk
    counts are ever ordered per symbol.
    """
    order = order_columns(candles)
    if chunk_seconds is None:
        w = Window.partitionBy("symbol").orderBy(*order)
        return candles.withColumn("bar_idx", F.row_number().over(w) - 1)
    chunk = F.floor(F.unix_seconds("ts") / F.lit(chunk_seconds))
    earlier = F.sum("_rows").over(
        Window.partitionBy("symbol").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        candles.groupBy("symbol", chunk.alias("_chunk"))
        .agg(F.count("*").alias("_rows"))
        .select("symbol", "_chunk", F.coalesce(earlier, F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("symbol", "_chunk").orderBy(*order)
    return (
        candles.withColumn("_chunk", chunk)
        .withColumn("_rn", F.row_number().over(inside) - 1)
        .join(offsets, ["symbol", "_chunk"])
        .withColumn("bar_idx", F.col("_before") + F.col("_rn"))
        .drop("_chunk", "_rn", "_before")
    )


@dataclass(frozen=True)
class Layout:
    """Bars with ``bar_idx``, ``pos`` (position within the group) and ``own`` (not halo)."""

    df: DataFrame
    keys: tuple[str, ...]
    max_rows: int | None

    def with_df(self, df: DataFrame) -> Layout:
        return Layout(df, self.keys, self.max_rows)

    def with_columns(self, columns: dict) -> Layout:
        return self.with_df(self.df.withColumns(columns))

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy("pos")

    def frame(self, first: int, last: int) -> WindowSpec:
        return self.ordered.rowsBetween(first, last)

    @property
    def later(self) -> WindowSpec:
        """All strictly later rows: a running frame over the reversed order, linear in the
        group size (frames that end at the last row are re-evaluated for every row)."""
        newest_first = Window.partitionBy(*self.keys).orderBy(F.desc("pos"))
        return newest_first.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def bars(self) -> DataFrame:
        """The bars themselves, without halo rows, layout columns and intermediate results."""
        out = self.df.where("own") if "block" in self.keys else self.df
        return out.drop("pos", "own", "block", *[c for c in out.columns if c.startswith("_")])


def series_layout(indexed: DataFrame, max_rows: int | None = None) -> Layout:
    return Layout(indexed.withColumn("pos", F.col("bar_idx")), ("symbol",), max_rows)


def block_layout(indexed: DataFrame, before: int, after: int = 0, block: int | None = None) -> Layout:
    """Copy every bar into the blocks that need it: its own and, as halo, its neighbours."""
    size = block or max(2048, 4 * (before + after))
    if size <= before:
        raise ValueError("a block must be longer than its leading halo")
    i = F.col("bar_idx")
    first = F.greatest(F.lit(0), F.floor((i - after) / F.lit(size)).cast("bigint"))
    last = F.floor((i + before) / F.lit(size)).cast("bigint")
    spread = indexed.withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.lit(0), F.col("block") * size - before)
    df = spread.withColumns(
        {
            "pos": F.col("bar_idx") - start,
            "own": F.floor(F.col("bar_idx") / F.lit(size)) == F.col("block"),
        }
    )
    return Layout(df, ("symbol", "block"), size + before + after)
