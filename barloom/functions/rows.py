"""From array columns back to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as pf

from barloom.functions.sql import Sql


def each(df: DataFrame, array: str | Sql, *keep: str | Column, no: str = "no", value: str = "x") -> DataFrame:
    """One row per array element with its position.

    The outer form plus a filter on the position keeps the optimizer from deriving a
    "not empty" filter, which it would push below the projections and thereby
    evaluate the whole analysis a second time.
    """
    source = array.column() if isinstance(array, Sql) else array
    return df.select(*keep, pf.posexplode_outer(source).alias(no, value)).where(pf.col(no).isNotNull())


def each_struct(df: DataFrame, array: str | Sql, *keep: str | Column) -> DataFrame:
    """One row per struct, its fields as columns."""
    return each(df, array, *keep, no="_no", value="_x").select(*keep, "_x.*")
