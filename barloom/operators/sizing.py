"""Position sizing and the watchlist volatility scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vol_stats(rows: DataFrame) -> DataFrame:
    """Scan rows to last price, last-session change, ATR, ATR% and realized volatility."""
    last, prev = F.col("last_close"), F.coalesce("prev_close", "last_close")
    return rows.select(
        "symbol",
        last.alias("last"),
        (F.try_divide(last - prev, prev) * 100).alias("day_change_pct"),
        F.col("end_atr").alias("atr"),
        (F.try_divide(F.col("end_atr"), last) * 100).alias("atr_pct"),
        "realized_vol",
    )


def position_size(plans: DataFrame, strict: bool = True) -> DataFrame:
    """Size planned trades: account_size, risk_pct, entry_price, stop_loss, target_price, commission_per_side.

    A stop at the entry has no distance to size by: an error when ``strict``, else a
    row with NULL results.
    """
    entry, stop = F.col("entry_price"), F.col("stop_loss")
    distance = F.abs(entry - stop)
    if strict:
        distance = F.when(distance != 0, distance).otherwise(
            F.raise_error(F.lit("entry_price and stop_loss cannot be the same")).cast("double")
        )
    else:
        distance = F.nullif(distance, F.lit(0.0))
    fees = F.coalesce("commission_per_side", F.lit(0.0)) * 2
    df = plans.withColumns(
        {
            "stop_distance": distance,
            "max_dollar_risk": F.col("account_size") * F.col("risk_pct") / 100,
            "reward_distance": F.abs(F.col("target_price") - entry),
        }
    ).withColumn("shares", F.floor(F.col("max_dollar_risk") / F.col("stop_distance")))
    shares, reward = F.col("shares"), F.col("reward_distance")
    df = df.withColumns(
        {
            "side": F.when(entry > stop, F.lit("long")).otherwise(F.lit("short")),
            "position_value": shares * entry,
            "actual_dollar_risk": shares * F.col("stop_distance") + fees,
            "risk_reward": reward / F.col("stop_distance"),
            "potential_profit": shares * reward - fees,
        }
    )
    return df.withColumns(
        {
            "position_pct_of_account": F.col("position_value") / F.col("account_size") * 100,
            "risk_pct_of_account": F.col("actual_dollar_risk") / F.col("account_size") * 100,
            "breakeven_winrate_pct": F.lit(100.0) / (F.lit(1.0) + F.col("risk_reward")),
        }
    ).drop("reward_distance")
