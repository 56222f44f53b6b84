"""Residuals in two stages: all series against the market, then each stock's residuals against its sector's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reshape import drop_all_missing_long
from ..sources.shared import checkpointed
from .pit import pit_robust_betas, pit_robust_betas_by_group


def two_stage(rets: DataFrame, market: str, sectors: DataFrame, half_life: float = 126, min_timestamps: int = 63, rebalance: DataFrame | None = None) -> dict[str, DataFrame]:
    """rets (ts, asset, ret) with the market and the sectors among the assets; sectors (stock, sector).

    market: the first stage's results; sector: the second stage's, of all stocks in one job (column stock is the group); components
    (ts, stock, total, market, sector, residual): each stock's return split, where all parts are there."""
    factor = rets.where(F.col("asset") == market).select("ts", F.lit("MARKET").alias("factor"), "ret")
    first = pit_robust_betas(rets.where(F.col("asset") != market), factor, half_life=half_life, min_timestamps=min_timestamps, rebalance=rebalance)
    # the second stage's checks, windows and fits all read the residuals
    left = checkpointed(drop_all_missing_long(first["resid"], ["timestamp"], "resid").select(F.col("timestamp").alias("ts"), "asset", F.col("resid").alias("ret")))
    stocks = left.join(sectors, F.col("asset") == F.col("stock")).select("ts", "stock", "asset", "ret")
    own = left.join(sectors, F.col("asset") == F.col("sector")).select("ts", "stock", F.lit("SECTOR").alias("factor"), "ret")
    second = pit_robust_betas_by_group(stocks, own, "stock", half_life=half_life, min_timestamps=min_timestamps, rebalance=rebalance)
    total = rets.join(sectors, F.col("asset") == F.col("stock")).select("ts", "stock", F.col("ret").alias("total"))
    a = first["hedge"].select(F.col("timestamp").alias("ts"), F.col("asset").alias("stock"), (-F.col("hedge_ret")).alias("market"))
    b = second["hedge"].select(F.col("timestamp").alias("ts"), "stock", (-F.col("hedge_ret")).alias("sector"))
    c = second["resid"].select(F.col("timestamp").alias("ts"), "stock", F.col("resid").alias("residual"))
    keys = ["ts", "stock"]
    parts = total.join(a, keys).join(b, keys).join(c, keys).na.drop("any", subset=["total", "market", "sector", "residual"])
    return {"market": first, "sector": second, "components": parts}
