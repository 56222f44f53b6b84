"""Point-in-time betas, hedge returns and residuals as one lazy plan behind a few small checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.finite import finite_variance, is_finite
from ..operators import betas as B
from ..operators.checks import require_panel, require_time, require_unique
from ..operators.reshape import fill_constant
from ..sources.shared import checkpointed


def check_panel(assets: DataFrame, factors: DataFrame, rebalance: DataFrame | None, order: str = "ts") -> None:
    """The input rules in their order, each a ValueError."""
    require_time(assets, order, "assets")
    require_time(factors, order, "factors")
    require_panel(assets, factors, order)
    stats = factors.groupBy("factor").agg(F.count_if(is_finite("ret")).alias("n"), finite_variance("ret").alias("v"))
    bad = stats.where((F.col("n") == 0) | (F.col("v") < B.FLAT)).orderBy("factor").collect()
    if dead := [r["factor"] for r in bad if r["n"] == 0]:
        raise ValueError(f"nothing can be fitted on factors without a single finite value: {dead}")
    if bad:
        raise ValueError(f"factors that never move (variance below {B.FLAT:g}): {[r['factor'] for r in bad]}")
    if rebalance is not None:
        require_unique(rebalance, ["t"], "a rebalance time may be given once only")


def pit_robust_betas(assets: DataFrame, factors: DataFrame, half_life: float | None = None, lambda_: float | None = None, min_timestamps: int = 10, fill_missing_betas: bool = False, rebalance: DataFrame | None = None, blocks: int | None = None, checks: bool = True) -> dict[str, DataFrame]:
    """assets (ts, asset, ret), factors (ts, factor, ret), rebalance (t), by default every time of the index.

    betas (timestamp, factor, asset, beta): fitted on what was known at each rebalance time that is in the index, carried forward;
    hedge_by_factor (timestamp, factor, asset, hedge_ret): minus the beta of the row before times the factor's return;
    hedge (timestamp, asset, hedge_ret): their sum over the factors that have one; resid (timestamp, asset, resid): return plus hedge;
    status (t, n, state): of each rebalance time's window; fits (t, asset, fit): how each window's fit of an asset went (betas.OK, PERFECT, FIT_ERROR),
    for those with rows enough. The panel and the windows' states are written to the checkpoint folder once, the checks run at once, and the frames are
    lazy beyond that; missing values are NULL."""
    if min_timestamps < 1:
        raise ValueError("min_timestamps must be at least 1")
    by = "_g"
    if checks:
        require_time(assets, "ts", "assets")
        require_time(factors, "ts", "factors")
    # checks, windows, fits and algebra all read the panel
    a, f = B.stored_panel(B.long_form(assets, "asset", "ts", by), B.long_form(factors, "factor", "ts", by), "ts", by)
    if checks:
        check_panel(a, f, rebalance)
    out = _panel(a, f, None if rebalance is None else rebalance.select(F.lit("").alias(by), "t"), half_life, lambda_, min_timestamps, fill_missing_betas, blocks, by, single=True)
    return {k: v.drop(by) for k, v in out.items()}


def pit_robust_betas_by_group(assets: DataFrame, factors: DataFrame, group: str, half_life: float | None = None, lambda_: float | None = None, min_timestamps: int = 10, fill_missing_betas: bool = False, rebalance: DataFrame | None = None) -> dict[str, DataFrame]:
    """Independent panels side by side in one job: assets and factors have the column `group`, and each group is fitted on its own factors, all of them
    having the same factor names. rebalance: (t), for every group from its first time on."""
    by = "_g"
    a, f = B.stored_panel(B.long_form(assets, "asset", "ts", by, F.col(group)), B.long_form(factors, "factor", "ts", by, F.col(group)), "ts", by)
    require_unique(a, [by, "ts", "asset"], "more than one row for a group, time and asset")
    require_unique(f, [by, "ts", "factor"], "more than one row for a group, time and factor")
    times = None
    if rebalance is not None:
        first = a.groupBy(by).agg(F.min("ts").alias("_first"))
        times = first.join(F.broadcast(rebalance), F.col("t") >= F.col("_first")).select(by, "t")  # a calendar is broadcast, not the groups
    out = _panel(a, f, times, half_life, lambda_, min_timestamps, fill_missing_betas, None, by)
    return {k: v.withColumnRenamed(by, group) for k, v in out.items()}


def _panel(a: DataFrame, f: DataFrame, times: DataFrame | None, half_life, lambda_, min_timestamps: int, fill: bool, blocks: int | None, by: str, single: bool = False) -> dict[str, DataFrame]:
    names = B.names_of(f)
    index = a.select(by, "ts").distinct()
    times = index.select(by, F.col("ts").alias("t")) if times is None else times
    rows = B.factor_rows(f, names, "ts", by)
    states = B.window_states(rows, a, times, len(names), "ts", by, min_timestamps)
    # an index with fewer rows than the minimum is not looked at
    enough = index.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_timestamps).select(by)
    # a row for each rebalance time; every output reads it
    states = checkpointed(states.join(F.broadcast(enough), by, "left_semi"))
    factor = f.select(by, "factor").distinct()
    members = a.groupBy(by, "asset").agg(F.min(F.when(F.col("ret").isNotNull(), F.col("ts"))).alias("first"))
    # every time, factor and asset has a row of the result: each series' row is multiplied by its group's calendar and factors
    calendar = index.groupBy(by).agg(F.collect_list("ts").alias("_times"))
    grid = members.join(B.small_side(calendar, single), by).withColumn("ts", F.explode("_times")).drop("_times").join(B.small_side(factor, single), by)
    if not B.check_windows(states, half_life, lambda_):
        fitted = grid.select(by, "ts", "factor", "asset").where(F.lit(False)).withColumn("beta", F.lit(None).cast("double")).withColumn("fit", F.lit(""))
    else:
        fitted = B.fit_states(a, rows, states, names, "ts", by, half_life, lambda_, min_timestamps, blocks, single)
        fitted = fitted.select(by, F.col("t").alias("ts"), "factor", "asset", "beta", "fit")
    fits = fitted.groupBy(by, F.col("ts").alias("t"), "asset").agg(F.first("fit").alias("fit"))
    panel = grid.join(fitted.drop("fit"), [by, "ts", "factor", "asset"], "left")
    if fill:
        fit_time = states.where(F.col("state") == B.OK).select(by, F.col("t").alias("ts"), F.lit(True).alias("_fit"))
        live = F.col("first").isNotNull() & (F.col("first") <= F.col("ts"))
        panel = fill_constant(panel.join(B.small_side(fit_time, single), [by, "ts"], "left"), [by, "ts", "factor"], "beta", 1.0, F.col("_fit") & live)
    w = Window.partitionBy(by, "factor", "asset").orderBy("ts")
    panel = panel.select(by, "ts", "factor", "asset", F.last("beta", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("beta"))
    betas = panel.select(by, F.col("ts").alias("timestamp"), "factor", "asset", "beta")
    weight = panel.withColumn("weight", -F.lag("beta", 1).over(w))
    hedge_by = weight.join(B.small_side(f.select(by, "ts", "factor", "ret"), single), [by, "ts", "factor"], "left").select(by, F.col("ts").alias("timestamp"), "factor", "asset", (F.col("weight") * F.col("ret")).alias("hedge_ret"))
    hedge = hedge_by.groupBy(by, "timestamp", "asset").agg(F.sum("hedge_ret").alias("hedge_ret"))
    resid = hedge.join(a.select(by, F.col("ts").alias("timestamp"), "asset", "ret"), [by, "timestamp", "asset"], "left").select(by, "timestamp", "asset", (F.col("ret") + F.col("hedge_ret")).alias("resid"))
    return {"betas": betas, "hedge_by_factor": hedge_by, "hedge": hedge, "resid": resid, "status": states, "fits": fits}
