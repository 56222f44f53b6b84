"""Exponentially weighted Huber betas of assets on shared factors, over one window or over the windows that end at given times.

Tables are long: assets (ts, asset, ret), factors (ts, factor, ret). A group column, where given, runs independent problems side by side, each with
its own factors. One asset's history is fitted for a block of windows at once, so it crosses the network once for each block.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.finite import finite, is_finite
from ..functions.huber import fit_windows
from ..functions.weights import decay
from ..sources.shared import checkpointed
from .checks import require_panel

_LOG = logging.getLogger(__name__)

#: Sample variance below which a factor counts as flat.
FLAT = 1e-10

#: States of a window, in the order in which they are tested.
PERFECT, FIT_ERROR = "perfect_fit", "fit_error"
OK, NO_DATA, INCOMPLETE, NO_ASSETS, FLAT_FACTOR, FEW_ROWS, FLAT_WINDOW = "ok", "no_data", "incomplete_factors", "no_assets", "flat_factor", "few_rows", "flat_window"


def factor_rows(factors: DataFrame, names: Sequence[str], order: str, by: str) -> DataFrame:
    """(by, order, x, complete, pos): each time's factors as an array in the order of names, whether all are finite, and the row number from 1."""
    one = lambda n: F.max(F.when(F.col("factor") == n, F.struct("ret")))["ret"]
    wide = factors.groupBy(by, order).agg(F.array(*[one(n) for n in names]).alias("x"))
    w = Window.partitionBy(by).orderBy(order)
    return wide.withColumn("complete", F.forall("x", lambda v: is_finite(v))).withColumn("pos", F.row_number().over(w))


def window_states(rows: DataFrame, assets: DataFrame, times: DataFrame, k: int, order: str, by: str, min_timestamps: int) -> DataFrame:
    """(by, t, n, state) of the window that ends at each time: n rows of the index, and whether it can be fitted. Growing windows over the factor
    rows give counts and variances; a time takes the latest row not after it."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = [F.col("x")[j] for j in range(k)]
    full = lambda v: F.when(F.col("complete"), v)
    flat = lambda vs: F.coalesce(F.least(*vs) if len(vs) > 1 else vs[0], F.lit(float("inf"))) < FLAT
    stats = rows.select(
        by,
        F.col(order).alias("t"),
        F.col("pos").alias("n"),
        sum([(F.count(v).over(w) > 0).cast("int") for v in x], F.lit(0)).alias("live"),
        flat([F.var_samp(finite(v)).over(w) for v in x]).alias("flat"),
        F.count(full(F.lit(1))).over(w).alias("complete"),
        flat([F.var_samp(full(v)).over(w) for v in x]).alias("flat_complete"),
    )
    first = assets.where(F.col("ret").isNotNull()).groupBy(by).agg(F.min(order).alias("first_asset"))
    asked = times.withColumn("asked", F.lit(True))
    both = stats.withColumn("s", F.struct("n", "live", "flat", "complete", "flat_complete")).select(by, "t", "s").join(asked, [by, "t"], "full_outer")
    known = both.withColumn("s", F.last("s", ignorenulls=True).over(Window.partitionBy(by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    known = known.where("asked").join(first, by, "left").select(by, "t", "s.*", "first_asset")
    state = (
        F.when(F.col("n").isNull(), NO_DATA)
        .when(F.col("live") < k, INCOMPLETE)
        .when(F.col("first_asset").isNull() | (F.col("first_asset") > F.col("t")), NO_ASSETS)
        .when(F.col("flat"), FLAT_FACTOR)
        .when(F.col("complete") < min_timestamps, FEW_ROWS)
        .when((F.col("complete") < 2) | F.col("flat_complete"), FLAT_WINDOW)
        .otherwise(OK)
    )
    return known.select(by, "t", F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


def check_windows(states: DataFrame, half_life: float | None, lambda_: float | None) -> bool:
    """Raises for the earliest window in which a factor doesn't move, or whose weights can't be had; else whether there is one to fit."""
    at = {r["state"]: r["t"] for r in states.where(F.col("state").isin(FLAT_FACTOR, OK)).groupBy("state").agg(F.min("t").alias("t")).collect()}
    problem: tuple | None = (at[FLAT_FACTOR], "a factor has near-zero variance") if FLAT_FACTOR in at else None
    if OK in at:
        try:
            decay(half_life, lambda_)
        except ValueError as e:
            problem = min(problem, (at[OK], str(e))) if problem else (at[OK], str(e))
    if problem:
        raise ValueError(f"Error processing timestamp {problem[0]}: {problem[1]}")
    return OK in at


def small_side(df: DataFrame, single: bool) -> DataFrame:
    """One group's calendar table (a row a time, or a time and factor) goes to all tasks; those of many groups together are as large as a panel."""
    return F.broadcast(df) if single else df


def fit_states(assets: DataFrame, rows: DataFrame, states: DataFrame, names: Sequence[str], order: str, by: str, half_life: float | None, lambda_: float | None, min_timestamps: int, blocks: int | None = None, single: bool = False, n_jobs: int = -1) -> DataFrame:
    """(by, t, factor, asset, beta, fit) of the windows that are ok and have rows enough: an asset's usable rows meet its windows in one group for each block
    of windows. single: there is one group. n_jobs > 0: the partitions that fit. fit: how each went, OK, PERFECT or FIT_ERROR (then beta is NULL)."""
    names = list(names)
    lam = decay(half_life, lambda_)
    usable = assets.where(is_finite("ret")).join(small_side(rows.where("complete"), single), [by, order]).select(by, "asset", F.col("ret").alias("y"), "x", "pos")
    who = assets.select(by, "asset").distinct()
    pin_threads(assets.sparkSession)
    if blocks is None:
        # as many groups as keep all cores busy, each at the price of one more copy of the history
        blocks = max(1, min(16, -(-2 * assets.sparkSession.sparkContext.defaultParallelism // max(1, who.count()))))
    block = F.pmod(F.xxhash64("t"), F.lit(blocks)).cast("int") if blocks > 1 else F.lit(0)
    windows = who.join(small_side(states.where(F.col("state") == OK).select(by, "t", "n", block.alias("block")), single), by)
    # new attributes: both sides of the cogroup come from the same table
    windows = windows.select(*[F.col(c).alias(c) for c in (by, "t", "n", "block", "asset")])
    history = usable.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else usable.withColumn("block", F.lit(0))
    if n_jobs > 0:
        history, windows = (x.repartition(n_jobs, by, "asset", "block") for x in (history, windows))

    def fit(h: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        times, betas, fits = w["t"].iloc[:0], np.zeros((0, len(names))), np.zeros(0, object)
        if len(h) and len(w):
            h, w = h.sort_values("pos"), w.sort_values("t")
            pos, y = h["pos"].to_numpy(), h["y"].to_numpy(np.float64)
            x = np.column_stack([np.ones(len(h)), np.stack(h["x"].to_list()).astype(np.float64)])
            w = w[np.searchsorted(pos, w["n"].to_numpy(), "right") >= min_timestamps]
            n, parts = w["n"].to_numpy(), []
            norm = np.cumsum(lam ** np.arange(n.max() if len(n) else 1))
            step = max(1, 1_000_000 // len(h))
            for a in range(0, len(w), step):
                m = n[a : a + step, None]
                inside = pos[None, :] <= m
                sw = np.sqrt(np.where(inside, lam ** np.maximum(0, m - pos), 0.0) / norm[m - 1])
                parts.append(_betas(y, x, sw, inside))
            if parts:
                times, betas, fits = w["t"], np.concatenate([p[0][:, 1:] for p in parts]), np.concatenate([p[1] for p in parts])
        k, k_names = len(times), len(names)
        own = {c: h[c].iloc[0] if len(h) else None for c in (by, "asset")}
        value = pd.Series(betas.ravel(), dtype="Float64").mask(~np.isfinite(betas.ravel()))
        return pd.DataFrame({by: pd.Series([own[by]] * (k * k_names), dtype=object), "t": times.repeat(k_names).reset_index(drop=True), "factor": pd.Series(names * k, dtype=object), "asset": pd.Series([own["asset"]] * (k * k_names), dtype=object), "beta": value, "fit": pd.Series(np.repeat(fits, k_names), dtype=object)})

    kind = f"{by} string, t {states.schema['t'].dataType.simpleString()}, factor string, asset string, beta double, fit string"
    return history.groupBy(by, "asset", "block").cogroup(windows.groupBy(by, "asset", "block")).applyInPandas(fit, kind)


def _betas(y: np.ndarray, x: np.ndarray, sw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Constant and betas of each window, and how its fit went; a window whose fit fails has none and spoils no other."""
    try:
        beta, perfect = fit_windows(y, x, sw, inside)
        return beta, np.where(np.isfinite(beta).all(1), np.where(perfect, PERFECT, OK), FIT_ERROR).astype(object)
    except (np.linalg.LinAlgError, ZeroDivisionError) as e:
        if len(sw) == 1:
            _LOG.warning("a fit of %d rows failed: %s", int(inside.sum()), e)
            return np.full((1, x.shape[1]), np.nan), np.array([FIT_ERROR], object)
        parts = [_betas(y, x, sw[k : k + 1], inside[k : k + 1]) for k in range(len(sw))]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def pin_threads(spark) -> None:
    """One thread for each worker's linear algebra, unless the session says otherwise: tasks already take all cores."""
    for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        spark.sparkContext.environment.setdefault(k, "1")


def names_of(factors: DataFrame) -> list[str]:
    """The factors in the order of their names. Factors are few: one design holds them all."""
    return [r["factor"] for r in factors.select("factor").distinct().orderBy("factor").collect()]


def long_form(df: DataFrame, key: str, order: str, by: str, group: Column | None = None) -> DataFrame:
    """The columns that fits need, NaN as NULL."""
    ret = F.col("ret").cast("double")
    return df.select((F.lit("") if group is None else group).cast("string").alias(by), order, F.col(key).cast("string").alias(key), F.when(~F.isnan(ret), ret).alias("ret"))


def stored_panel(a: DataFrame, f: DataFrame, order: str, by: str) -> tuple[DataFrame, DataFrame]:
    """Both long tables, written in one job: factors are often made from the assets, and what they share is then computed once."""
    if a.schema[order].dataType != f.schema[order].dataType:
        return checkpointed(a), checkpointed(f)
    side = lambda df, key, n: df.select(F.lit(n).alias("_side"), by, order, F.col(key).alias("_name"), "ret")
    both = checkpointed(side(a, "asset", 0).union(side(f, "factor", 1)))
    return tuple(both.where(F.col("_side") == n).select(by, order, F.col("_name").alias(key), "ret") for n, key in enumerate(("asset", "factor")))


def robust_betas(assets: DataFrame, factors: DataFrame, half_life: float | None = None, lambda_: float | None = None, min_timestamps: int = 10, order_col: str = "ts", n_jobs: int = -1) -> DataFrame:
    """(factor, asset, beta): one fit of each asset over all rows, which order_col puts in order (times or any other). beta is NULL where there are too few
    usable rows or the fit fails. n_jobs > 0: the number of partitions that fit."""
    if min_timestamps < 1:
        raise ValueError("min_timestamps must be at least 1")
    by = "_g"
    a, f = stored_panel(long_form(assets, "asset", order_col, by), long_form(factors, "factor", order_col, by), order_col, by)
    require_panel(a, f, order_col)
    names = names_of(f)
    rows = factor_rows(f, names, order_col, by)
    last = f.groupBy(by).agg(F.max(order_col).alias("t"))
    # a factor without any value has no rows to complete: no betas, as below the least number of rows
    states = checkpointed(window_states(rows, a, last, len(names), order_col, by, min_timestamps))
    every = a.select("asset").distinct().join(F.broadcast(f.select("factor").distinct()), F.lit(True))
    if not check_windows(states, half_life, lambda_):
        return every.select("factor", "asset", F.lit(None).cast("double").alias("beta"))
    beta = fit_states(a, rows, states, names, order_col, by, half_life, lambda_, min_timestamps, blocks=1, single=True, n_jobs=n_jobs)
    return every.join(beta.select("factor", "asset", "beta"), ["factor", "asset"], "left").select("factor", "asset", "beta")


def parallel_robust_betas(assets: DataFrame, factors: DataFrame, half_life: float | None = None, lambda_: float | None = None, min_timestamps: int = 10, n_jobs: int = -1, **more) -> DataFrame:
    """The same: the cluster is the pool."""
    return robust_betas(assets, factors, half_life, lambda_, min_timestamps, n_jobs=n_jobs, **more)
