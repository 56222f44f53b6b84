"""Exponential decay weights."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decay(half_life: float | None = None, lambda_: float | None = None) -> float:
    """The factor of one row of age. lambda_ wins, but a half_life that is given must be positive all the same."""
    if half_life is None and lambda_ is None:
        raise ValueError("give half_life or lambda_")
    if half_life is not None and half_life <= 0:
        raise ValueError("half_life must be above 0")
    if lambda_ is not None and not 0 < lambda_ < 1:
        raise ValueError("lambda_ must lie between 0 and 1")
    return math.exp(math.log(0.5) / half_life) if lambda_ is None else lambda_


def exponential_weights(n: int, half_life: float | None = None, lambda_: float | None = None) -> np.ndarray:
    """n weights that add up to 1, the newest (age 0) last."""
    w = decay(half_life, lambda_) ** np.arange(n - 1, -1, -1)
    return w / w.sum()


def with_weights(df: DataFrame, order_col: str, half_life: float | None = None, lambda_: float | None = None, partition: list[str] | None = None, out: str = "weight") -> DataFrame:
    """df with each row's weight, by its age within its partition. Without a partition all rows are numbered in one task: for calendars, not panels."""
    lam = decay(half_life, lambda_)
    keys = [F.col(c) for c in partition or []]
    rows = Window.partitionBy(*keys).orderBy(F.col(order_col).desc())
    raw = F.pow(F.lit(lam), F.row_number().over(rows) - 1)
    return df.withColumn(out, raw).withColumn(out, F.col(out) / F.sum(out).over(Window.partitionBy(*keys)))


def huber_weight(z: Column, t: float = 1.345) -> Column:
    """1 within t, t / |z| beyond."""
    return F.when(F.abs(z) <= t, F.lit(1.0)).otherwise(F.lit(t) / F.abs(z))


def mad_scale(resid: Column | str) -> Column:
    """Exact median of the absolute values over the normal distribution's, as an aggregate; the values aren't centred."""
    from .huber import MAD_C

    return F.median(F.abs(resid)) / MAD_C
