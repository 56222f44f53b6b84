"""Huber robust regression by iteratively reweighted least squares, many windows of one series at a time.

The stopping rule is part of the result: the loop ends on a zero scale, once the deviance moves by at most `tol` or turns NaN, or when `maxiter`
solutions were made, the first unweighted one included, converged or not. Scale is the uncentred median absolute residual. The deviance divides
residuals by the weighted residual variance, not by its root.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd

# The tuning constant, and the upper quartile of the standard normal distribution.
HUBER_T = 1.345
MAD_C = 0.6744897501960817

#: Doubles of a windows x rows array that are worked on at once, and the condition of the normal equations beyond which the pseudo-inverse is taken.
CELLS, ILL = 1_000_000, 1e10


def _median(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each row's n smallest entries, where the rest is infinite."""
    a = np.sort(a, axis=1)
    r = np.arange(len(a))
    return (a[r, (n - 1) // 2] + a[r, n // 2]) / 2


def _solve(w: np.ndarray, x: np.ndarray, y: np.ndarray, xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Coefficients of each row of weights; the least-norm ones where the design is short of rank."""
    p = x.shape[1]
    gram = (w @ xx).reshape(-1, p, p)
    rhs = w @ xy
    size = np.sqrt(np.maximum(np.einsum("dpp->dp", gram), 0))
    size[size == 0] = 1.0
    unit = gram / (size[:, :, None] * size[:, None, :])
    with np.errstate(all="ignore"):
        good = np.isfinite(unit).all((1, 2))
        cond = np.full(len(gram), np.inf)
        cond[good] = np.linalg.cond(unit[good])
    out = np.empty((len(w), p))
    fine = cond < ILL
    if fine.any():
        out[fine] = np.linalg.solve(unit[fine], (rhs[fine] / size[fine])[:, :, None])[:, :, 0] / size[fine]
    for k in np.flatnonzero(~fine):
        root = np.sqrt(w[k])
        out[k] = np.linalg.pinv(root[:, None] * x) @ (root * y)
    return out


def _deviance(resid: np.ndarray, w: np.ndarray, free: np.ndarray, t: float) -> np.ndarray:
    """Sum of rho(resid / variance); 0 without degrees of freedom or variance."""
    with np.errstate(all="ignore"):
        scale = (w * resid * resid).sum(1) / free
        z = np.abs(resid / scale[:, None])
        dev = np.where(z <= t, 0.5 * z * z, z * t - 0.5 * t * t).sum(1)
    return np.where((free > 0) & (scale > 0), dev, 0.0)


def fit_windows(y: np.ndarray, x: np.ndarray, sqrt_weights: np.ndarray, inside: np.ndarray | None = None, t: float = HUBER_T, tol: float = 1e-8, maxiter: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (windows x columns) and whether the loop ended on a zero scale. sqrt_weights (windows x rows): roots of the time weights, by
    which each window's rows of y and x, and so its residuals, are multiplied. inside: which rows a window has, by default those of positive weight;
    a row whose weight has underflown still counts for the median."""
    inside = sqrt_weights > 0 if inside is None else inside
    sqrt_weights = np.where(inside, sqrt_weights, 0.0)
    d, p = len(sqrt_weights), x.shape[1]
    beta, perfect = np.full((d, p), np.nan), np.zeros(d, bool)
    xx, xy = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1), x * y[:, None]
    step = max(1, CELLS // max(1, len(y)))
    for a in range(0, d, step):
        beta[a : a + step], perfect[a : a + step] = _fit_block(y, x, xx, xy, sqrt_weights[a : a + step], inside[a : a + step], t, tol, maxiter)
    return beta, perfect


def _fit_block(y, x, xx, xy, sw, inside, t, tol, maxiter):
    n = inside.sum(1)
    weight = sw * sw
    beta = np.full((len(sw), x.shape[1]), np.nan)
    perfect = np.zeros(len(sw), bool)
    on = np.flatnonzero(n > 0)
    free = n - x.shape[1]

    def state(rows: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        resid = sw[rows] * (y - b @ x.T)
        return resid, _median(np.where(inside[rows], np.abs(resid), np.inf), n[rows]) / MAD_C

    beta[on] = _solve(weight[on], x, y, xx, xy)
    resid, scale = state(on, beta[on])
    dev = _deviance(resid, np.ones_like(resid), free[on], t)
    made = 1
    while len(on):
        zero = scale == 0.0
        perfect[on[zero]] = True
        on, resid, scale, dev = on[~zero], resid[~zero], scale[~zero], dev[~zero]
        if not len(on):
            break
        with np.errstate(all="ignore"):
            z = np.abs(resid / scale[:, None])
            w = np.where(z <= t, 1.0, t / z)
        beta[on] = _solve(weight[on] * w, x, y, xx, xy)
        resid, scale = state(on, beta[on])
        new = _deviance(resid, w, free[on], t)
        made += 1
        go = (np.abs(new - dev) > tol) & (made < maxiter)
        on, resid, scale, dev = on[go], resid[go], scale[go], new[go]
    return beta, perfect


def fit_huber(endog, exog, *, t: float = HUBER_T, tol: float = 1e-8, maxiter: int = 50) -> np.ndarray:
    """One fit of endog on exog, which holds the constant if one is wanted; both already weighted."""
    y, x = np.ascontiguousarray(endog, np.float64), np.ascontiguousarray(exog, np.float64)
    return fit_windows(y, x, np.ones((1, len(y))), None, t, tol, maxiter)[0][0]


def huber_udaf(t: float = HUBER_T, tol: float = 1e-8, maxiter: int = 50):
    """A grouped aggregate (y double, x array<double>) -> array<double>; NULL if the fit fails. Rows with a missing or infinite value are left out."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<double>")
    def huber(y: pd.Series, x: pd.Series) -> Any:
        rows = [(b, np.asarray(a, np.float64)) for b, a in zip(y, x) if b is not None and a is not None]
        rows = [(b, a) for b, a in rows if np.isfinite(b) and np.isfinite(a).all()]
        if not rows:
            return None
        try:
            # in an order of their own: a group's rows come in any
            rows.sort(key=lambda r: (*r[1].tolist(), r[0]))
            return fit_huber([r[0] for r in rows], np.stack([r[1] for r in rows]), t=t, tol=tol, maxiter=maxiter).tolist()
        except (np.linalg.LinAlgError, ZeroDivisionError):
            return None

    return huber
