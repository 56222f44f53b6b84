"""Missing and finite values. NULL is the only missing marker; infinities are values, but fits leave them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_finite(x: Column | str) -> Column:
    """Neither NULL, NaN nor infinite; never NULL itself."""
    x = _col(x)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def finite(x: Column | str) -> Column:
    """x where finite, else NULL."""
    return F.when(is_finite(x), _col(x))


def nan_to_null(df: DataFrame, *names: str) -> DataFrame:
    """NaN becomes NULL in the named columns, or in all floating ones."""
    cols = names or [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in cols})


def finite_variance(x: Column | str) -> Column:
    """Sample variance of the finite values, as an aggregate; NULL below two of them."""
    return F.var_samp(finite(x))
