"""Wide and long forms, and small relational helpers on them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_long(df: DataFrame, ids: Sequence[str], key: str = "asset", value: str = "ret", columns: Sequence[str] | None = None, dropna: bool = False) -> DataFrame:
    """One row for each id and value column, as doubles; missing ones stay as NULL unless dropped."""
    cols = [c for c in df.columns if c not in ids] if columns is None else list(columns)
    long = df.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot(list(ids), cols, key, value)
    return long.where(F.col(value).isNotNull() & ~F.isnan(value)) if dropna else long.withColumn(value, F.when(~F.isnan(value), F.col(value)))


def to_long_by_position(rows: DataFrame, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Like to_long for frames with repeated column names: key by col_pos beside the name. rows: ids, then the value columns in order."""
    cols = rows.columns[len(ids) :]
    pairs = F.array(*[F.struct(F.lit(k).alias("col_pos"), F.lit(n).alias("col"), F.col(f"`{c}`").cast("double").alias("v")) for k, (n, c) in enumerate(zip(names, cols))])
    return rows.select(*ids, F.explode(pairs).alias("x")).select(*ids, "x.*")


def to_wide(df: DataFrame, ids: Sequence[str], key: str, value: str, columns: Sequence[str]) -> DataFrame:
    """A column for each named key; the names must be given, so the schema doesn't hang on the data."""
    return df.groupBy(*ids).pivot(key, list(columns)).agg(F.first(value, ignorenulls=True))


def restack(df: DataFrame, ids: Sequence[str], key: str = "symbol", value: str = "v") -> DataFrame:
    """Wide to long without the missing values."""
    return to_long(df, ids, key, value, dropna=True)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; a column that one lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def align(frames: dict[str, DataFrame], on: Sequence[str]) -> DataFrame:
    """One column of each frame (its only one beside the keys), outer-joined on the keys."""
    parts = [f.select(*on, F.col(f"`{next(c for c in f.columns if c not in on)}`").alias(name)) for name, f in frames.items()]
    return reduce(lambda a, b: a.join(b, list(on), "full_outer"), parts)


def drop_all_missing(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    return df.na.drop("all", subset=[c for c in df.columns if c not in ids])


def drop_any_missing(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    return df.na.drop("any", subset=[c for c in df.columns if c not in ids])


def drop_all_missing_long(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows of groups that have a value somewhere."""
    return df.withColumn("_n", F.count(value).over(Window.partitionBy(*by))).where("_n > 0").drop("_n")


def fill_constant(df: DataFrame, by: Sequence[str], value: str, constant: float = 1.0, when: Column | None = None) -> DataFrame:
    """Missing values of groups that have one somewhere become the constant, where `when` holds."""
    there = F.count(value).over(Window.partitionBy(*by)) > 0
    rule = F.col(value).isNull() & there & (F.lit(True) if when is None else when)
    return df.withColumn(value, F.when(rule, F.lit(constant)).otherwise(F.col(value)))


def forward_fill(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def lag(df: DataFrame, by: Sequence[str], order: str, value: str, out: str, rows: int = 1) -> DataFrame:
    return df.withColumn(out, F.lag(value, rows).over(Window.partitionBy(*by).orderBy(order)))


def difference(df: DataFrame, by: Sequence[str], order: str, value: str, out: str, rows: int = 1) -> DataFrame:
    """The change since the row before; NULL where either is missing."""
    return df.withColumn(out, F.col(value) - F.lag(value, rows).over(Window.partitionBy(*by).orderBy(order)))


def last_dates(df: DataFrame, order: str, n: int) -> DataFrame:
    """Rows of the n latest dates."""
    latest = df.select(order).distinct().orderBy(F.col(order).desc()).limit(n)
    return df.join(F.broadcast(latest), order, "left_semi")
