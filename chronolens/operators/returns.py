"""Returns, their compounding and attribution."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def from_values(df: DataFrame, by: Sequence[str], order: str, value: str, out: str = "ret") -> DataFrame:
    """value over the one before it, less 1; NULL for the first or after a zero."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn(out, F.try_divide(F.col(value), before) - 1)


def cumulative(df: DataFrame, by: Sequence[str], order: str, value: str, out: str = "cum") -> DataFrame:
    """Compounded return so far; missing rows stay missing and are skipped by the later ones."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.product(F.lit(1.0) + F.col(value)).over(w) - 1))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson's of each ordered pair of columns over the rows where both have values; NULL where one of them doesn't vary. Each task multiplies its rows as
    matrices, after the columns' means are taken off, and hands on one row of sums for each pair."""
    k = len(columns)
    means = np.array([x or 0.0 for x in df.agg(*[F.avg(f"`{c}`").alias(f"c{j}") for j, c in enumerate(columns)]).first()])
    i, j = np.tril_indices(k)
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss, sxy = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64) - means
            there = ~np.isnan(x)
            x, there = np.where(there, x, 0.0), there.astype(np.float64)
            n += there.T @ there
            s += x.T @ there
            ss += (x * x).T @ there
            sxy += x.T @ x
        sums = [n[i, j], s[i, j], s[j, i], ss[i, j], ss[j, i], sxy[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, sums)], ["i", "j", *names])

    cells = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{j}") for j, c in enumerate(columns)])
    sums = cells.mapInArrow(run, "i int, j int, " + ", ".join(f"{c} double" for c in names)).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])
    spread = lambda a, b: F.col("n") * F.col(a) - F.col(b) * F.col(b)
    corr = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(spread("sxx", "sx") * spread("syy", "sy")))
    labels = F.array(*[F.lit(c) for c in columns])
    ways = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return sums.select(F.explode(ways).alias("w"), corr.alias("corr")).select(labels[F.col("w.i")].alias("a"), labels[F.col("w.j")].alias("b"), "corr")


def variance_shares(df: DataFrame, columns: Sequence[str], total: str) -> DataFrame:
    """Each column's sample variance over the total column's."""
    one = df.agg(F.var_samp(f"`{total}`").alias("_t"), *[F.var_samp(f"`{c}`").alias(f"v{k}") for k, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("component"), F.try_divide(F.col(f"v{k}"), F.col("_t")).alias("share")) for k, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def weekdays(df: DataFrame, time_col: str, day: int = 4) -> DataFrame:
    """Rows of one day of the week; Monday is 0, so Friday 4."""
    return df.where(F.weekday(time_col) == day)


def calendar_from(calendar: DataFrame, data: DataFrame, t: str = "t", time_col: str = "ts") -> DataFrame:
    """The calendar from the data's first time on."""
    first = data.agg(F.min(time_col).alias("_first"))
    return calendar.join(F.broadcast(first), F.col(t) >= F.col("_first")).drop("_first")
