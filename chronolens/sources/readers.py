"""Sources and sinks of return tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.finite import nan_to_null


def utc_naive(col: Column | str) -> Column:
    """A timestamp, or text with or without a zone, as UTC wall time without a zone. The session's zone should be UTC."""
    return F.to_timestamp(col).cast("timestamp_ntz")


def read_returns_csv(spark: SparkSession, path: str | list[str], symbols: Sequence[str], time_name: str = "ts") -> DataFrame:
    """A CSV whose first column holds times and whose other columns hold returns, in any order: time_name and the named symbols as doubles.

    Only the header is looked at; columns that aren't named aren't parsed."""
    header = spark.read.csv(path, header=True).columns
    lacking = [s for s in symbols if s not in header[1:]]
    if lacking:
        raise ValueError(f"no such columns: {lacking}")
    ddl = ", ".join(f"`{c}` {'string' if k == 0 else 'double'}" for k, c in enumerate(header))
    df = spark.read.csv(path, header=True, schema=ddl)
    return nan_to_null(df.select(utc_naive(f"`{header[0]}`").alias(time_name), *[f"`{s}`" for s in symbols]), *symbols)


def from_pandas(spark: SparkSession, frame, time_name: str = "ts") -> DataFrame:
    """A pandas frame or series with its (first) index level as times; NaN is NULL."""
    import pandas as pd

    frame = frame.to_frame(frame.name or "value") if isinstance(frame, pd.Series) else frame
    levels = [time_name, *[str(n or f"level_{k}") for k, n in enumerate(frame.index.names[1:], 1)]]
    flat = frame.copy(deep=False)
    flat.index = flat.index.set_names(levels if len(levels) > 1 else levels[0])
    return nan_to_null(spark.createDataFrame(flat.reset_index()))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_by_time(df: DataFrame, path: str, t: str = "t", mode: str = "append") -> None:
    """A partition of files for each time."""
    df.write.mode(mode).partitionBy(t).parquet(path)
