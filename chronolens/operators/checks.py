"""Input checks that end in a ValueError on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)

#: Names that an error text lists.
NAMED = 20


def require_time(df: DataFrame, col: str, label: str) -> None:
    if not isinstance(df.schema[col].dataType, TIME_TYPES):
        raise ValueError(f"{label}: column '{col}' holds {df.schema[col].dataType.simpleString()}, where a date or timestamp column is needed")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def require_unique(df: DataFrame, keys: list[str], what: str) -> None:
    twice = duplicates(df, *keys)
    found = twice.orderBy(*keys).limit(NAMED + 1).collect()
    if found:
        more = f" and {twice.count() - NAMED} more" if len(found) > NAMED else ""
        raise ValueError(f"{what}: {[tuple(map(str, r)) if len(r) > 1 else str(r[0]) for r in found[:NAMED]]}{more}")


def panel_faults(assets: DataFrame, factors: DataFrame, order: str) -> dict[str, int]:
    """Counts over both tables in one job: rows of each, times that only one has, and names that occur twice at a time."""
    a = assets.select(F.lit(True).alias("is_asset"), F.col(order).alias("t"), F.col("asset").cast("string").alias("name"))
    f = factors.select(F.lit(False), F.col(order), F.col("factor").cast("string"))
    cells = a.union(f).groupBy("is_asset", "t", "name").agg(F.count(F.lit(1)).alias("n"))
    times = cells.groupBy("t").agg(F.bool_or("is_asset").alias("a"), F.bool_or(~F.col("is_asset")).alias("f"), F.sum(F.when(F.col("is_asset"), F.col("n"))).alias("na"), F.sum(F.when(~F.col("is_asset"), F.col("n"))).alias("nf"), F.max(F.when(F.col("is_asset"), F.col("n"))).alias("da"), F.max(F.when(~F.col("is_asset"), F.col("n"))).alias("df"))
    row = times.agg(F.sum("na").alias("assets"), F.sum("nf").alias("factors"), F.count_if(F.col("a") != F.col("f")).alias("apart"), F.count_if(F.col("da") > 1).alias("twice_a"), F.count_if(F.col("df") > 1).alias("twice_f")).first()
    return {k: v or 0 for k, v in row.asDict().items()}


def require_panel(assets: DataFrame, factors: DataFrame, order: str) -> None:
    """Rows on both sides, the same index, and no name twice at a time; the tables are looked at again only to name what is wrong."""
    found = panel_faults(assets, factors, order)
    for k in ("assets", "factors"):
        if not found[k]:
            raise ValueError(f"no rows: {k} is empty")
    if found["apart"]:
        raise ValueError(f"{found['apart']} time(s) occur on one side only; assets and factors need the same times")
    if found["twice_a"]:
        require_unique(assets, [order, "asset"], "more than one row for a time and asset")
    if found["twice_f"]:
        require_unique(factors, [order, "factor"], "more than one row for a time and factor")
