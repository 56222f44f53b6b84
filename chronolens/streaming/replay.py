"""Forward-only replay of a growing table with Structured Streaming.

Windows never forget, so nothing can be evicted: each micro-batch is stored, and what leaves the stream is a function of the rows that have arrived and
are dated on or before the time reported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def replay(spark: SparkSession, source: str, schema, on_time: Callable[[object, DataFrame], None], checkpoint: str, time_col: str = "ts", files_per_batch: int = 1) -> StreamingQuery:
    """Reads the Parquet files that arrive under source, and calls on_time(t, what had arrived by then and is dated up to t) for each time of a batch, in
    order, once the batch is there.

    Batches are kept under checkpoint/arrived, one folder each, which a batch that is run again replaces: a file that lies under source but hasn't had
    its turn is never seen. A late row brings its time up again, with all that has arrived; times reported before it aren't reported anew. Ends when no
    file is left; starts again where the checkpoint says."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    stream = spark.readStream.schema(fields).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    arrived, stored = f"{checkpoint}/arrived", T.StructType([*fields, T.StructField("_batch", T.LongType())])

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{arrived}/_batch={number}")
        known = spark.read.schema(stored).parquet(arrived).where(F.col("_batch") <= number).select(*[f"`{f.name}`" for f in fields])
        times = [r[0] for r in spark.read.schema(fields).parquet(f"{arrived}/_batch={number}").select(time_col).distinct().orderBy(time_col).collect()]
        for t in times:
            on_time(t, known.where(F.col(time_col) <= F.lit(t)))

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def write_results(path: str, t: str = "t") -> Callable[[object, DataFrame], None]:
    """An on-result sink: a folder for each time, replaced if the time comes again."""

    def sink(now, df: DataFrame) -> None:
        name = str(now).replace(":", "-").replace(" ", "_")
        df.withColumn(t, F.lit(now)).write.mode("overwrite").parquet(f"{path}/{t}={name}/")

    return sink
