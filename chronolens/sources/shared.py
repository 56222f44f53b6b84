"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and written to the folder in spark.checkpoint.dir: what several plans read is not computed again, and survives lost executors.
    Where that is unset, a local master (as in tests) gets a folder of our own; elsewhere it is an error, for executors don't share their disks."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        master = spark.sparkContext.master
        if not folder and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or "file:/tmp/checkpoints")
    return df.checkpoint(eager=True)
