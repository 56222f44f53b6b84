"""Times the headline queries once warm; prints one JSON line. $BENCH_SF_DIR: the tables, $BENCH_CPUS: threads."""

import json
import os
import sys
import time

for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(k, "1")
HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, *filter(None, [os.environ.get("PYTHONPATH")])])

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from chronolens import catalogue, panels  # noqa: E402
from chronolens.operators import returns  # noqa: E402
from chronolens.plans.pit import pit_robust_betas  # noqa: E402
from chronolens.sources.readers import read_table  # noqa: E402

HEADLINE = ["huber_betas", "pit_betas", "pit_resid", "causal_mask_counts", "first_valid_dates", "live_columns_by_t", "asof_cross_section", "forward_fill", "cum_returns", "corr_matrix", "variance_shares", "simulate_distributed"]


def pit_weeks(spark, sf_dir):
    """Point-in-time betas at every week: five series by about 345 windows."""
    a, f = panels.segments(spark, sf_dir, "week")
    return pit_robust_betas(a, f, half_life=52, min_timestamps=26)["resid"]


def pit_many(n):
    """n series (customers in n groups, weeks) with betas at every quarter: 27 growing windows of each, 345 weeks at the last."""

    def query(spark, sf_dir):
        orders = read_table(spark, sf_dir, "orders").select(F.date_trunc("week", "o_orderdate").cast("timestamp_ntz").alias("ts"), F.concat(F.lit("A"), (F.col("o_custkey") % n).cast("string")).alias("asset"), "o_totalprice")
        v = orders.groupBy("ts", "asset").agg(F.sum("o_totalprice").alias("v"))
        a = returns.from_values(v, ["asset"], "ts", "v").select("ts", "asset", "ret")
        market = v.groupBy("ts").agg(F.sum("v").alias("v")).withColumn("factor", F.lit("MKT"))
        f = returns.from_values(market, ["factor"], "ts", "v").select("ts", "factor", "ret")
        times = f.groupBy(F.date_trunc("quarter", "ts")).agg(F.max("ts").alias("t")).select("t")
        return pit_robust_betas(a, f, half_life=52, min_timestamps=26, rebalance=times)["resid"]

    return query


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map={"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, f in [*((n, catalogue.QUERIES[n]) for n in HEADLINE), ("pit_weeks", pit_weeks), ("pit_100_assets", pit_many(100)), ("pit_400_assets", pit_many(400))]:
        f(spark, sf).write.format("noop").mode("overwrite").save()
        began = time.time()
        f(spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
