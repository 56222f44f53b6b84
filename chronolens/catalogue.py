"""The library's queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import panels
from .functions import weights
from .functions.finite import finite, is_finite
from .operators import betas as B
from .operators import causal, reshape, returns
from .plans.pit import pit_robust_betas
from .plans.two_stage import two_stage
from .sources.readers import read_table

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "pit_resid"

HALF_LIFE, LEAST = 12, 10


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(c, places: int = 6):
    """Rounded for comparison, without a negative zero."""
    return F.round(c, places) + F.lit(0.0)


SEG, EVT = panels.segments_sql(), panels.events_sql()


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes)


# ---- causal replay ----


def _quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read_table(spark, sf_dir, "orders").select(F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz").alias("t"))
    return days.distinct()


QUARTERS = "q AS (SELECT DISTINCT date_trunc('quarter', o_orderdate)::TIMESTAMP AS t FROM orders)"


@_query(_with(SEG, QUARTERS) + " SELECT t, count(*)::BIGINT AS n_rows, count(ret)::BIGINT AS n_values FROM q JOIN a ON ts <= t GROUP BY t")
def causal_mask_counts(spark, sf_dir):
    """Rows and values known at each quarter's start: growing counts over months, read at each quarter's latest month."""
    a, _ = panels.segments(spark, sf_dir)
    return causal.growing(_quarters(spark, sf_dir), a, {"n_rows": F.count(F.lit(1)), "n_values": F.count("ret")})


@_query(_with(SEG) + " SELECT DISTINCT a.ts AS t, (SELECT count(*) FROM a b WHERE b.ts <= a.ts)::BIGINT AS n_rows FROM a")
def expanding_window_counts(spark, sf_dir):
    """The same growing window as a running frame: peers of a date included, one row a date."""
    a, _ = panels.segments(spark, sf_dir)
    per = a.groupBy(F.col("ts").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return per.select("t", F.sum("n").over(Window.orderBy("t").rangeBetween(Window.unboundedPreceding, 0)).alias("n_rows"))


@_query(_with(SEG) + " SELECT asset, min(CASE WHEN ret IS NOT NULL THEN ts END) AS first_valid FROM a GROUP BY asset")
def first_valid_dates(spark, sf_dir):
    """When each segment first has a return."""
    return causal.first_valid_long(panels.segments(spark, sf_dir)[0], "asset", "ret")


@_query(_with(SEG, QUARTERS) + ", v AS (SELECT asset, min(ts) AS fv FROM a WHERE ret IS NOT NULL GROUP BY asset) SELECT t, asset AS col FROM q JOIN v ON fv <= t")
def live_columns_by_t(spark, sf_dir):
    """Segments with a value so far at each quarter's start, from the wide table."""
    a, _ = panels.segments(spark, sf_dir)
    wide = reshape.to_wide(a, ["ts"], "asset", "ret", _segment_names(spark, sf_dir))
    return causal.live_columns(causal.Dataset(wide), _quarters(spark, sf_dir))


def _segment_names(spark, sf_dir) -> list[str]:
    return [r[0] for r in read_table(spark, sf_dir, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]


@_query(_with(SEG, QUARTERS) + ", l AS (SELECT t, max(ts) AS ts FROM q JOIN a ON ts <= t GROUP BY t) SELECT t, asset, round(ret, 6) + 0.0 AS ret FROM l JOIN a USING (ts)")
def asof_cross_section(spark, sf_dir):
    """The latest month known at each quarter's start, by segment: an as-of lookup without a range join."""
    a, _ = panels.segments(spark, sf_dir)
    return causal.asof_dates(_quarters(spark, sf_dir), a).select("t", "asset", _r(F.col("ret")).alias("ret"))


@_query(_with(SEG) + ", k AS (SELECT *, dense_rank() OVER (ORDER BY ts DESC) AS place FROM a) SELECT ts, asset, round(ret, 6) + 0.0 AS ret FROM k WHERE place <= 2")
def last_two_dates(spark, sf_dir):
    a, _ = panels.segments(spark, sf_dir)
    return reshape.last_dates(a, "ts", 2).select("ts", "asset", _r(F.col("ret")).alias("ret"))


@_query(_with(SEG, QUARTERS) + ", k AS (SELECT t, ts, asset, ret, dense_rank() OVER (PARTITION BY t ORDER BY ts DESC) AS place FROM q JOIN a ON ts <= t) SELECT t, ts, asset, round(ret, 6) + 0.0 AS ret FROM k WHERE place <= 2")
def asof_window_result(spark, sf_dir):
    """Each quarter's last two known months: the as-of time beside the row's own date."""
    a, _ = panels.segments(spark, sf_dir)
    return causal.asof_dates(_quarters(spark, sf_dir), a, 2).select("t", "ts", "asset", _r(F.col("ret")).alias("ret"))


@_query(_with(SEG) + ", y AS (SELECT DISTINCT date_trunc('year', ts)::TIMESTAMP AS t FROM a) SELECT t, count(ret)::BIGINT AS n, round(avg(ret), 6) + 0.0 AS mean FROM y JOIN a ON ts <= t GROUP BY t")
def simulate_driver(spark, sf_dir):
    """The driver-loop replay over year starts: count and mean of the returns known."""
    a, _ = panels.segments(spark, sf_dir)
    years = [r[0] for r in a.select(F.date_trunc("year", "ts").cast("timestamp_ntz").alias("t")).distinct().orderBy("t").collect()]

    def run(seen):
        known = seen["a"] if "ret" in seen["a"].columns else seen["a"].withColumn("ret", F.lit(None).cast("double"))
        return {"m": known.agg(F.count("ret").alias("n"), _r(F.avg("ret")).alias("mean"))}

    out = causal.simulate({"a": causal.Dataset(a.withColumn("one", F.lit(1)), keys=("asset",))}, run, years)["m"]
    return out.select(F.col("t").cast("timestamp_ntz").alias("t"), "n", "mean")


@_query(_with(SEG, QUARTERS) + " SELECT t, count(ret)::BIGINT AS n, round(sum(ret), 6) + 0.0 AS total FROM q JOIN a ON ts <= t GROUP BY t")
def simulate_distributed(spark, sf_dir):
    """The distributed replay with a pandas callback."""
    import pandas as pd

    a, _ = panels.segments(spark, sf_dir)

    def callback(t, seen):
        ret = seen["a"]["ret"] if "ret" in seen["a"] else pd.Series(dtype=float)
        return pd.DataFrame({"n": [int(ret.count())], "total": [float(ret.sum()) if ret.count() else None]})

    # a column that always has a value keeps times without a return in
    data = {"a": causal.Dataset(a.withColumn("one", F.lit(1)), keys=("asset",))}
    out = causal.simulate_distributed(data, callback, _quarters(spark, sf_dir), "n long, total double")
    return out.select("t", "n", _r(F.col("total")).alias("total"))


# ---- reshaping ----


@_query(_with(SEG) + " SELECT ts, " + "{cols}" + " FROM a GROUP BY ts")
def wide_rows(spark, sf_dir):
    """Long to wide: a row a month, a column a segment."""
    a, _ = panels.segments(spark, sf_dir)
    return reshape.to_wide(a.withColumn("ret", _r(F.col("ret"))), ["ts"], "asset", "ret", SEGMENTS)


# The segments of the test tables, in order.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
ORACLES["wide_rows"] = ORACLES["wide_rows"].replace("{cols}", ", ".join(f"any_value(round(ret, 6) + 0.0) FILTER (WHERE asset = '{s}' AND ret IS NOT NULL) AS \"{s}\"" for s in SEGMENTS))


@_query(_with(SEG) + " SELECT ts, asset AS symbol, round(ret, 6) + 0.0 AS v FROM a WHERE ret IS NOT NULL")
def restack(spark, sf_dir):
    """Wide again to long, without missing values."""
    a, _ = panels.segments(spark, sf_dir)
    return reshape.restack(reshape.to_wide(a, ["ts"], "asset", "ret", SEGMENTS), ["ts"]).select("ts", "symbol", _r(F.col("v")).alias("v"))


@_query(_with(SEG) + " SELECT ts, round(max(CASE WHEN asset = 'BUILDING' THEN ret END), 6) + 0.0 AS building, round(any_value(f.ret), 6) + 0.0 AS market FROM a JOIN f USING (ts) GROUP BY ts HAVING max(CASE WHEN asset = 'BUILDING' THEN a.ret END) IS NOT NULL OR any_value(f.ret) IS NOT NULL".replace("max(CASE WHEN asset = 'BUILDING' THEN ret END)", "max(CASE WHEN asset = 'BUILDING' THEN a.ret END)"))
def aligned_columns(spark, sf_dir):
    """A segment and the market side by side on the month, without months where both are missing."""
    a, f = panels.segments(spark, sf_dir)
    both = reshape.align({"building": a.where("asset = 'BUILDING'").select("ts", "ret"), "market": f.select("ts", "ret")}, ["ts"])
    return reshape.drop_all_missing(both, ["ts"]).select("ts", _r(F.col("building")).alias("building"), _r(F.col("market")).alias("market"))


@_query("SELECT o_orderkey, o_orderdate FROM orders WHERE isodow(o_orderdate) = 5")
def friday_calendar(spark, sf_dir):
    return returns.weekdays(read_table(spark, sf_dir, "orders"), "o_orderdate").select("o_orderkey", "o_orderdate")


@_query("SELECT l_shipdate AS t FROM lineitem WHERE l_shipdate >= (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def calendar_from_start(spark, sf_dir):
    """Ship dates from another table's date on."""
    days = read_table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("t")).distinct()
    start = read_table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").agg(F.max("o_orderdate").alias("ts"))
    return returns.calendar_from(days, start)


@_query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    from .operators.checks import duplicates

    e = read_table(spark, sf_dir, "events").select("event_type")
    return duplicates(e, "event_type").join(e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "event_type")


# ---- statistics and weights ----


@_query(_with(SEG) + ", k AS (SELECT ts, row_number() OVER (ORDER BY ts DESC) - 1 AS age FROM f) SELECT ts, round(pow(exp(ln(0.5::DOUBLE) / 12), age) / sum(pow(exp(ln(0.5::DOUBLE) / 12), age)) OVER (), 9) AS weight FROM k")
def exp_weights(spark, sf_dir):
    _, f = panels.segments(spark, sf_dir)
    return weights.with_weights(f.select("ts"), "ts", half_life=HALF_LIFE).select("ts", F.round("weight", 9).alias("weight"))


@_query(_with(SEG) + " SELECT asset, round(var_samp(ret), 6) + 0.0 AS v, count(ret)::BIGINT AS n FROM a GROUP BY asset")
def finite_variance(spark, sf_dir):
    a, _ = panels.segments(spark, sf_dir)
    return a.groupBy("asset").agg(_r(F.var_samp(finite("ret"))).alias("v"), F.count_if(is_finite("ret")).alias("n"))


@_query(_with(SEG) + " SELECT ts, (count(ret) = 5) AS complete, count(ret)::BIGINT AS n FROM a GROUP BY ts")
def complete_rows(spark, sf_dir):
    """Months on which all segments have a return."""
    a, _ = panels.segments(spark, sf_dir)
    rows = B.factor_rows(B.long_form(a.withColumnRenamed("asset", "factor"), "factor", "ts", "_g"), SEGMENTS, "ts", "_g")
    return rows.select("ts", "complete", F.size(F.filter("x", lambda v: is_finite(v))).cast("long").alias("n"))


@_query(_with(SEG) + ", c AS (SELECT ts FROM a GROUP BY ts HAVING count(ret) = 5) SELECT asset, count(*)::BIGINT AS n, round(var_samp(ret), 6) + 0.0 AS v FROM a JOIN c USING (ts) GROUP BY asset HAVING count(*) >= 10")
def min_count_gate(spark, sf_dir):
    """Counts and variances over complete months, of segments with ten of them or more."""
    a, _ = panels.segments(spark, sf_dir)
    full = a.groupBy("ts").agg(F.count_if(is_finite("ret")).alias("n")).where(F.col("n") == len(SEGMENTS)).select("ts")
    out = a.join(F.broadcast(full), "ts").groupBy("asset").agg(F.count(F.lit(1)).alias("n"), _r(F.var_samp("ret")).alias("v"))
    return out.where(F.col("n") >= LEAST)


@_query(_with(SEG) + " SELECT asset, round(median(abs(ret)) / 0.6744897501960817, 6) + 0.0 AS scale FROM a GROUP BY asset")
def mad_scale(spark, sf_dir):
    a, _ = panels.segments(spark, sf_dir)
    return a.groupBy("asset").agg(_r(weights.mad_scale("ret")).alias("scale"))


@_query(_with(SEG) + ", s AS (SELECT asset, median(abs(ret)) / 0.6744897501960817 AS scale FROM a GROUP BY asset) SELECT ts, asset, round(CASE WHEN abs(ret / scale) <= 1.345 THEN 1.0::DOUBLE ELSE 1.345::DOUBLE / abs(ret / scale) END, 6) AS w FROM a JOIN s USING (asset) WHERE ret IS NOT NULL")
def huber_weights(spark, sf_dir):
    a, _ = panels.segments(spark, sf_dir)
    scale = a.groupBy("asset").agg(weights.mad_scale("ret").alias("scale"))
    return a.where("ret is not null").join(F.broadcast(scale), "asset").select("ts", "asset", F.round(weights.huber_weight(F.col("ret") / F.col("scale")), 6).alias("w"))


@_query(_with(SEG) + " SELECT a.asset, round(regr_slope(a.ret, f.ret), 6) + 0.0 AS beta, round(regr_intercept(a.ret, f.ret), 6) + 0.0 AS alpha FROM a JOIN f USING (ts) WHERE a.ret IS NOT NULL AND f.ret IS NOT NULL GROUP BY a.asset")
def ols_start(spark, sf_dir):
    """The unweighted start of the robust fit, relationally."""
    a, f = panels.segments(spark, sf_dir)
    both = a.join(f.select("ts", F.col("ret").alias("x")), "ts").where(is_finite("ret") & is_finite("x"))
    return both.groupBy("asset").agg(_r(F.regr_slope("ret", "x")).alias("beta"), _r(F.regr_intercept("ret", "x")).alias("alpha"))


# ---- robust betas ----

_LAST = "tt AS (SELECT max(ts) AS t FROM f)"


@_query(_with(SEG, _LAST, panels.huber_sql(HALF_LIFE, LEAST, "tt")) + " SELECT 'MKT' AS factor, n.asset, round(beta, 6) + 0.0 AS beta FROM (SELECT DISTINCT asset FROM a) n LEFT JOIN betas USING (asset)")
def huber_betas(spark, sf_dir):
    """One robust fit of each segment on the market over all months."""
    a, f = panels.segments(spark, sf_dir)
    out = B.robust_betas(a, f, half_life=HALF_LIFE, min_timestamps=LEAST)
    return out.select("factor", "asset", _r(F.col("beta")).alias("beta"))


@_query(ORACLES["huber_betas"])
def parallel_huber_betas(spark, sf_dir):
    a, f = panels.segments(spark, sf_dir)
    out = B.parallel_robust_betas(a, f, half_life=HALF_LIFE, min_timestamps=LEAST, n_jobs=2)
    return out.select("factor", "asset", _r(F.col("beta")).alias("beta"))


_TWO = """nx AS (SELECT ts FROM f WHERE ts IN (SELECT ts FROM a WHERE asset = 'BUILDING') AND ts IN (SELECT ts FROM a WHERE asset = 'MACHINERY')),
    a3 AS (SELECT a.* FROM a JOIN nx USING (ts) WHERE asset <> 'BUILDING'), f1 AS (SELECT f.* FROM f JOIN nx USING (ts)), f2 AS (SELECT ts, ret FROM a JOIN nx USING (ts) WHERE asset = 'BUILDING'),
    tt AS (SELECT max(ts) AS t FROM nx)"""


@_query(_with(SEG, _TWO, panels.huber_sql(HALF_LIFE, LEAST, "tt", ("f1", "f2"), "a3")) + """
    SELECT factor, n.asset, round(CASE factor WHEN 'MKT' THEN beta ELSE beta2 END, 6) + 0.0 AS beta
    FROM (SELECT DISTINCT asset FROM a3) n CROSS JOIN (VALUES ('MKT'), ('BLD')) k(factor) LEFT JOIN betas USING (asset)""")
def huber_betas_two_factors(spark, sf_dir):
    """Segments on two factors: the market and one segment."""
    a, f = panels.segments(spark, sf_dir)
    second = a.where("asset = 'BUILDING'").select("ts", F.lit("BLD").alias("factor"), "ret")
    index = f.select("ts").join(second.select("ts").distinct(), "ts")
    out = B.robust_betas(a.where("asset <> 'BUILDING'").join(index, "ts").join(a.where("asset = 'MACHINERY'").select("ts"), "ts", "left_semi"), f.unionByName(second).join(index, "ts").join(a.where("asset = 'MACHINERY'").select("ts"), "ts", "left_semi"), half_life=HALF_LIFE, min_timestamps=LEAST)
    return out.select("factor", "asset", _r(F.col("beta")).alias("beta"))


@_query(_with(SEG, _LAST, panels.huber_sql(None, 1, "tt")) + ", n AS (SELECT asset, count(*)::BIGINT AS n FROM d GROUP BY asset) SELECT asset, n, round(alpha, 6) + 0.0 AS alpha, round(beta, 6) + 0.0 AS beta FROM n JOIN betas USING (asset)")
def huber_udaf_rows(spark, sf_dir):
    """The fit as a grouped aggregate, unweighted: the rows it takes, its constant and its coefficient."""
    from .functions.huber import huber_udaf

    a, f = panels.segments(spark, sf_dir)
    both = a.join(f.select("ts", F.col("ret").alias("x")), "ts").where(is_finite("ret") & is_finite("x"))
    fits = both.groupBy("asset").agg(huber_udaf()(F.col("ret"), F.array(F.lit(1.0), F.col("x"))).alias("b"))
    n = both.groupBy("asset").agg(F.count(F.lit(1)).alias("n"))
    return n.join(fits.where(F.size("b") == 2), "asset").select("asset", "n", _r(F.col("b")[0]).alias("alpha"), _r(F.col("b")[1]).alias("beta"))


def _pit(spark, sf_dir, unit="month", **more):
    a, f = panels.segments(spark, sf_dir, unit)
    return pit_robust_betas(a, f, half_life=HALF_LIFE, min_timestamps=LEAST, **more)


# growing windows at every month; then the panel's algebra
_EVERY = "tt AS (SELECT DISTINCT ts AS t FROM f)"


def _chain(times: str, a: str = "a", f: str = "f", p: str = "", own_factor: bool = False) -> str:
    on = f"{f}.ts = {p}pb.ts" + f" AND {f}.asset = {p}pb.asset" * own_factor
    return ", ".join([panels.huber_sql(HALF_LIFE, LEAST, times, (f,), a, p, own_factor), f"""
        {p}grid AS (SELECT ts, asset FROM (SELECT DISTINCT ts FROM {f}) CROSS JOIN (SELECT DISTINCT asset FROM {a})),
        {p}pb AS (SELECT g.ts, g.asset, last_value(b.beta IGNORE NULLS) OVER (PARTITION BY g.asset ORDER BY g.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS beta
               FROM {p}grid g LEFT JOIN {p}betas b ON b.t = g.ts AND b.asset = g.asset),
        {p}ph AS (SELECT {p}pb.ts, {p}pb.asset, -lag({p}pb.beta) OVER (PARTITION BY {p}pb.asset ORDER BY {p}pb.ts) * {f}.ret AS hedge FROM {p}pb JOIN {f} ON {on}),
        {p}pr AS (SELECT {p}ph.ts, {p}ph.asset, {a}.ret + {p}ph.hedge AS resid FROM {p}ph LEFT JOIN {a} ON {a}.ts = {p}ph.ts AND {a}.asset = {p}ph.asset)"""])


_PIT = _with(SEG, _EVERY, _chain("tt"))


@_query(_PIT + " SELECT ts AS timestamp, 'MKT' AS factor, asset, round(beta, 6) + 0.0 AS beta FROM pb")
def pit_betas(spark, sf_dir):
    return _pit(spark, sf_dir)["betas"].select("timestamp", "factor", "asset", _r(F.col("beta")).alias("beta"))


@_query(_PIT + " SELECT ts AS timestamp, 'MKT' AS factor, asset, round(hedge, 6) + 0.0 AS hedge_ret FROM ph")
def pit_hedge_by_factor(spark, sf_dir):
    return _pit(spark, sf_dir)["hedge_by_factor"].select("timestamp", "factor", "asset", _r(F.col("hedge_ret")).alias("hedge_ret"))


@_query(_PIT + " SELECT ts AS timestamp, asset, round(hedge, 6) + 0.0 AS hedge_ret FROM ph")
def pit_hedge(spark, sf_dir):
    return _pit(spark, sf_dir)["hedge"].select("timestamp", "asset", _r(F.col("hedge_ret")).alias("hedge_ret"))


@_query(_PIT + " SELECT ts AS timestamp, asset, round(resid, 6) + 0.0 AS resid FROM pr")
def pit_resid(spark, sf_dir):
    """The flagship: monthly segment returns hedged by point-in-time robust betas on the market."""
    return _pit(spark, sf_dir)["resid"].select("timestamp", "asset", _r(F.col("resid")).alias("resid"))


@_query(_PIT + " SELECT t, asset, 'ok' AS fit FROM betas")
def pit_fits(spark, sf_dir):
    """How the fit of each window with rows enough went."""
    return _pit(spark, sf_dir)["fits"].select("t", "asset", "fit")


@_query(_with(SEG) + f" SELECT ts AS t, row_number() OVER (ORDER BY ts) AS n, CASE WHEN count(ret) OVER w = 0 THEN 'incomplete_factors' WHEN count(ret) OVER w < {LEAST} THEN 'few_rows' ELSE 'ok' END AS state FROM f WINDOW w AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def pit_window_status(spark, sf_dir):
    """What each rebalance time's window is good for."""
    return _pit(spark, sf_dir)["status"].select("t", F.col("n").cast("long").alias("n"), "state")


# rebalance times in the middle of months too: those aren't in the index and are dropped
_OFF = "tt AS (SELECT DISTINCT ts AS t FROM f WHERE month(ts) IN (3, 9) UNION SELECT DISTINCT ts + INTERVAL 10 DAY FROM f WHERE month(ts) = 6)"


@_query(_with(SEG, _OFF, _chain("tt")) + " SELECT ts AS timestamp, 'MKT' AS factor, asset, round(beta, 6) + 0.0 AS beta FROM pb")
def off_calendar_rebalance_dropped(spark, sf_dir):
    a, f = panels.segments(spark, sf_dir)
    month = f.select("ts").distinct()
    times = month.where(F.month("ts").isin(3, 9)).select(F.col("ts").alias("t")).union(month.where(F.month("ts") == 6).select((F.col("ts") + F.expr("interval 10 days")).alias("t")))
    out = pit_robust_betas(a, f, half_life=HALF_LIFE, min_timestamps=LEAST, rebalance=times)
    return out["betas"].select("timestamp", "factor", "asset", _r(F.col("beta")).alias("beta"))


@_query(_with(SEG.replace("a AS (SELECT ts, asset, v / nullif", "a AS (SELECT ts, asset, CASE WHEN asset = 'BUILDING' AND ts < TIMESTAMP '1997-06-01' THEN NULL WHEN asset = 'MACHINERY' AND ts < TIMESTAMP '1999-01-01' AND ts <> TIMESTAMP '1996-03-01' THEN NULL ELSE 1 END * (v / nullif").replace("ORDER BY ts), 0) - 1 AS ret FROM sv)", "ORDER BY ts), 0) - 1) AS ret FROM sv)"), _EVERY, _chain("tt")) + """,
    fl AS (SELECT asset, min(ts) AS first FROM a WHERE ret IS NOT NULL GROUP BY asset),
    st AS (SELECT t, count(beta) AS k FROM betas GROUP BY t),
    fb AS (SELECT g.ts, g.asset, CASE WHEN b.beta IS NULL AND st.k > 0 AND fl.first <= g.ts THEN 1.0::DOUBLE ELSE b.beta END AS beta
           FROM grid g LEFT JOIN betas b ON b.t = g.ts AND b.asset = g.asset LEFT JOIN st ON st.t = g.ts LEFT JOIN fl ON fl.asset = g.asset)
    SELECT ts AS timestamp, 'MKT' AS factor, asset, round(last_value(beta IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) + 0.0 AS beta FROM fb""")
def fill_missing_betas(spark, sf_dir):
    """Live segments without a fit get beta 1 at times that have one; two segments are made to start late."""
    a, f = panels.segments(spark, sf_dir)
    late = F.when((F.col("asset") == "BUILDING") & (F.col("ts") < F.lit("1997-06-01").cast("timestamp_ntz")), None).when((F.col("asset") == "MACHINERY") & (F.col("ts") < F.lit("1999-01-01").cast("timestamp_ntz")) & (F.col("ts") != F.lit("1996-03-01").cast("timestamp_ntz")), None).otherwise(F.col("ret"))
    out = pit_robust_betas(a.withColumn("ret", late), f, half_life=HALF_LIFE, min_timestamps=LEAST, fill_missing_betas=True)
    return out["betas"].select("timestamp", "factor", "asset", _r(F.col("beta")).alias("beta"))


_HALF = "h AS (SELECT ts, asset, CASE WHEN month(ts) % 2 = 0 THEN ret END AS v FROM a)"


@_query(_with(SEG, _HALF) + " SELECT ts, asset, round(last_value(v IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) + 0.0 AS v FROM h")
def forward_fill(spark, sf_dir):
    a, _ = panels.segments(spark, sf_dir)
    half = a.select("ts", "asset", F.when(F.month("ts") % 2 == 0, F.col("ret")).alias("v"))
    return reshape.forward_fill(half, ["asset"], "ts", "v").select("ts", "asset", _r(F.col("v")).alias("v"))


@_query(_with(SEG) + " SELECT ts, asset, round(lag(ret) OVER (PARTITION BY asset ORDER BY ts), 6) + 0.0 AS before FROM a")
def lag_returns(spark, sf_dir):
    a, _ = panels.segments(spark, sf_dir)
    return reshape.lag(a, ["asset"], "ts", "ret", "before").select("ts", "asset", _r(F.col("before")).alias("before"))


@_query(_with(SEG) + " SELECT ts, asset, round(ret - lag(ret) OVER (PARTITION BY asset ORDER BY ts), 6) + 0.0 AS change FROM a")
def first_differences(spark, sf_dir):
    a, _ = panels.segments(spark, sf_dir)
    return reshape.difference(a, ["asset"], "ts", "ret", "change").select("ts", "asset", _r(F.col("change")).alias("change"))


@_query(_with(SEG) + ", b AS (SELECT ts, asset, ret * CASE WHEN asset = 'BUILDING' AND month(ts) = 5 THEN NULL ELSE 0.5::DOUBLE END AS h FROM a) SELECT ts, round(sum(h), 6) + 0.0 AS total FROM b GROUP BY ts")
def partial_factor_sum(spark, sf_dir):
    """Sums over what is there; missing only where all is missing."""
    a, _ = panels.segments(spark, sf_dir)
    part = F.when((F.col("asset") == "BUILDING") & (F.month("ts") == 5), None).otherwise(F.col("ret") * 0.5)
    return a.groupBy("ts").agg(_r(F.sum(part)).alias("total"))


# ---- compounding and attribution ----


@_query(_with(EVT) + " SELECT ts, asset, CASE WHEN ret IS NOT NULL THEN round(product(1 + ret) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1, 6) + 0.0 END AS cum FROM e")
def cum_returns(spark, sf_dir):
    e = panels.event_days(spark, sf_dir)
    return returns.cumulative(e, ["asset"], "ts", "ret").select("ts", "asset", _r(F.col("cum")).alias("cum"))


_WIDE = ", wide AS (SELECT ts, " + ", ".join(f"max(ret) FILTER (WHERE asset = '{s}') AS \"{s}\"" for s in SEGMENTS) + " FROM a GROUP BY ts), full_rows AS (SELECT * FROM wide WHERE " + " AND ".join(f'"{s}" IS NOT NULL' for s in SEGMENTS) + ")"


def _full_rows(spark, sf_dir):
    a, _ = panels.segments(spark, sf_dir)
    return reshape.drop_any_missing(reshape.to_wide(a, ["ts"], "asset", "ret", SEGMENTS), ["ts"])


@_query(_with(SEG) + _WIDE + " " + " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, round(corr(\"{x}\", \"{y}\"), 6) + 0.0 AS corr FROM full_rows" for x in SEGMENTS for y in SEGMENTS))
def corr_matrix(spark, sf_dir):
    return returns.correlations(_full_rows(spark, sf_dir), SEGMENTS).select("a", "b", _r(F.col("corr")).alias("corr"))


@_query(_with(SEG) + _WIDE + " " + " UNION ALL ".join(f"SELECT '{x}' AS component, round(var_samp(\"{x}\") / var_samp(\"AUTOMOBILE\"), 6) + 0.0 AS share FROM full_rows" for x in SEGMENTS))
def variance_shares(spark, sf_dir):
    return returns.variance_shares(_full_rows(spark, sf_dir), SEGMENTS, "AUTOMOBILE").select("component", _r(F.col("share")).alias("share"))


_SECTORS = [("AUTOMOBILE", "MACHINERY"), ("BUILDING", "HOUSEHOLD"), ("FURNITURE", "HOUSEHOLD")]
_STAGE_TWO = """sec(stock, sector) AS (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in _SECTORS) + """),
    l AS (SELECT ts, asset, resid AS ret FROM pr WHERE ts IN (SELECT ts FROM pr WHERE resid IS NOT NULL)),
    a2 AS (SELECT ts, stock AS asset, ret FROM l JOIN sec ON asset = stock), f2 AS (SELECT ts, stock AS asset, ret FROM l JOIN sec ON asset = sector),
    t2 AS (SELECT DISTINCT ts AS t FROM a2)"""


@_query(_with(SEG, _EVERY, _chain("tt"), _STAGE_TWO, _chain("t2", "a2", "f2", "z", True)) + """
    SELECT a.ts, stock, round(a.ret, 6) + 0.0 AS total, round(-ph.hedge, 6) + 0.0 AS market, round(-zph.hedge, 6) + 0.0 AS sector, round(zpr.resid, 6) + 0.0 AS residual
    FROM a JOIN sec ON asset = stock JOIN ph ON ph.ts = a.ts AND ph.asset = stock JOIN zph ON zph.ts = a.ts AND zph.asset = stock JOIN zpr ON zpr.ts = a.ts AND zpr.asset = stock
    WHERE a.ret IS NOT NULL AND ph.hedge IS NOT NULL AND zph.hedge IS NOT NULL AND zpr.resid IS NOT NULL""")
def two_stage_resids(spark, sf_dir):
    """Segments against the market, then three segments' residuals against two others', all in one job."""
    a, f = panels.segments(spark, sf_dir)
    rets = a.unionByName(f.select("ts", F.lit("MKT").alias("asset"), "ret"))
    pairs = spark.createDataFrame(_SECTORS, "stock string, sector string")
    out = two_stage(rets, "MKT", pairs, half_life=HALF_LIFE, min_timestamps=LEAST)["components"]
    return out.select("ts", "stock", *[_r(F.col(c)).alias(c) for c in ("total", "market", "sector", "residual")])
