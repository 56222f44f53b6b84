"""Return panels of the test tables, as DataFrames and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import returns
from .sources.readers import read_table


def _bucket(unit: str, col: str):
    return F.date_trunc(unit, col).cast("timestamp_ntz")


def segment_values(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """(ts, asset, v): order value by period and customer segment."""
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", _bucket(unit, "o_orderdate").alias("ts"))
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("asset"))
    # partial sums by customer first: the join then moves a row for each customer and period at most
    part = orders.groupBy("o_custkey", "ts").agg(F.sum("o_totalprice").alias("v"))
    return part.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("ts", "asset").agg(F.sum("v").alias("v"))


def segments(spark: SparkSession, sf_dir: str, unit: str = "month") -> tuple[DataFrame, DataFrame]:
    """assets (ts, asset, ret) and factors (ts, factor, ret): the segments, and all of them together as MKT."""
    v = segment_values(spark, sf_dir, unit)
    market = v.groupBy("ts").agg(F.sum("v").alias("v")).withColumn("factor", F.lit("MKT"))
    assets = returns.from_values(v, ["asset"], "ts", "v").select("ts", "asset", "ret")
    factors = returns.from_values(market, ["factor"], "ts", "v").select("ts", "factor", "ret")
    return assets, factors


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, asset, ret): daily return of each event type's value."""
    e = read_table(spark, sf_dir, "events").select(_bucket("day", "ts").alias("ts"), F.col("event_type").alias("asset"), "value")
    return returns.from_values(e.groupBy("ts", "asset").agg(F.sum("value").alias("v")), ["asset"], "ts", "v").select("ts", "asset", "ret")


def segments_sql(unit: str = "month") -> str:
    """The panel as CTEs a (ts, asset, ret) and f (ts, factor, ret)."""
    return f"""
        sv AS (SELECT date_trunc('{unit}', o_orderdate)::TIMESTAMP AS ts, c_mktsegment AS asset, sum(o_totalprice) AS v
               FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
        mv AS (SELECT ts, sum(v) AS v FROM sv GROUP BY ts),
        a AS (SELECT ts, asset, v / nullif(lag(v) OVER (PARTITION BY asset ORDER BY ts), 0) - 1 AS ret FROM sv),
        f AS (SELECT ts, 'MKT' AS factor, v / nullif(lag(v) OVER (ORDER BY ts), 0) - 1 AS ret FROM mv)"""


def events_sql() -> str:
    return """
        ev AS (SELECT date_trunc('day', ts)::TIMESTAMP AS ts, event_type AS asset, sum(value) AS v FROM events GROUP BY 1, 2),
        e AS (SELECT ts, asset, v / nullif(lag(v) OVER (PARTITION BY asset ORDER BY ts), 0) - 1 AS ret FROM ev)"""


def _normal_sums(k: int, w: str) -> str:
    """The sums of the normal equations of y on a constant and x1 to xk, weighted with w."""
    x = [f"x{j}" for j in range(1, k + 1)]
    own = [f"sum({w}) AS sw", f"sum({w}*y) AS sy", *[f"sum({w}*{v}) AS s_{v}" for v in x], *[f"sum({w}*{v}*y) AS s_{v}y" for v in x]]
    return ", ".join(own + [f"sum({w}*{u}*{v}) AS s_{u}{v}" for i, u in enumerate(x) for v in x[i:]])


def _solution(k: int) -> str:
    """b0 to bk from these sums, by Cramer's rule."""
    if k == 1:
        det = "(sw*s_x1x1 - s_x1*s_x1)"
        return f"(sy*s_x1x1 - s_x1*s_x1y) / {det} AS b0, (sw*s_x1y - s_x1*sy) / {det} AS b1"
    columns = [["sw", "s_x1", "s_x2"], ["s_x1", "s_x1x1", "s_x1x2"], ["s_x2", "s_x1x2", "s_x2x2"]]
    right = ["sy", "s_x1y", "s_x2y"]

    def det(m: list[list[str]]) -> str:
        (a, b, c), (d, e, f), (g, h, i) = m
        return f"({a}*({e}*{i} - {f}*{h}) - {b}*({d}*{i} - {f}*{g}) + {c}*({d}*{h} - {e}*{g}))"

    return ", ".join(f"{det([right if j == n else c for n, c in enumerate(columns)])} / {det(columns)} AS b{j}" for j in range(3))


def huber_sql(half_life: float | None, min_timestamps: int, times: str, factors: tuple[str, ...] = ("f",), a: str = "a", p: str = "", own_factor: bool = False) -> str:
    """Huber fits of the CTE a (ts, asset, ret) on one or two factor CTEs (ts, ret) as recursive CTEs whose names begin with p; times: a CTE's name with t.
    half_life None: rows aren't weighted. own_factor: the factor has a column asset, its own for each. Gives {p}betas (t, asset, alpha, beta, beta2), one row
    for each fit made."""
    k = len(factors)
    x, b = [f"x{j}" for j in range(1, k + 1)], [f"b{j}" for j in range(k + 1)]
    sqrt_weight = "1.0::DOUBLE" if half_life is None else f"sqrt(pow(exp(ln(0.5::DOUBLE) / {half_life}), {p}wt.n - {p}ix.pos) / {p}wt.norm)"
    lam = 1.0 if half_life is None else f"exp(ln(0.5::DOUBLE) / {half_life})"
    resid = lambda d, c: f"{d}.s * ({d}.y - {c}.b0 - " + " - ".join(f"{c}.b{j} * {d}.x{j}" for j in range(1, k + 1)) + ")"
    rho = lambda z: f"sum(CASE WHEN abs({z}) <= 1.345 THEN 0.5 * ({z})*({z}) ELSE abs({z}) * 1.345::DOUBLE - 0.5 * 1.345::DOUBLE * 1.345::DOUBLE END)"
    cols = lambda t: ", ".join(f"{t}.{c}" for c in b)
    joins = " ".join(f"JOIN {f} ON {f}.ts = {p}ix.ts" + (f" AND {f}.asset = {a}.asset" if own_factor else "") for f in factors)
    values = ", ".join(f"{f}.ret AS {v}" for f, v in zip(factors, x))
    there = " AND ".join(f"{f}.ret IS NOT NULL" for f in factors)
    mad = "0.6744897501960817::DOUBLE"
    return f"""
        {p}ix AS (SELECT ts, row_number() OVER (ORDER BY ts) AS pos FROM (SELECT DISTINCT ts FROM {a})),
        {p}win AS (SELECT t, max(pos) AS n FROM {times} JOIN {p}ix ON ts <= t GROUP BY t),
        {p}wt AS (SELECT t, n, (SELECT sum(pow({lam}, g.i)) FROM range(0, 5000) g(i) WHERE g.i < n) AS norm FROM {p}win),
        {p}ob AS (SELECT {p}wt.t, {a}.asset, {sqrt_weight} AS s, {a}.ret AS y, {values}
               FROM {p}wt JOIN {p}ix ON {p}ix.pos <= {p}wt.n JOIN {a} ON {a}.ts = {p}ix.ts {joins}
               WHERE {a}.ret IS NOT NULL AND {there}),
        {p}big AS (SELECT t, asset, count(*) AS m FROM {p}ob GROUP BY t, asset HAVING count(*) >= {min_timestamps}),
        {p}d AS (SELECT {p}ob.*, {p}big.m FROM {p}ob JOIN {p}big USING (t, asset)),
        {p}c0 AS (SELECT t, asset, any_value(m) AS m, {_normal_sums(k, "s*s")} FROM {p}d GROUP BY t, asset),
        {p}b0 AS (SELECT t, asset, m, {_solution(k)} FROM {p}c0),
        {p}r0 AS (SELECT {p}d.t, {p}d.asset, {p}d.m, {cols(p + "b0")}, {resid(p + "d", p + "b0")} AS r FROM {p}d JOIN {p}b0 USING (t, asset)),
        {p}s0 AS (SELECT t, asset, {", ".join(f"any_value({c}) AS {c}" for c in b)}, median(abs(r)) / {mad} AS scale, sum(r*r) / (any_value(m) - {k + 1}) AS v FROM {p}r0 GROUP BY t, asset),
        {p}v0 AS (SELECT {p}r0.t, {p}r0.asset, {rho("r / v")} AS dev FROM {p}r0 JOIN {p}s0 USING (t, asset) GROUP BY {p}r0.t, {p}r0.asset),
        {p}it AS (
            SELECT {p}s0.t, {p}s0.asset, 1 AS k, {cols(p + "s0")}, {p}s0.scale, {p}v0.dev AS dev, {p}s0.scale = 0 AS done FROM {p}s0 JOIN {p}v0 USING (t, asset)
            UNION ALL
            (WITH w AS (SELECT {p}d.t, {p}d.asset, {p}d.m, {p}d.s, {", ".join(f"{p}d.{v}" for v in x)}, {p}d.y, {p}it.k, {p}it.dev,
                              CASE WHEN abs({resid(p + "d", p + "it")} / {p}it.scale) <= 1.345 THEN 1.0::DOUBLE
                                   ELSE 1.345::DOUBLE / abs({resid(p + "d", p + "it")} / {p}it.scale) END AS h
                       FROM {p}it JOIN {p}d USING (t, asset) WHERE NOT {p}it.done),
                 g AS (SELECT t, asset, {_normal_sums(k, "h*s*s")} FROM w GROUP BY t, asset),
                 b AS (SELECT t, asset, {_solution(k)} FROM g),
                 r AS (SELECT w.t, w.asset, w.m, w.k, w.dev, w.h, {cols("b")}, {resid("w", "b")} AS r FROM w JOIN b USING (t, asset)),
                 s AS (SELECT t, asset, any_value(k) AS k, any_value(dev) AS dev, {", ".join(f"any_value({c}) AS {c}" for c in b)}, median(abs(r)) / {mad} AS scale, sum(h*r*r) / (any_value(m) - {k + 1}) AS v FROM r GROUP BY t, asset),
                 n AS (SELECT r.t, r.asset, {rho("r.r / s.v")} AS dev FROM r JOIN s USING (t, asset) GROUP BY r.t, r.asset)
             SELECT s.t, s.asset, s.k + 1, {cols("s")}, s.scale, n.dev, (s.scale = 0 OR NOT (abs(n.dev - s.dev) > 1e-8 AND s.k + 1 < 50)) FROM s JOIN n USING (t, asset))
        ),
        {p}betas AS (SELECT t, asset, arg_max(b0, k) AS alpha, arg_max(b1, k) AS beta, {"arg_max(b2, k)" if k == 2 else "NULL"} AS beta2 FROM {p}it GROUP BY t, asset)"""
