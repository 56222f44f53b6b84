"""Kernel, weights, causal replay and the point-in-time plan against brute force."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronolens.functions.finite import nan_to_null
from chronolens.functions.huber import fit_huber, fit_windows
from chronolens.functions.weights import exponential_weights
from chronolens.operators import betas as B
from chronolens.operators import reshape, returns
from chronolens.operators.causal import Dataset, first_valid, mask_to, simulate, simulate_distributed
from chronolens.plans.pit import pit_robust_betas
from chronolens.sources.readers import from_pandas, read_returns_csv

DAY = [datetime(2023, 1, 1) + timedelta(days=k) for k in range(120)]


def plain(y, x, t=1.345, tol=1e-8, maxiter=50):
    """One fit, straight from the definition."""
    n, p = x.shape

    def dev(r, w):
        if n - p <= 0:
            return 0.0
        s = (w * r * r).sum() / (n - p)
        if not s > 0:
            return 0.0
        z = np.abs(r / s)
        return np.where(z <= t, 0.5 * z * z, z * t - 0.5 * t * t).sum()

    b = np.linalg.pinv(x) @ y
    r = y - x @ b
    scale, d, k = np.median(np.abs(r)) / 0.6744897501960817, dev(r, np.ones(n)), 1
    while scale != 0:
        z = np.abs(r / scale)
        w = np.where(z <= t, 1.0, t / z)
        b = np.linalg.pinv(np.sqrt(w)[:, None] * x) @ (np.sqrt(w) * y)
        r = y - x @ b
        scale, new, k = np.median(np.abs(r)) / 0.6744897501960817, dev(r, w), k + 1
        if not (abs(new - d) > tol and k < maxiter):
            break
        d = new
    return b


def panel(spark, assets: dict, factors: dict, days=None):
    days = days or DAY

    def long(cols, key):
        rows = [(d, n, None if v is None or v != v else float(v)) for n, c in cols.items() for d, v in zip(days, c)]
        return spark.createDataFrame(rows, f"ts timestamp_ntz, {key} string, ret double")

    return long(assets, "asset"), long(factors, "factor")


def rng(seed=0):
    return np.random.default_rng(seed)


@pytest.mark.parametrize("n,k,seed", [(30, 1, 0), (120, 3, 1), (60, 2, 2)])
def test_kernel_equals_definition(n, k, seed):
    r = rng(seed)
    x = np.column_stack([np.ones(n), r.normal(0, 0.01, (n, k))])
    if k > 1:
        x[:, 2] = x[:, 1] + r.normal(0, 0.002, n)
    y = x @ r.normal(1, 0.5, k + 1) + r.standard_t(3, n) * 0.005
    y[::11] += 0.1
    sw = np.sqrt(exponential_weights(n, half_life=20))
    assert np.allclose(fit_windows(y, x, sw[None])[0][0], plain(sw * y, sw[:, None] * x), atol=1e-9)


def test_windows_are_independent():
    r = rng(3)
    x, y = np.column_stack([np.ones(50), r.normal(size=50)]), r.normal(size=50)
    sw = np.tril(np.ones((50, 50)))[10:]
    many = fit_windows(y, x, sw)[0]
    for k in (0, 7, 39):
        assert np.allclose(many[k], plain(y[: 11 + k], x[: 11 + k]), atol=1e-9)


def test_perfect_fit_and_short_rank():
    x = np.column_stack([np.ones(20), np.arange(20.0)])
    assert np.allclose(fit_huber(2 + 3 * np.arange(20.0), x), [2, 3])
    twin = np.column_stack([x, x[:, 1]])
    assert np.allclose(fit_huber(2 + 4 * np.arange(20.0), twin), [2, 2, 2], atol=1e-6)


def test_weights():
    assert np.isclose(exponential_weights(10, half_life=3).sum(), 1)
    assert np.allclose(exponential_weights(5, half_life=3, lambda_=0.5), exponential_weights(5, lambda_=0.5))
    for bad in ({}, {"half_life": 0}, {"half_life": -1}, {"lambda_": 0}, {"lambda_": 1.5}, {"half_life": -1, "lambda_": 0.5}):
        with pytest.raises(ValueError):
            exponential_weights(5, **bad)


def brute_betas(y, xs, half_life, least):
    """The fit of one asset over a window, or None."""
    n = len(y)
    x = np.column_stack(xs)
    full = np.isfinite(x).all(1)
    if full.sum() < least or full.sum() < 2 or x[full].var(0, ddof=1).min() < 1e-10:
        return None
    on = full & np.isfinite(y)
    if on.sum() < least:
        return None
    s = np.sqrt(exponential_weights(n, half_life))[on]
    return plain(y[on] * s, np.column_stack([np.ones(on.sum()), x[on]]) * s[:, None])[1:]


def make(seed=5, n=60, holes=True):
    r = rng(seed)
    f1, f2 = r.normal(0, 0.01, n), r.normal(0, 0.01, n)
    a, b = 1.2 * f1 + 0.5 * f2 + r.normal(0, 0.005, n), 0.8 * f1 - f2 + r.normal(0, 0.005, n)
    b[:25] = np.nan
    if holes:
        f2[[12, 33, 34]] = np.nan
        f1[40] = np.inf
        a[[20, 50]] = np.nan
        f2[:5] = np.nan
    return {"A": a, "B": b, "DEAD": np.full(n, np.nan)}, {"F1": f1, "F2": f2}


@pytest.mark.parametrize("fill", [False, True])
def test_pit_equals_brute_force(spark, fill):
    assets, factors = make()
    n = 60
    a, f = panel(spark, assets, factors)
    times = [DAY[k] for k in (2, 10, 20, 30, 31, 47, 55)] + [DAY[22] + timedelta(hours=5)]
    out = pit_robust_betas(a, f, half_life=15, min_timestamps=12, fill_missing_betas=fill, rebalance=spark.createDataFrame([(t,) for t in times], "t timestamp_ntz"))
    got = {(r.timestamp, r.factor, r.asset): r.beta for r in out["betas"].collect()}
    assert len(got) == n * 2 * 3
    resid = {(r.timestamp, r.asset): r.resid for r in out["resid"].collect()}
    total = {(r.timestamp, r.asset): r.hedge_ret for r in out["hedge"].collect()}
    fitted = {}
    for t in times:
        m = sum(d <= t for d in DAY[:n])
        if t not in DAY or not all(np.any(~np.isnan(v[:m])) for v in factors.values()):
            continue
        each = {k: brute_betas(v[:m], [w[:m] for w in factors.values()], 15, 12) for k, v in assets.items()}
        if fill and any(v is not None for v in each.values()):
            each = {k: np.ones(2) if v is None and np.any(~np.isnan(assets[k][:m])) else v for k, v in each.items()}
        for k, v in each.items():
            if v is not None:
                fitted[t, k] = v
    for k in assets:
        beta = [np.nan, np.nan]
        for j in range(n):
            before, beta = beta, fitted.get((DAY[j], k), beta)
            for i, name in enumerate(factors):
                want, have = beta[i], got[DAY[j], name, k]
                assert (have is None) == bool(np.isnan(want)) and (have is None or abs(have - want) < 1e-8)
            parts = [-b * v[j] for b, v in zip(before, factors.values()) if not np.isnan(b) and not np.isnan(v[j])]
            assert (total[DAY[j], k] is None) == (not parts)
            if parts and np.isfinite(parts).all():
                assert abs(total[DAY[j], k] - sum(parts)) < 1e-10
            there = parts and not np.isnan(assets[k][j])
            assert (resid[DAY[j], k] is None) == (not there)


def test_no_look_ahead(spark):
    assets, factors = make(holes=False)
    a, f = panel(spark, assets, factors)
    whole = pit_robust_betas(a, f, half_life=15, min_timestamps=12, rebalance=spark.createDataFrame([(DAY[k],) for k in (30, 40)], "t timestamp_ntz"))["resid"].where(F.col("timestamp") <= F.lit(DAY[40])).collect()
    cut = F.col("ts") <= F.lit(DAY[40])
    part = pit_robust_betas(a.where(cut), f.where(cut), half_life=15, min_timestamps=12, rebalance=spark.createDataFrame([(DAY[k],) for k in (30, 40)], "t timestamp_ntz"))["resid"].collect()
    key = lambda rows: sorted((r.timestamp, r.asset, None if r.resid is None else round(r.resid, 10)) for r in rows)
    assert [x[:2] for x in key(whole)] == [x[:2] for x in key(part)] and all(x[2] == y[2] for x, y in zip(key(whole), key(part)))


@pytest.mark.parametrize(
    "change,message",
    [
        (lambda a, f: (a.limit(0), f), "empty"),
        (lambda a, f: (a.withColumn("ts", F.lit(1)), f), "timestamp column is needed"),
        (lambda a, f: (a.where(F.col("ts") > F.lit(DAY[3])), f), "same times"),
        (lambda a, f: (a.union(a.where("asset = 'A'")), f), "time and asset"),
        (lambda a, f: (a, f.union(f.where("factor = 'F1'"))), "time and factor"),
        (lambda a, f: (a, f.withColumn("ret", F.when(F.col("factor") == "F1", F.col("ret")))), "without a single finite value"),
        (lambda a, f: (a, f.withColumn("ret", F.when(F.col("factor") == "F1", F.col("ret")).otherwise(0.01))), "never move"),
        (lambda a, f: (a, f.withColumn("ret", F.when((F.col("factor") == "F2") & (F.col("ts") <= F.lit(DAY[1])), 0.5).otherwise(F.col("ret")))), "Error processing timestamp 2023-01-02"),
    ],
)
def test_pit_refuses(spark, change, message):
    assets, factors = make(n=30, holes=False)
    with pytest.raises(ValueError, match=message):
        pit_robust_betas(*change(*panel(spark, assets, factors)), half_life=15, min_timestamps=12)


def test_pit_duplicate_rebalance_and_bad_weights(spark):
    a, f = panel(spark, *make(n=30, holes=False))
    with pytest.raises(ValueError, match="given once only"):
        pit_robust_betas(a, f, half_life=15, rebalance=spark.createDataFrame([(DAY[20],), (DAY[20],)], "t timestamp_ntz"))
    with pytest.raises(ValueError, match="half_life or lambda_"):
        pit_robust_betas(a, f, rebalance=spark.createDataFrame([(DAY[20],)], "t timestamp_ntz"))
    # a window that never comes to its weights doesn't look at them
    out = pit_robust_betas(a, f, min_timestamps=200)
    assert out["betas"].where("beta is not null").isEmpty() and out["resid"].count() == 90


def test_robust_betas(spark):
    r = rng(42)
    spy = r.normal(0, 0.01, 100)
    y = 1.5 * spy + r.normal(0, 0.005, 100)
    hole = y.copy()
    hole[7] = np.nan
    a, f = panel(spark, {"A": y, "H": hole, "FEW": np.where(np.arange(100) < 95, np.nan, y)}, {"SPY": spy})
    got = {x.asset: x.beta for x in B.robust_betas(a, f, half_life=30).collect()}
    assert abs(got["A"] - brute_betas(y, [spy], 30, 10)[0]) < 1e-9 and abs(got["H"] - brute_betas(hole, [spy], 30, 10)[0]) < 1e-9 and got["FEW"] is None
    same = {x.asset: x.beta for x in B.parallel_robust_betas(a.orderBy(F.rand(1)), f, half_life=30, n_jobs=3).collect()}
    assert all(got[k] is None and same[k] is None or abs(got[k] - same[k]) < 1e-12 for k in got)
    with pytest.raises(ValueError, match="near-zero"):
        B.robust_betas(*panel(spark, {"A": y}, {"SPY": np.full(100, 0.01)}), half_life=30)


# ---- causal replay ----


def test_simulate(spark):
    a = spark.createDataFrame([(DAY[k], k, float(k) if k >= 2 else None) for k in range(5)], "ts timestamp_ntz, early long, late double")
    seen = []

    def run(data):
        seen.append(data["x"].columns)
        return {"sum": {"total": data["x"].agg(F.sum("early")).first()[0]}, "rows": data["x"].limit(0), "none": {}}

    out = simulate({"x": Dataset(a)}, run, [DAY[0] - timedelta(days=1), DAY[1], DAY[4], DAY[1]])
    assert seen == [["ts", "early"], ["ts", "early", "late"], ["ts", "early"]]
    assert sorted(r.total for r in out["sum"].collect()) == [1, 1, 10]
    assert out["rows"].isEmpty() and out["none"].count() == 3
    got = []
    assert simulate({"x": Dataset(a)}, run, [DAY[2]], on_result=lambda t, r: got.append((t, r["sum"]["total"]))) == {} and got == [(DAY[2], 3)]
    for bad in (lambda d: 1, lambda d: {"x": 2}, lambda d: 1 / 0):
        with pytest.raises(ValueError, match="Error processing timestamp 2023-01-03"):
            simulate({"x": Dataset(a)}, bad, [DAY[2]])
    with pytest.raises(ValueError, match="timestamp column is needed"):
        simulate({"x": Dataset(a.withColumn("ts", F.lit(1)))}, run, [DAY[2]])
    assert mask_to(a, DAY[2]).count() == 3
    assert {r.col: r.first_valid for r in first_valid(Dataset(a)).collect()} == {"early": DAY[0], "late": DAY[2]}


def test_simulate_distributed(spark):
    p = spark.createDataFrame([(DAY[k], s, float(k), float(k) if k >= 3 else None) for k in range(5) for s in "ab"], "ts timestamp_ntz, symbol string, x double, late double")
    m = spark.createDataFrame([(DAY[k], k) for k in range(3)], "ts timestamp_ntz, m long")

    def run(t, data):
        return pd.DataFrame({"n": [len(data["p"])], "cols": [",".join(data["p"].columns)], "m": [float(data["m"]["m"].sum()) if "m" in data["m"] else None]})

    times = spark.createDataFrame([(t,) for t in (DAY[0] - timedelta(days=1), DAY[1], DAY[1], DAY[3])], "t timestamp_ntz")
    out = simulate_distributed({"p": Dataset(p, keys=("symbol",)), "m": Dataset(m)}, run, times, "n long, cols string, m double")
    assert sorted((r.t, r.n, r.cols, r.m) for r in out.collect()) == [(DAY[1], 4, "ts,symbol,x", 1.0)] * 2 + [(DAY[3], 8, "ts,symbol,x,late", 3.0)]


# ---- sources and shapes ----


def test_csv_and_pandas(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Date,B,A,C\n2023-01-02 00:00:00-05:00,0.1,,3\n2023-01-03 00:00:00-05:00,NaN,0.2,4\n")
    df = read_returns_csv(spark, str(tmp_path / "r.csv"), ["A", "B"])
    assert [tuple(r) for r in df.orderBy("ts").collect()] == [(datetime(2023, 1, 2, 5), None, 0.1), (datetime(2023, 1, 3, 5), 0.2, None)]
    with pytest.raises(ValueError):
        read_returns_csv(spark, str(tmp_path / "r.csv"), ["Z"])
    frame = pd.DataFrame({"x": [1.0, np.nan]}, index=pd.DatetimeIndex(DAY[:2]))
    assert [r.x for r in from_pandas(spark, frame).orderBy("ts").collect()] == [1.0, None]


def test_shapes(spark):
    w = spark.createDataFrame([(DAY[0], 1.0, None), (DAY[1], None, None), (DAY[2], 3.0, 4.0)], "ts timestamp_ntz, a double, b double")
    long = reshape.to_long(w, ["ts"])
    assert long.count() == 6 and reshape.restack(w, ["ts"]).count() == 3
    back = reshape.to_wide(long, ["ts"], "asset", "ret", ["a", "b"])
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, w.collect()), key=str)
    assert reshape.drop_all_missing(w, ["ts"]).count() == 2 and reshape.drop_any_missing(w, ["ts"]).count() == 1
    assert sorted(r.col_pos for r in reshape.to_long_by_position(w, ["ts"], ["dup", "dup"]).where("ts = '2023-01-03'").collect()) == [0, 1]
    cum = {r.ts: r.cum for r in returns.cumulative(long.where("asset = 'a'"), ["asset"], "ts", "ret").collect()}
    assert cum[DAY[0]] == 1.0 and cum[DAY[1]] is None and cum[DAY[2]] == 7.0
    assert nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "v double")).where("v is null").count() == 1
    assert reshape.union_by_name([w, w.drop("b")]).count() == 6


def test_streaming_replay(spark, tmp_path):
    from chronolens.streaming.replay import replay

    src = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(DAY[k], float(k))], "ts timestamp_ntz, v double").coalesce(1).write.mode("append").parquet(src)
    got = []
    q = replay(spark, src, "ts timestamp_ntz, v double", lambda t, df: got.append((t, df.count())), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(got) == [(DAY[0], 1), (DAY[1], 2), (DAY[2], 3)]


def test_streaming_replay_late_rows(spark, tmp_path):
    """A file that hasn't had its turn is never seen; a late row brings its time up again."""
    import time

    from chronolens.streaming.replay import replay

    src, files = str(tmp_path / "in"), [[(DAY[0], 1.0)], [(DAY[1], 2.0)], [(DAY[0], 100.0), (DAY[2], 3.0)]]
    for rows in files:
        spark.createDataFrame(rows, "ts timestamp_ntz, v double").coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files come in the order of their times
    got = []
    for _ in range(2):  # nothing is left the second time
        replay(spark, src, "ts timestamp_ntz, v double", lambda t, df: got.append((t, df.agg(F.sum("v")).first()[0])), str(tmp_path / "ck")).awaitTermination(120)
    assert got == [(DAY[0], 1.0), (DAY[1], 3.0), (DAY[0], 101.0), (DAY[2], 106.0)]


def test_result_sinks(spark, tmp_path):
    from chronolens.sources.readers import write_by_time
    from chronolens.streaming.replay import write_results

    df = spark.createDataFrame([(DAY[0], 1), (DAY[1], 2)], "t timestamp_ntz, v long")
    write_by_time(df.withColumn("t", F.to_date("t")), str(tmp_path / "a"))
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "a")).where("t = '2023-01-02'").collect()) == [2] or spark.read.parquet(str(tmp_path / "a")).count() == 2
    sink = write_results(str(tmp_path / "b"))
    for _ in range(2):  # a time that comes again replaces its folder
        sink(DAY[0], df.select("v"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2


# ---- plans, faults and as-of lookups ----


def test_correlations_equal_numpy(spark):
    r = rng(8)
    x = r.normal(0, 1, (300, 7)) @ r.normal(0, 1, (7, 7)) + 1e4
    x[r.random(x.shape) < 0.2] = np.nan
    x[:, 6] = 2.0
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcdef") + ["const.col"])).repartition(5)
    df = nan_to_null(df)
    got = {(q.a, q.b): q.corr for q in returns.correlations(df, df.columns).collect()}
    assert len(got) == 49 and all(got[a, "const.col"] is None for a in "abcdef")
    for i, a in enumerate("abcdef"):
        for j, b in enumerate("abcdef"):
            on = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert abs(got[a, b] - np.corrcoef(x[on, i], x[on, j])[0, 1]) < 1e-9
    assert {q.corr for q in returns.correlations(df.limit(0), ["a", "b"]).collect()} <= {None}


def test_edges_of_the_panel(spark):
    """Rebalance times before all data, an asset without a value, rows in any order, inputs left as they are."""
    assets, factors = make(n=30, holes=False)
    a, f = panel(spark, {**assets, "GONE": np.full(30, np.nan)}, factors)
    early = spark.createDataFrame([(DAY[0] - timedelta(days=9),)], "t timestamp_ntz")
    out = pit_robust_betas(a, f, half_life=15, min_timestamps=12, rebalance=early)
    assert out["betas"].where("beta is not null").isEmpty() and out["resid"].where("resid is not null").isEmpty()
    columns = a.columns
    one = pit_robust_betas(a, f, half_life=15, min_timestamps=12)["betas"]
    two = pit_robust_betas(a.orderBy(F.rand(3)).repartition(3), f.orderBy(F.rand(4)), half_life=15, min_timestamps=12)["betas"]
    key = lambda df: sorted((x.timestamp, x.factor, x.asset, None if x.beta is None else round(x.beta, 10)) for x in df.collect())
    assert key(one) == key(two) and a.columns == columns
    gone = [x for x in key(one) if x[2] == "GONE"]
    assert gone and all(x[3] is None for x in gone)


def test_plan_reads_its_panel_once(spark, tmp_path):
    assets, factors = make(n=40, holes=False)
    a, f = panel(spark, assets, factors)
    for name, df in (("a", a), ("f", f)):
        df.write.parquet(str(tmp_path / name))
    a, f = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "f"))
    out = pit_robust_betas(a, f, half_life=15, min_timestamps=12)
    for k, df in out.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "FileScan" not in plan, k
    assert {r.fit for r in out["fits"].select("fit").distinct().collect()} == {"ok"}


def test_n_jobs_bounds_the_partitions_that_fit(spark):
    a, f = panel(spark, *make(n=40, holes=False))
    plan = lambda n: B.robust_betas(a, f, half_life=15, n_jobs=n)._jdf.queryExecution().executedPlan().toString()
    assert "block#" in plan(3) and ", 3), REPARTITION_BY_NUM" in plan(3) and "REPARTITION_BY_NUM" not in plan(-1)


def test_failed_fit_is_missing(monkeypatch):
    """A solver that breaks down on some windows leaves the others as they are."""
    from chronolens.functions import huber

    r = np.random.default_rng(1)
    x = np.column_stack([np.ones(30), r.normal(size=30)])
    y, sw = x @ [0.1, 2.0] + r.normal(0, 0.1, 30), np.ones((3, 30))
    inside = np.stack([np.arange(30) < n for n in (10, 20, 30)])
    whole, state = B._betas(y, x, sw, inside)
    assert state.tolist() == ["ok"] * 3
    solve = huber._solve

    def broken(w, *rest):
        if (np.count_nonzero(w, axis=1) == 20).any():
            raise np.linalg.LinAlgError("no")
        return solve(w, *rest)

    monkeypatch.setattr(huber, "_solve", broken)
    part, state = B._betas(y, x, sw, inside)
    assert state.tolist() == ["ok", "fit_error", "ok"] and np.isnan(part[1]).all() and np.allclose(part[[0, 2]], whole[[0, 2]])
    monkeypatch.undo()
    assert B._betas(x @ [0.0, 2.0], x, sw, inside)[1].tolist() == ["perfect_fit"] * 3


def test_lazy_failures_name_their_time(spark):
    a = spark.createDataFrame([(DAY[k], 0) for k in range(3)], "ts timestamp_ntz, v long")
    fails = lambda d: {"x": d["x"].select(F.raise_error(F.lit("no")).alias("v"))}
    with pytest.raises(ValueError, match="Error processing timestamp 2023-01-03"):
        simulate({"x": Dataset(a)}, fails, [DAY[2]], eager=True)
    bad = simulate_distributed({"x": Dataset(a)}, lambda t, d: 1 / 0, a.select(F.col("ts").alias("t")).limit(1), "n long")
    with pytest.raises(Exception, match="Error processing timestamp 2023-01-01"):
        bad.collect()


def test_asof_lookups(spark):
    from chronolens.operators import causal

    r = np.random.default_rng(5)
    rows = [(DAY[int(k)], s, float(v)) for k in r.choice(60, 25, replace=False) for s, v in (("a", r.normal()), ("b", r.normal()))]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, s string, v double")
    times = [DAY[k] for k in (0, 7, 7, 20, 59)] + [DAY[0] - timedelta(days=3)]
    cal = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    for n in (1, 3):
        got = sorted(map(tuple, causal.asof_dates(cal, df, n).collect()))
        want = sorted((t, *x) for t in set(times) for x in rows if x[0] in sorted({y[0] for y in rows if y[0] <= t})[-n:])
        assert got == want
    got = {x.t: (x.n, round(x.total, 9)) for x in causal.growing(cal, df, {"n": F.count("v"), "total": F.sum("v")}).collect()}
    assert got == {t: (len(k), round(sum(x[2] for x in k), 9)) for t in set(times) for k in [[x for x in rows if x[0] <= t]] if k}
    assert causal.asof_dates(cal, df.limit(0)).isEmpty() and causal.asof_dates(cal.limit(0), df).isEmpty()


def test_many_duplicates_are_counted(spark):
    from chronolens.operators.checks import NAMED, require_unique

    df = spark.createDataFrame([(k,) for k in range(NAMED + 5)] * 2, "k long")
    with pytest.raises(ValueError, match="and 5 more"):
        require_unique(df, ["k"], "twice")
