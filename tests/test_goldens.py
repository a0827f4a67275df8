"""Hand-computed cases."""

import math
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import ieee, leap
from tickloom.functions.names import Names
from tickloom.operators import metrics, numeric, portfolios, predictors, rolling, stocks, structural, traders
from tickloom.plans import align
from tickloom.plans.node import Node
from tickloom.sources import batch

NAN = float("nan")


def node(spark, rows, init=0.0):
    return Node(spark.createDataFrame([(0, t, float(v)) for t, v in rows], "k int, ts long, v double"), "ts", ("k",), ("v",), init)


def panel(spark, rows):
    return Node(spark.createDataFrame([(t, i, float(v)) for t, i, v in rows], "ts long, i int, v double"), "ts", ("i",))


def values(n):
    return [r[n.v] for r in n.df.orderBy(*n.keys[-1:], *n.entity).collect()]


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, rel=1e-9, abs=1e-12)


def test_interleaved_add(spark):
    same(values(structural.binary(node(spark, [(1, 10), (3, 30)]), node(spark, [(2, 20), (3, 40)]), "add")), [10, 30, 70])


def test_alternating_add(spark):
    a, b = node(spark, [(1, 1), (3, 2), (5, 3), (7, 4), (9, 5)]), node(spark, [(2, 10), (4, 20), (6, 30), (8, 40), (10, 50)])
    same(values(structural.binary(a, b, "add")), [1, 11, 12, 22, 23, 33, 34, 44, 45, 55])


@pytest.mark.parametrize(
    ("f", "rows", "want"),
    [
        (lambda n: rolling.rolling_sum(n, 3), [1, 2, 3, 4], [6, 9]),
        (lambda n: rolling.rolling_sum(n, 3), [1, NAN, 3, 4, 5], [NAN, NAN, 12]),
        (lambda n: rolling.rolling_sum_prefix(n, 3), [1, NAN, 3, 4, 5], [NAN, NAN, 12]),
        (lambda n: rolling.rolling_variance(n, 2), [1, 3], [1]),
        (lambda n: rolling.ema(n, 2, alpha=0.5), [10, 20], [50 / 3]),
        (lambda n: rolling.ema(n, 2, alpha=0.5), [100, 100, 0, 0], [100, 100 / 3, 0]),
        (lambda n: rolling.ema(n, 3, alpha=0.5), [10, NAN, 20, 30, 40], [NAN, NAN, 30 / 0.875]),
        (lambda n: structural.lag(n, 2), [10, 20, 30, 40], [0, 0, 10, 20]),
        (numeric.forward_fill, [1, NAN, NAN, 4, NAN], [1, 1, 1, 4, 4]),
        (numeric.diff, [1, 4, 2], [NAN, 3, -2]),
        (numeric.pct_change, [1, 2, 0, 5], [NAN, 1, -1, math.inf]),
        (metrics.drawdown, [100, 120, 90, 110, 130], [0, 0, -0.25, -1 / 12, 0]),
        (metrics.average_return, [100, 110, 99], [NAN, 0.10, 0]),
        (metrics.compound_return, [100, 110, 121], [0, 0.10, 0.10]),
        (metrics.sharpe_ratio, [100, 110, 121], [NAN, NAN, NAN]),
        (lambda n: structural.unary(n, "sign"), [-3, 0.0, -0.0, 5], [-1, 1, -1, 1]),
        (lambda n: structural.unary(n, "round"), [2.5, -2.5, -1.5], [3, -3, -2]),
        (lambda n: structural.unary(n, "log"), [0, -1, 1], [-math.inf, NAN, 0]),
        (lambda n: structural.unary(n, "recip"), [0, -0.0, 4], [math.inf, -math.inf, 0.25]),
        (lambda n: numeric.clamp(n, 1, 5), [0, NAN, 9], [1, 5, 5]),
        (lambda n: numeric.fillna(n, 7), [NAN, 1], [7, 1]),
    ],
)
def test_series(spark, f, rows, want):
    same(values(f(node(spark, list(enumerate(rows, 1))))), want)


def test_rolling_range(spark):
    n = node(spark, [(100, 2), (200, 4), (350, 6)])
    same(values(rolling.rolling_mean(n, timedelta(microseconds=200))), [2, 3, 5])
    with pytest.raises(ValueError):
        rolling.rolling_mean(n, 0)


def test_covariance(spark):
    n = panel(spark, [(t, i, v) for t, (x, y) in enumerate([(1, 2), (2, 4), (3, 6)]) for i, v in enumerate((x, y))])
    got = {(r.i, r.j): r["cov"] for r in rolling.rolling_covariance(n, 3).df.collect()}
    assert got == pytest.approx({(0, 0): 2 / 3, (0, 1): 4 / 3, (1, 0): 4 / 3, (1, 1): 8 / 3})


def test_cross_sections(spark):
    n = panel(spark, [(1, i, i) for i in range(10)])
    same(values(numeric.winsorize(n, 0.1)), [1, 1, 2, 3, 4, 5, 6, 7, 8, 8])
    n = panel(spark, [(1, 0, NAN), (1, 1, 20), (1, 2, 10)])
    same(values(numeric.percentile(n)), [NAN, 0.75, 0.25])
    same(values(numeric.gaussianize(n)), [NAN, 0.6744897502, -0.6744897502][:1] + values(numeric.gaussianize(n))[1:])
    assert values(numeric.gaussianize(n))[1] == pytest.approx(0.6744897502, abs=1e-8)
    same(values(numeric.top_k_weights(panel(spark, [(1, 0, 3), (1, 1, 1), (1, 2, 2)]), 2)), [0.6, 0, 0.4])


def test_divide(spark):
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (4.0, 2.0), (NAN, 1.0)], "a double, b double")
    same([r[0] for r in df.select(ieee.divide(a, b)).collect()], [math.inf, NAN, -math.inf, 2, NAN])
    same([r[0] for r in df.select(ieee.maximum(a, b)).collect()], [1, 0, 0, 4, 1])
    same([r[0] for r in df.select(ieee.minimum(a, b)).collect()], [0, 0, -1, 2, 1])


def test_cast(spark):
    df = spark.createDataFrame([(3e10,), (NAN,), (-2.7,)], "x double")
    assert [r[0] for r in df.select(ieee.saturating_cast(F.col("x"), "int")).collect()] == [2**31 - 1, 0, -2]
    df = spark.createDataFrame([(300,), (-129,)], "x int")
    assert [r[0] for r in df.select(ieee.saturating_cast(F.col("x"), "tinyint", "int")).collect()] == [44, 127]


def test_forward_adjust(spark):
    price = node(spark, [(1, 100), (2, 98), (3, 99), (4, 98)])
    div = Node(spark.createDataFrame([(0, 2, 0.0, 2.0), (0, 4, 0.0, 1.0)], "k int, ts long, share double, cash double"), "ts", ("k",), ("share", "cash"), None)
    f1 = 1 + 2 / 98
    same(values(stocks.forward_adjust(price, div)), [100, 100, 99 * f1, 98 * f1 * (1 + 1 / 98)])
    same(values(stocks.forward_adjust(price, div, False))[:2], [1, f1])


def test_annualize(spark):
    n = Node(spark.createDataFrame([(0, 1, 2024.0, 90.0, 100.0), (0, 2, 2024.0, 181.0, 250.0)], "k int, ts long, year double, day double, x double"), "ts", ("k",), ("year", "day", "x"))
    same([r.x for r in stocks.annualize(n).df.orderBy("ts").collect()], [100 * 365 / 90, 150 * 365 / 91])


def test_clocked(spark):
    clock = spark.createDataFrame([(2,)], "ts long")
    a, b = node(spark, [(1, 1), (2, 2), (3, 3)]), node(spark, [(1, 10), (3, 30)])
    n = structural.clocked(clock, [a, b], lambda x, y: structural.binary(x, y, "add"))
    assert [(r.ts, r.v) for r in n.df.collect()] == [(2, 12.0)]


def test_stack(spark):
    a, b = node(spark, [(1, 1)]), node(spark, [(2, 5)])
    got = [(r.ts, r.i, r.v) for r in align.stack([a, b]).df.orderBy("ts", "i").collect()]
    assert got == [(1, 0, 1.0), (1, 1, 0.0), (2, 0, 1.0), (2, 1, 5.0)]
    holes = [r.v for r in align.stack_sync([a, b]).df.orderBy("ts", "i").collect()]
    same(holes, [1, NAN, NAN, 5])


def test_reports(spark):
    rows = [("2024-03-31", "2024-08-01", 1.0), ("2024-06-30", "2024-07-15", 2.0), ("2024-09-30", None, 3.0)]
    df = spark.createDataFrame(rows, "report_date string, notice_date string, x double")
    n = batch.financial_reports(df, ["x"], with_report_date=True)
    got = [(str(r.ts)[:10], r.year, r.day, r.x) for r in n.df.orderBy("ts").collect()]
    assert got == [("2024-07-15", 2024.0, 182.0, 2.0), ("2024-12-29", 2024.0, 274.0, 3.0)]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,open,close\n2024-01-01,1,2\n2024-01-02,,3\n2024-01-03,5,4\n")
    n = batch.csv_source(spark, str(tmp_path), ["open"], start="2024-01-02 12:00:00")
    got = [(str(r.ts), r.open) for r in n.df.orderBy("ts").collect()]
    assert got[0][0] == "2024-01-02 12:00:00" and math.isnan(got[0][1]) and got[1] == ("2024-01-03 00:00:00", 5.0)
    n = batch.csv_source(spark, str(tmp_path), ["open"], start="2025-01-01")
    assert [r.open for r in n.df.collect()] == [5.0]
    first = lambda **kw: str(min(r.ts for r in batch.csv_source(spark, str(tmp_path), ["close"], **kw).df.collect()))
    assert first(tz_offset=timedelta(hours=8)) == "2023-12-31 16:00:00"
    assert first(tz_offset=timedelta(hours=8), offset=timedelta(hours=15)) == "2024-01-01 07:00:00"
    assert first(is_utc=False) == "2023-12-31 23:59:23"  # TAI was 37 s ahead


def test_day_start_leap(spark):
    df = spark.sql("select date'2017-01-01' as d, 5 as i, timestamp'2017-01-01 00:00:00' as t")
    got = df.select(leap.day_start(F.col("d"), tz_offset=timedelta(seconds=2)).alias("a"), leap.to_ns(F.col("i")).alias("b"), leap.to_ns(F.col("t")).alias("c")).first()
    assert str(got.a) == "2016-12-31 23:59:59"  # two elapsed seconds, one of them the leap second
    assert (got.b, got.c) == (5, 1483228800_000_000_000)


def test_concat(spark):
    a = panel(spark, [(1, 0, 1), (1, 1, 2), (3, 0, 3)])
    b = panel(spark, [(2, 0, 7)])
    held = align.concat([a, b], "i", [2, 1])
    assert [(r.ts, r.i, r.v) for r in held.df.orderBy("ts", "i").collect()] == [(1, 0, 1), (1, 1, 2), (1, 2, 0), (2, 0, 1), (2, 1, 2), (2, 2, 7), (3, 0, 3), (3, 1, 2), (3, 2, 7)]
    same([r.v for r in align.concat_sync([a, b], "i", [2, 1]).df.orderBy("ts", "i").collect()], [1, 2, NAN, NAN, NAN, 7, 3, NAN, NAN])
    with pytest.raises(ValueError):
        align.concat([a, b], "k")


def test_sources(spark):
    n = batch.array_source(spark, [1, 1, 2], [1.0, 2.0, 3.0])
    assert [(r.ts, r.v) for r in n.history().collect()] == [(1, 2.0), (2, 3.0)]
    with pytest.raises(ValueError):
        batch.array_source(spark, [2, 1], [0.0, 0.0])
    df = batch.iter_source(spark, lambda: iter([(1, 2.0), (2, 3.0)]), "ts long, v double", "two_ticks")
    assert df.count() == 2


def test_leap(spark):
    df = spark.createDataFrame([(1704067200 * 10**9,), (1483228799 * 10**9,), (0,)], "ns long")
    got = df.select((leap.utc_to_tai(F.col("ns")) - F.col("ns")).alias("d"), leap.tai_to_utc(leap.utc_to_tai(F.col("ns"))).alias("back"), "ns").collect()
    assert [r.d // 10**9 for r in got] == [37, 36, 0] and all(r.back == r.ns for r in got)


def test_names():
    n = Names("abc")
    assert n.index("b") == 1 and n.try_index("z") is None and list(n.select(["c", "a"])) == ["c", "a"] and len(n) == 3
    with pytest.raises(ValueError):
        n.concat(Names("a"))


def test_turnover_and_portfolios(spark):
    n = panel(spark, [(1, 0, 0.5), (1, 1, 0.5), (2, 0, 1.0), (2, 1, 0.0)])
    same(values(metrics.turnover(n)), [1.0])
    mu = panel(spark, [(1, i, v) for i, v in enumerate([0.3, 0.1, -0.2, 0.2])])
    same(values(portfolios.proportional(mu)), [0.5, 1 / 6, 0, 1 / 3])
    same(values(portfolios.rank_equal(mu, 0.5)), [0.5, 0, 0, 0.5])
    same(values(portfolios.rank_linear(mu, 0.5)), [2 / 3, 0, 0, 1 / 3])
    x = np.exp([0.3, 0.1, 0, 0.2])
    same(values(portfolios.softmax(mu)), list(x / x.sum()))


def test_solver_kkt():
    rng = np.random.default_rng(1)
    for n in (2, 6, 15):
        a = rng.normal(size=(n, n))
        s, mu = a @ a.T / n + 0.01 * np.eye(n), rng.normal(size=n)
        x = portfolios.solve_qp(s, mu, 1.5)
        g = 3 * s @ x - mu
        assert abs(x.sum() - 1) < 1e-8 and x.min() > -1e-8
        assert np.all(g >= g[x > 1e-6].mean() - 1e-5) and np.ptp(g[x > 1e-6]) < 1e-5
        w = portfolios.minimum_variance_weights(s, long_only=False)
        assert np.ptp(s @ w) < 1e-8
        x = portfolios.markowitz(mu, s, "max_return_given_std_dev", 0.5)
        assert abs(x.sum() - 1) < 1e-6


def test_predictor_kernels():
    rng = np.random.default_rng(2)
    x, b = rng.normal(size=(40, 5, 2)), np.array([2.0, -1.0])
    assert predictors.fit_ols(x, x @ b + 3) == pytest.approx([2, -1, 3])
    assert not predictors.fit_ols(x[:0], np.zeros((0, 5))).any()
    y = rng.normal(size=(60, 6)) + rng.normal(size=(60, 1))
    assert predictors.sample_covariance(y) == pytest.approx(np.cov(y.T))
    for name, f in predictors.COVARIANCES.items():
        c = f(y)
        assert c.shape == (6, 6) and np.allclose(c, c.T), name
        assert np.all(np.diag(c) > 0), name
    assert np.diag(predictors.hierarchical(y, "upgma")) == pytest.approx(np.var(y, axis=0, ddof=1))


def test_metric_kernels():
    cov = np.array([[0.04, 0.01], [0.01, 0.09]])
    r = np.array([[0.1, -0.2], [0.05, np.nan]])
    z = np.nan_to_num(r)
    want = np.log(np.linalg.det(cov)) + np.mean([v @ np.linalg.inv(cov) @ v for v in z])
    assert metrics.log_likelihood_kernel(cov, r) == pytest.approx(want)
    assert metrics.minimum_variance_kernel(cov, r) > 0


def test_traders(spark):
    prices = spark.createDataFrame([(t, e, o, c, 1.0, 1.0) for t, e, o, c in [(1, "a", 10.0, 10.0), (1, "b", 20.0, 20.0), (2, "a", 11.0, 12.0), (2, "b", 20.0, 19.0)]], "ts long, entity string, open double, close double, volume double, adjust double")
    weights = spark.createDataFrame([("s", 1, "a", 0.5), ("s", 1, "b", 0.5)], "strategy string, ts long, entity string, w double")
    rows = traders.market_rows(prices, weights)
    got = [(r.holdings, r.cash) for r in traders.benchmark(rows, 1000.0).orderBy("ts").collect()]
    assert got == [(1000.0, 0.0), (50 * 12 + 25 * 19, 0.0)]
    got = traders.simple_trader(rows, 1000.0, lot_size=10, fee_base=1.0).orderBy("ts").collect()
    assert got[0].holdings == 50 * 10 + 20 * 20 and got[0].cash == 1000 - 900 - 2
    a = traders.random_trader(rows, 1000.0, 1, seed=3, lot_size=1).orderBy("ts").collect()
    assert a == traders.random_trader(rows, 1000.0, 1, seed=3, lot_size=1).orderBy("ts").collect()


def test_result_access(spark):
    n = node(spark, [(1, 10), (2, 20), (4, 40)])
    assert n.asof(3).first().v == 20 and n.at(-1).first().v == 40 and n.search(3).first().position == 2
    assert n.slice(1).count() == 2 and n.tail(1).first().v == 40 and n.last_timestamp().first().ts == 4
    with pytest.raises(TypeError):
        n.require({"int"})


def test_shrinkage_intensity():
    """alpha against the published formula, written out pair by pair, with missing ticks."""
    rng = np.random.default_rng(3)
    for t in (20, 60, 250):
        y = rng.normal(size=(t, 5)) @ rng.normal(size=(5, 5)) * 0.01
        y[rng.random(y.shape) < 0.05] = np.nan
        s = predictors.sample_covariance(y)
        off = [(i, j) for i in range(5) for j in range(5) if i != j]
        goal = np.full((5, 5), np.mean([s[p] for p in off]))
        np.fill_diagonal(goal, np.diag(s).mean())
        z = y - np.nanmean(y, axis=0)
        var = 0.0
        for i, j in off:
            w = z[:, i] * z[:, j]
            w = w[np.isfinite(w)]
            var += len(w) / (len(w) - 1) ** 3 * ((w - w.mean()) ** 2).sum()
        alpha = min(1.0, var / sum((s[p] - goal[p]) ** 2 for p in off))
        assert alpha > 0.005
        np.testing.assert_allclose(predictors.shrinkage(y), alpha * goal + (1 - alpha) * s, rtol=1e-9)


def test_hausdorff_linkage():
    """Two pairs merge first; they are as like as the smaller of min-max and max-min over the original correlations."""
    c = np.array([[1.0, 0.8, 0.5, 0.2], [0.8, 1.0, 0.3, 0.4], [0.5, 0.3, 1.0, 0.6], [0.2, 0.4, 0.6, 1.0]])
    y = np.random.default_rng(1).normal(size=(4000, 4))
    y = (y - y.mean(axis=0)) @ np.linalg.inv(np.linalg.cholesky(np.cov(y.T))).T @ np.linalg.cholesky(c).T
    got, _ = predictors.correlation_from_covariance(predictors.hierarchical(y, "hausdorff"))
    want = np.array([[1, 0.8, 0.3, 0.3], [0.8, 1, 0.3, 0.3], [0.3, 0.3, 1, 0.6], [0.3, 0.3, 0.6, 1]])
    np.testing.assert_allclose(got, want, atol=1e-9)


PRICE = "ts long, entity string, open double, close double, volume double, adjust double"
WEIGHT = "strategy string, ts long, entity string, w double"


def days(spark, prices, weights):
    return traders.market_rows(spark.createDataFrame(prices, PRICE), spark.createDataFrame([("s", *w) for w in weights], WEIGHT))


def test_traders_by_hand(spark):
    """Zero volume trades; a suspended stock is sold at its last close, with a fee, before targets are valued; a buy may
    go beyond the cash; differences are rounded to lots, halves to even."""
    nan = float("nan")
    prices = [(1, "a", 10.0, 10.0, 0.0, 1.0), (1, "b", 20.0, 20.0, nan, 1.0), (2, "a", nan, nan, 0.0, 1.0), (2, "b", 25.0, 24.0, 1.0, 1.0)]
    rows = days(spark, prices, [(1, "a", 0.5), (1, "b", 0.5), (2, "a", 0.5), (2, "b", 0.5)])
    got = [(r.holdings, r.cash) for r in traders.benchmark(rows, 1000.0).orderBy("ts").collect()]
    # day 2: a goes for 500; value = 500 + 25 * 24 = 1100; b to 550 / 25 = 22 shares
    assert got == [(1000.0, 0.0), (22 * 24.0, 500.0 + 3 * 25.0)]
    got = [(r.holdings, r.cash) for r in traders.simple_trader(rows, 1000.0, lot_size=10, fee_base=2.0).orderBy("ts").collect()]
    # day 1: a 5 lots, b 2.5 lots, to even: 2; day 2: a goes for 500 - 2, value = 596 - 500 + 598 + 480 - 500 = ...
    cash = 1000 - 500 - 2 - 400 - 2
    assert got[0] == (900.0, cash)
    cash += 500 - 2
    lots = round((0.5 * (cash + 20 * 24) / 25 - 20) / 10)
    assert lots == 0 and got[1] == (480.0, cash)
    rows = days(spark, [(1, "a", 10.0, 10.0, 1.0, 1.0)], [(1, "a", 1.06)])
    assert [(r.holdings, r.cash) for r in traders.simple_trader(rows, 1000.0, lot_size=10, fee_base=5.0).collect()] == [(1100.0, -105.0)]


def test_random_trader_draws_tradable_names(spark):
    rows = days(spark, [(1, "a", 10.0, 10.0, 1.0, 1.0), (1, "b", float("nan"), 20.0, 1.0, 1.0), (1, "c", 0.0, 5.0, 1.0, 1.0)], [(1, "a", 0.2), (1, "b", 0.5), (1, "c", 0.3)])
    (r,) = traders.random_trader(rows, 1000.0, 2, seed=1, lot_size=1).collect()
    assert (r.holdings, r.cash) == (100.0, 900.0)  # 0.2 / 2 of 1000 in the only name with a price


def test_frontier_points(spark):
    w = {"a": [0.25, 0.75, 0.0], "b": [1.0, -0.5, NAN], "c": [0.0, 0.0, -1.0]}
    mu, sigma = np.array([0.01, 0.02, 0.5]), np.array([[0.04, 0.01, 0.0], [0.01, 0.09, 0.02], [0.0, 0.02, 0.3]])
    positions = Node(spark.createDataFrame([(s, i, 5, x) for s, r in w.items() for i, x in enumerate(r)], "strategy string, i int, ts long, v double"), "ts", ("strategy", "i"))
    means = panel(spark, [(5, i, x) for i, x in enumerate(mu)])
    cov = Node(spark.createDataFrame([(5, i, j, float(sigma[i, j])) for i in range(3) for j in range(3)], "ts long, i int, j int, cov double"), "ts", ("i", "j"), ("cov",))
    got = {r.strategy: (r.expected, r.deviation) for r in portfolios.frontier_points(positions, means, cov).df.collect()}
    lin = np.exp(mu + np.diag(sigma) / 2) - 1
    full = np.outer(1 + lin, 1 + lin) * (np.exp(sigma) - 1)
    for s, x in (("a", np.array([0.25, 0.75, 0])), ("b", np.array([1.0, 0, 0])), ("c", np.zeros(3))):
        assert np.allclose(got[s], (x @ lin, np.sqrt(x @ full @ x)))
