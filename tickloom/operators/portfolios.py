"""Portfolio construction at universe ticks: rank and softmax weights in the JVM, optimisers as Arrow functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import ieee
from tickloom.operators.predictors import nothing
from tickloom.plans.align import asof_join
from tickloom.plans.node import Node

# --- mean portfolios ---


def usable_returns(universe: Node, predictions: Node, logarithmic: bool = True) -> Node:
    """mu at each universe tick: null outside the universe or without a finite prediction."""
    df = asof_join(universe.renamed("_u"), predictions.renamed("_p"))
    mu = F.expm1("_p") if logarithmic else F.col("_p")
    ok = (F.col("_u") > 0) & F.col("_p").isNotNull() & ieee.finite("_p")
    return Node(df.select(*universe.keys, F.when(ok, mu).alias("v")), universe.ts, universe.entity)


def _weights(mu: Node, weight: Column) -> Node:
    return mu.derive(F.coalesce(weight, F.lit(0.0)))


def proportional(mu: Node) -> Node:
    plus = F.greatest(F.col(mu.v), F.lit(0.0))
    total = F.sum(plus).over(mu.across())
    return _weights(mu, F.when(total > 0, plus / total))


def _ranked(mu: Node, top_fraction: float) -> tuple[Node, Column, Column]:
    """rank among the positive, largest first (ties by entity), and how many are taken: half-even rounding."""
    plus = F.when(F.col(mu.v) > 0, F.col(mu.v))
    rank = F.row_number().over(mu.across().orderBy(plus.desc_nulls_last(), *mu.entity))
    k = F.bround(F.count(plus).over(mu.across()) * top_fraction)
    df = mu.df.withColumn("_r", F.when(plus.isNotNull(), rank)).withColumn("_k", k)
    return mu.with_df(df), F.col("_r"), F.col("_k")


def rank_equal(mu: Node, top_fraction: float = 0.1) -> Node:
    mu, r, k = _ranked(mu, top_fraction)
    return _weights(mu, F.when((r <= k) & (k > 0), 1 / F.greatest(k, F.lit(1))))


def rank_linear(mu: Node, top_fraction: float = 0.1) -> Node:
    mu, r, k = _ranked(mu, top_fraction)
    return _weights(mu, F.when((r <= k) & (k > 0), (k - r + 1) / F.greatest(k * (k + 1) / 2, F.lit(1))))


def softmax(mu: Node, temperature: float = 1.0) -> Node:
    x = F.exp(F.greatest(F.col(mu.v), F.lit(0.0)) / temperature)
    x = F.when(F.col(mu.v).isNotNull(), x)
    return _weights(mu, x / F.sum(x).over(mu.across()))


# --- solvers ---


def solve_qp(sigma: np.ndarray, mu: np.ndarray, risk: float, long_only: bool = True, full: bool = True, floor: float | None = None) -> np.ndarray | None:
    """min risk * x' sigma x - mu' x with sum x = 1 (<= 1 unless full), x >= 0 if long_only, mu' x >= floor.

    A primal-dual interior method on the general form; None if it finds no feasible point.
    """
    n = len(mu)
    p = 2 * risk * (sigma + sigma.T) / 2 + 1e-10 * np.eye(n)
    rows, caps = [], []
    if long_only:
        rows += list(-np.eye(n))
        caps += [0.0] * n
    if not full:
        rows.append(np.ones(n))
        caps.append(1.0)
    if floor is not None:
        rows.append(-mu)
        caps.append(-floor)
    g, h = np.array(rows).reshape(-1, n), np.array(caps)
    a = np.ones((1, n)) if full else np.zeros((0, n))
    b = np.ones(len(a))
    q = np.zeros(n) if floor is not None else -mu
    m = len(h)
    x = np.full(n, 1.0 / n)
    if not m:
        kkt = np.block([[p, a.T], [a, np.zeros((len(a), len(a)))]])
        return np.linalg.lstsq(kkt, np.concatenate([-q, b]), rcond=None)[0][:n]
    s, z, y = np.maximum(h - g @ x, 1e-2), np.ones(m), np.zeros(len(a))
    for _ in range(100):
        rd, rp, re = p @ x + q + g.T @ z + a.T @ y, g @ x + s - h, a @ x - b
        gap = s @ z / m
        if max(np.abs(rd).max(), np.abs(rp).max(), np.abs(re).max() if len(re) else 0.0, gap) < 1e-10:
            break
        kkt = np.block([[p + g.T * (z / s) @ g, a.T], [a, np.zeros((len(a), len(a)))]])

        def step(target: np.ndarray, kkt=kkt, rd=rd, rp=rp, re=re):
            right = np.concatenate([-rd - g.T @ ((target + z * rp) / s), -re])
            d = np.linalg.lstsq(kkt, right, rcond=None)[0]
            dx, dy = d[:n], d[n:]
            ds = -rp - g @ dx
            dz = (target - z * ds) / s
            return dx, dy, ds, dz

        def length(v: np.ndarray, dv: np.ndarray) -> float:
            neg = dv < 0
            return min(1.0, 0.99 * float((-v[neg] / dv[neg]).min())) if neg.any() else 1.0

        dx, dy, ds, dz = step(-s * z)
        t = min(length(s, ds), length(z, dz))
        centre = (((s + t * ds) @ (z + t * dz) / m) / gap) ** 3 if gap > 0 else 0.0
        dx, dy, ds, dz = step(centre * gap - s * z - ds * dz)
        t = min(length(s, ds), length(z, dz))
        x, y, s, z = x + t * dx, y + t * dy, s + t * ds, z + t * dz
    else:
        if np.abs(g @ x + s - h).max() > 1e-6 or (len(a) and np.abs(a @ x - b).max() > 1e-6):
            return None
    return x if np.isfinite(x).all() else None


def _bisect(f: Callable[[float], float], low: float, high: float, goal: float) -> float:
    """The log-spaced point where decreasing f meets goal."""
    for _ in range(60):
        mid = float(np.sqrt(low * high))
        low, high = (mid, high) if f(mid) > goal else (low, mid)
    return high


def markowitz(mu: np.ndarray, sigma: np.ndarray, mode: str, bound: float, long_only: bool = True, full: bool = True) -> np.ndarray:
    """Weights by mode; equal weights where there is no feasible or finite solution; negatives clipped if long_only.

    min_variance_given_return: least variance with mu' x >= bound. max_return_given_std_dev: most return with a
    deviation of bound at most. min_mean_variance: mu' x - bound * x' sigma x. min_mean_std_dev: mu' x - bound * std.
    """
    n = len(mu)
    equal = np.full(n, 1.0 / n)
    std = lambda x: float(np.sqrt(max(x @ sigma @ x, 0.0)))
    solve = lambda risk: solve_qp(sigma, mu, risk, long_only, full)
    spread = lambda risk: std(equal if (x := solve(risk)) is None else x)
    try:
        if mode == "min_variance_given_return":
            x = solve_qp(sigma, mu, 1.0, long_only, full, floor=bound)
        elif mode == "max_return_given_std_dev":
            x = solve(1e-6)
            if x is not None and std(x) > bound:
                x = None if spread(1e8) > bound * (1 + 1e-6) else solve(_bisect(spread, 1e-6, 1e8, bound))
        elif mode == "min_mean_variance":
            x = solve(bound)
        elif mode == "min_mean_std_dev":
            # at the optimum the quadratic problem with risk = bound / (2 std) has the same solution
            low, high = 1e-6, 1e8
            for _ in range(60):
                mid = float(np.sqrt(low * high))
                low, high = (low, mid) if 2 * mid * spread(mid) > bound else (mid, high)
            x = solve(high)
        else:
            raise ValueError(f"no mode {mode}")
    except np.linalg.LinAlgError:
        x = None
    if x is None:
        return equal
    return np.maximum(x, 0.0) if long_only else x


def minimum_variance_weights(sigma: np.ndarray, long_only: bool = True) -> np.ndarray:
    n = len(sigma)
    if long_only:
        x = solve_qp(sigma, np.zeros(n), 1.0)
        return np.full(n, 1.0 / n) if x is None else np.maximum(x, 0.0)
    w = np.linalg.pinv(sigma) @ np.ones(n)
    return w / w.sum()


# --- portfolios that need covariances ---


def optimised_all(universe: Node, covariances: Node, returns: Node | None, strategies: dict[str, Callable[..., np.ndarray]], logarithmic: bool = True) -> Node:
    """Positions of each strategy (entity: strategy, stock) at each universe tick, zero outside the mask, from one pass.

    A strategy is a function of (mu, sigma), or of sigma without returns.

    Inputs are read as of the universe tick. In the mask are stocks of the universe with a finite diagonal (and mean).
    Log inputs become linear: mu = expm1(m + diag / 2), sigma = (1 + mu)(1 + mu)' expm1(c). Ticks are solved in parallel.
    """
    (e,) = universe.entity
    ticks = universe.df.select(F.col(universe.ts).alias("uts")).distinct()

    def latest(node: Node) -> DataFrame:
        own = node.df.select(F.col(node.ts).alias("t")).distinct()
        marks = own.select("t", F.col("t").alias("p"), F.lit(None).cast(own.schema["t"].dataType).alias("uts")).unionByName(ticks.select(F.col("uts").alias("t"), F.lit(None).cast(own.schema["t"].dataType).alias("p"), "uts"))
        spec = Window.orderBy("t", F.col("uts").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        at = marks.withColumn("p", F.last("p", True).over(spec)).where("uts is not null and p is not null").select("uts", F.col("p").alias("t"))
        return node.df.withColumnRenamed(node.ts, "t").join(F.broadcast(at), "t").drop("t")

    cov = latest(covariances).select("uts", F.col("i").alias(e), "j", F.col(covariances.v).alias("cov"))
    kind, key = dict(universe.df.dtypes)[universe.ts], dict(universe.df.dtypes)[e]
    side = universe.df.select(F.col(universe.ts).alias("uts"), e, F.col(universe.v).alias("u"))
    has_means = returns is not None
    if has_means:
        side = side.join(latest(returns).select("uts", e, F.col(returns.v).alias("mu")), ["uts", e], "left")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return nothing("strategy", "ts", e, "v")
        names = sorted(left[e])
        w = pd.DataFrame(0.0, index=names, columns=list(strategies))
        if len(right):
            m = right.pivot(index=e, columns="j", values="cov")
            ok = [i for i in names if i in m.index and np.isfinite(m.loc[i, i])]
            row = left.set_index(e)
            ok = [i for i in ok if row.loc[i, "u"] > 0 and (not has_means or np.isfinite(row.loc[i, "mu"]))]
            s = m.loc[ok, ok].to_numpy(float)
            if not np.isfinite(s).all():
                raise ValueError("covariances inside the mask aren't finite")
            mu = row.loc[ok, "mu"].to_numpy(float) if has_means else None
            if logarithmic and ok:
                d = np.diag(s) / 2
                lin = np.expm1((mu if mu is not None else -d) + d)
                s = np.outer(1 + lin, 1 + lin) * np.expm1(s)
                mu = lin if mu is not None else None
            if ok:
                for name, positions in strategies.items():
                    w.loc[ok, name] = positions(mu, s) if has_means else positions(s)
        n = len(names)
        return pd.DataFrame({"strategy": [name for name in strategies for _ in names], "ts": [left["uts"].iloc[0]] * n * len(strategies), e: names * len(strategies), "v": w.to_numpy().T.ravel()})

    out = side.groupBy("uts").cogroup(cov.groupBy("uts")).applyInPandas(run, f"strategy string, ts {kind}, {e} {key}, v double")
    return Node(out, "ts", ("strategy", e))


def optimised(universe: Node, covariances: Node, returns: Node | None, positions: Callable[..., np.ndarray], logarithmic: bool = True) -> Node:
    """The positions of one strategy, as optimised_all()."""
    many = optimised_all(universe, covariances, returns, {"": positions}, logarithmic)
    return Node(many.df.drop("strategy"), many.ts, universe.entity)


def minimum_variance(universe: Node, covariances: Node, long_only: bool = True, logarithmic: bool = True) -> Node:
    return optimised(universe, covariances, None, lambda s: minimum_variance_weights(s, long_only), logarithmic)


def markowitz_portfolio(universe: Node, returns: Node, covariances: Node, mode: str, bound: float, long_only: bool = True, full: bool = True, logarithmic: bool = True) -> Node:
    return optimised(universe, covariances, returns, lambda m, s: markowitz(m, s, mode, bound, long_only, full), logarithmic)


def markowitz_std(universe: Node, returns: Node, covariances: Node, risk_aversion: float = 1.0, long_only: bool = True) -> Node:
    """Mean less risk_aversion times deviation, fully invested."""
    return markowitz_portfolio(universe, returns, covariances, "min_mean_std_dev", risk_aversion, long_only)


def frontier_points(positions: Node, returns: Node, covariances: Node) -> Node:
    """(expected, deviation) of the positions of each strategy at their ticks, by the log moments predicted at those ticks.

    positions: entity (strategy, stock). Moments become linear as in optimised(). Only finite positive positions count;
    where a strategy has none, both are 0.
    """
    (strategy, e), ts = positions.entity, positions.ts
    kinds = dict(positions.df.dtypes)
    means = returns.df.select(F.col(returns.ts).alias(ts), e, F.col(returns.v).alias("m"))
    held = positions.df.select(strategy, ts, e, F.col(positions.v).alias("w")).join(means, [ts, e], "left")
    cov = covariances.df.select(F.col(covariances.ts).alias(ts), "i", "j", F.col(covariances.v).alias("c"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        full = right.pivot(index="i", columns="j", values="c")
        rows = []
        for name, own in left.groupby(strategy, dropna=False):
            own = own[np.isfinite(own["w"].to_numpy(float)) & (own["w"].to_numpy(float) > 0)]
            x, sigma = own["w"].to_numpy(float), full.reindex(index=own[e], columns=own[e]).to_numpy(float)
            mu = np.expm1(own["m"].to_numpy(float) + np.diag(sigma) / 2)
            sigma = np.outer(1 + mu, 1 + mu) * np.expm1(sigma)
            rows.append((name, left[ts].iloc[0], float(mu @ x), float(np.sqrt(max(x @ sigma @ x, 0.0)))))
        return pd.DataFrame(rows, columns=["strategy", "ts", "expected", "deviation"])

    out = held.groupBy(ts).cogroup(cov.groupBy(ts)).applyInPandas(run, f"strategy {kinds[strategy]}, ts {kinds[ts]}, expected double, deviation double")
    return Node(out, "ts", ("strategy",), ("expected", "deviation"))
