"""Return and covariance prediction at universe ticks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans.node import Node

# --- kernels: x is (ticks, stocks, features), y is (ticks, stocks) ---


def fit_ols(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pooled least squares with the intercept last; zeros if there are too few rows or no finite solution."""
    k = x.shape[2]
    rows, goal = x.reshape(-1, k), y.reshape(-1)
    ok = np.isfinite(rows).all(axis=1) & np.isfinite(goal)
    rows, goal = np.column_stack([rows[ok], np.ones(ok.sum())]), goal[ok]
    if len(rows) < k + 1:
        return np.zeros(k + 1)
    beta = np.linalg.lstsq(rows, goal, rcond=None)[0]
    return beta if np.isfinite(beta).all() else np.zeros(k + 1)


def predict_ols(beta: np.ndarray, now: np.ndarray) -> np.ndarray:
    return now @ beta[:-1] + beta[-1]


def fit_mean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    n = np.isfinite(y).sum(axis=0)
    return np.where(n > 0, np.nansum(np.where(np.isfinite(y), y, np.nan), axis=0) / np.maximum(n, 1), np.nan)


def sample_covariance(y: np.ndarray) -> np.ndarray:
    """Centred by each stock's own mean, products over common ticks by their number less one."""
    ok = np.isfinite(y)
    d = np.where(ok, y - fit_mean(y, y), 0.0)
    return d.T @ d / np.maximum(ok.astype(float).T @ ok - 1, 1)


def correlation_from_covariance(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    std = np.sqrt(np.maximum(np.diag(s), 0.0))
    scale = np.where(std > 0, std, 1.0)
    c = np.clip(s / np.outer(scale, scale), -1.0, 1.0)
    np.fill_diagonal(c, 1.0)
    return c, std


def single_index(y: np.ndarray) -> np.ndarray:
    """Betas on the equal-weight mean: var(f) beta beta' + diag of residual variances (n - 2 degrees of freedom)."""
    ok = np.isfinite(y)
    f = np.where(ok, y, 0.0).sum(axis=1) / np.maximum(ok.sum(axis=1), 1)
    var_f = f.var(ddof=1) if len(f) > 1 else 0.0
    beta, rest = np.zeros(y.shape[1]), np.zeros(y.shape[1])
    for j in range(y.shape[1]):
        g, r = f[ok[:, j]], y[ok[:, j], j]
        if len(r) < 2:
            continue
        gd = g - g.mean()
        ss = gd @ gd
        beta[j] = gd @ (r - r.mean()) / ss if ss > 0 else 0.0
        e = r - r.mean() - beta[j] * gd
        rest[j] = e @ e / (len(r) - 2) if len(r) > 2 else 0.0
    return var_f * np.outer(beta, beta) + np.diag(rest)


def shrinkage(y: np.ndarray, target: str = "common_covariance") -> np.ndarray:
    """alpha * target + (1 - alpha) * sample, alpha by Schaefer and Strimmer, clipped to [0, 1].

    alpha is the summed variance of the covariances over their summed squared distance from the target, both off the
    diagonal; pairs with fewer than two common ticks have no variance, and at no distance alpha is 1.
    """
    s = sample_covariance(y)
    n = len(s)
    if n < 2:
        return s
    off = ~np.eye(n, dtype=bool)
    if target == "common_covariance":
        goal = np.full((n, n), s[off].mean())
        np.fill_diagonal(goal, np.diag(s).mean())
    elif target == "constant_correlation":
        c, std = correlation_from_covariance(s)
        goal = c[off].mean() * np.outer(std, std)
        np.fill_diagonal(goal, np.diag(s))
    elif target == "single_index":
        goal = single_index(y)
    else:
        raise ValueError(f"no shrinkage target {target}")
    ok = np.isfinite(y)
    if ok.any(axis=1).sum() < 2:
        return goal
    d = np.where(ok, y - fit_mean(y, y), 0.0)
    m = ok.astype(float).T @ ok
    products = d.T @ d
    spread = (d**2).T @ d**2 - products**2 / np.maximum(m, 1.0)  # summed over the ticks that both have
    noise = np.where(m >= 2, m / np.maximum(m - 1, 1.0) ** 3 * spread, 0.0)
    gap = ((s - goal) ** 2)[off].sum()
    alpha = float(np.clip(noise[off].sum() / gap, 0.0, 1.0)) if gap >= 1e-30 else 1.0
    return alpha * goal + (1 - alpha) * s


def rmt(y: np.ndarray, keep_mean: bool) -> np.ndarray:
    """Noise eigenvalues of the correlations, below the Marchenko-Pastur edge, to zero or to their mean."""
    s = sample_covariance(y)
    c, std = correlation_from_covariance(s)
    t, n = y.shape
    values, vectors = np.linalg.eigh(c)
    var = max(1 - values[-1] / n, 0.0)
    noise = values < var * (1 + n / t + 2 * np.sqrt(n / t))
    values = np.where(noise, values[noise].mean() if keep_mean and noise.any() else 0.0, values)
    c = vectors * values @ vectors.T
    if keep_mean:
        scale = np.sqrt(np.maximum(np.diag(c), 1e-300))
        c = c / np.outer(scale, scale)
    np.fill_diagonal(c, 1.0)
    return c * np.outer(std, std)


def hierarchical(y: np.ndarray, linkage: str) -> np.ndarray:
    """Correlations replaced by the similarity at which two stocks' clusters merge ('upgma', 'wpgma', 'hausdorff')."""
    c, std = correlation_from_covariance(sample_covariance(y))
    n = len(c)
    out = np.eye(n)
    sim = c.copy()
    np.fill_diagonal(sim, -np.inf)
    members = {i: [i] for i in range(n)}
    level = np.inf
    while len(members) > 1:
        a, b = np.unravel_index(np.argmax(sim), sim.shape)
        a, b = min(a, b), max(a, b)
        level = min(level, sim[a, b])
        for i in members[a]:
            out[i, members[b]] = out[members[b], i] = level
        na, nb = len(members[a]), len(members[b])
        members[a] = members[a] + members.pop(b)
        for k in members:
            if k == a:
                continue
            if linkage == "upgma":
                v = (na * sim[a, k] + nb * sim[b, k]) / (na + nb)
            elif linkage == "wpgma":
                v = (sim[a, k] + sim[b, k]) / 2
            elif linkage == "hausdorff":
                block = c[np.ix_(members[a], members[k])]
                v = min(block.max(axis=1).min(), block.min(axis=1).max())
            else:
                raise ValueError(f"no linkage {linkage}")
            sim[a, k] = sim[k, a] = v
        sim[b, :] = sim[:, b] = -np.inf
    return out * np.outer(std, std)


COVARIANCES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "sample": sample_covariance,
    "shrinkage": shrinkage,
    "shrinkage_constant_correlation": lambda y: shrinkage(y, "constant_correlation"),
    "shrinkage_single_index": lambda y: shrinkage(y, "single_index"),
    "single_index": single_index,
    "rmt0": lambda y: rmt(y, False),
    "rmtm": lambda y: rmt(y, True),
    "upgma": lambda y: hierarchical(y, "upgma"),
    "wpgma": lambda y: hierarchical(y, "wpgma"),
    "hausdorff": lambda y: hierarchical(y, "hausdorff"),
}

# --- the harness ---


def nothing(*names: str) -> pd.DataFrame:
    """No rows, of columns that fit any type (an untyped empty column would be one of floats)."""
    return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})


def training_sets(universe: Node, features: Node, target: Node, *, target_offset: int, max_periods: int | None, refit_every: int = 1) -> DataFrame:
    """Rows (uts, fit_ts, role, tick, entity, features..., y) for each universe tick uts.

    role 'fit': features of tick i with the target of tick i + target_offset, both at or before the universe tick the
    model was last refitted at (fit_ts), the last max_periods of them; role 'now': the latest features. One range join
    of universe ticks with tick numbers; both sides have one row for each tick.
    """
    from pyspark.sql import Window

    (e,) = features.entity
    ticks = features.df.select(F.col(features.ts).alias("t")).distinct()
    ticks = ticks.withColumn("i", F.row_number().over(Window.orderBy("t")))
    rounds = universe.df.select(F.col(universe.ts).alias("uts")).distinct().withColumn("r", F.row_number().over(Window.orderBy("uts")) - 1)
    fits = F.max(F.when(F.col("r") % refit_every == 0, F.col("uts"))).over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    rounds = rounds.withColumn("fit_ts", fits)
    last = lambda c: F.max(F.when(F.col("t") <= F.col(c), F.col("i")))
    known = rounds.join(F.broadcast(ticks), F.col("t") <= F.col("uts"), "left").groupBy("uts", "fit_ts").agg(last("fit_ts").alias("n"), last("uts").alias("n_now"))
    x = features.df.join(ticks, F.col(features.ts) == F.col("t")).select("i", e, *features.values)
    y = target.df.join(ticks, F.col(target.ts) == F.col("t")).select((F.col("i") - target_offset).alias("i"), e, F.col(target.v).alias("y"))
    pairs = x.join(y, ["i", e], "left")
    first = F.lit(0) if max_periods is None else F.col("n") - target_offset - max_periods
    fit = pairs.join(F.broadcast(known), (F.col("i") <= F.col("n") - target_offset) & (F.col("i") > first)).select("uts", "fit_ts", F.lit("fit").alias("role"), "i", e, *features.values, "y")
    now = x.join(F.broadcast(known.select("uts", "fit_ts", F.col("n_now").alias("i"))), "i").select("uts", "fit_ts", F.lit("now").alias("role"), "i", e, *features.values, F.lit(None).cast("double").alias("y"))
    member = universe.df.where(F.col(universe.v) > 0).select(F.col(universe.ts).alias("uts"), e)
    return fit.unionByName(now).join(member, ["uts", e])


def _masked(pdf: pd.DataFrame, e: str, names: list[str], min_periods: int | None):
    """(entities in the mask, x, y, latest features): stocks with enough pairs and finite latest features."""
    fit, now = pdf[pdf.role == "fit"], pdf[pdf.role == "now"].set_index(e)[names]
    now = now[np.isfinite(now.to_numpy(float)).all(axis=1)]
    if min_periods:
        good = fit[np.isfinite(fit["y"].to_numpy(float)) & np.isfinite(fit[names].to_numpy(float)).all(axis=1)]
        counts = good.groupby(e).size()
        now = now[[counts.get(i, 0) >= min_periods for i in now.index]]
    stocks = sorted(now.index)
    steps = sorted(fit["i"].unique())
    wide = [fit.pivot(index="i", columns=e, values=c).reindex(index=steps, columns=stocks).to_numpy(float) for c in [*names, "y"]]
    return stocks, np.stack(wide[:-1], axis=2) if steps else np.zeros((0, len(stocks), len(names))), wide[-1], now.loc[stocks].to_numpy(float)


def predict_mean(universe: Node, features: Node, target: Node, fit=fit_ols, predict=predict_ols, *, target_offset: int = 1, max_periods: int | None = None, min_periods: int | None = None, refit_every: int = 1) -> Node:
    """A prediction for each stock of the universe at each universe tick; ticks are solved apart, in parallel."""
    (e,) = features.entity
    sets = training_sets(universe, features, target, target_offset=target_offset, max_periods=max_periods, refit_every=refit_every)
    names, kinds = list(features.values), dict(sets.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stocks, x, y, now = _masked(pdf, e, names, min_periods)
        if not stocks:
            return nothing("ts", e, "v")
        return pd.DataFrame({"ts": [pdf["uts"].iloc[0]] * len(stocks), e: stocks, "v": predict(fit(x, y), now)})

    out = sets.groupBy("uts").applyInPandas(run, f"ts {kinds['uts']}, {e} {kinds[e]}, v double")
    return Node(out, "ts", (e,), ("v",))


def predict_sample_mean(universe: Node, features: Node, target: Node, **kwargs) -> Node:
    return predict_mean(universe, features, target, fit_mean, lambda m, now: m, **kwargs)


def single_feature(universe: Node, features: Node, index: int = 0) -> Node:
    """One feature's latest value, for the stocks of the universe whose features are all finite."""
    from tickloom.functions import ieee
    from tickloom.plans.align import asof_join

    (e,) = features.entity
    x = features.values[index]
    df = asof_join(universe.renamed("_u"), features).where("_u > 0")
    for c in features.values:
        df = df.where(F.col(c).isNotNull() & ieee.finite(c))
    return Node(df.select(e, universe.ts, F.col(x).alias("v")), universe.ts, (e,))


def predict_covariance(universe: Node, features: Node, target: Node, estimator: str = "sample", *, target_offset: int = 1, max_periods: int | None = None, min_periods: int | None = None, refit_every: int = 1) -> Node:
    """Covariances of the stocks of the universe at each universe tick, long: ts, i, j, cov."""
    (e,) = features.entity
    sets = training_sets(universe, features, target, target_offset=target_offset, max_periods=max_periods, refit_every=refit_every)
    names, kinds, kernel = list(features.values), dict(sets.dtypes), COVARIANCES[estimator]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stocks, _, y, _ = _masked(pdf, e, names, min_periods)
        if not stocks:
            return nothing("ts", "i", "j", "cov")
        cov = kernel(y)
        n = len(stocks)
        return pd.DataFrame({"ts": [pdf["uts"].iloc[0]] * n * n, "i": [i for i in stocks for _ in stocks], "j": stocks * n, "cov": cov.ravel()})

    out = sets.groupBy("uts").applyInPandas(run, f"ts {kinds['uts']}, i {kinds[e]}, j {kinds[e]}, cov double")
    return Node(out, "ts", ("i", "j"), ("cov",), float("nan"))


def ols_by_gram(df: DataFrame, group: str, features: list[str], y: str) -> DataFrame:
    """Expanding pooled OLS: at each value of group, coefficients from all rows up to it: (group, n, beta).

    Products are summed for each group in the JVM and accumulated over groups, so nothing is read twice; only the
    small systems are solved in Python.
    """
    from pyspark.sql import Window

    cols = [*[F.col(c).cast("double") for c in features], F.lit(1.0), F.col(y).cast("double")]
    k = len(cols)
    sums = [F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    run = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, 0)
    grams = df.groupBy(group).agg(*sums)
    names = [c for c in grams.columns if c != group]
    grams = grams.select(group, *[F.sum(c).over(run).alias(c) for c in names])
    kind = dict(grams.dtypes)[group]

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                g = np.zeros((k, k))
                for c in names:
                    i, j = map(int, c[1:].split("_"))
                    g[i, j] = g[j, i] = getattr(r, c)
                out.append((getattr(r, group), int(g[-2, -2]), np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0].tolist()))
            yield pd.DataFrame(out, columns=[group, "n", "beta"])

    return grams.mapInPandas(solve, f"{group} {kind}, n long, beta array<double>")
