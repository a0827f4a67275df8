"""Metrics of portfolio values since inception, of trading activity, and of predictions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import ieee
from tickloom.operators.predictors import nothing
from tickloom.plans.align import densify, resample
from tickloom.plans.node import Node

NAN = float("nan")


def _returns(node: Node, clock: DataFrame | None) -> Node:
    """Rows at clock ticks with a number, and their returns r (null where the previous value isn't positive)."""
    node = node if clock is None else resample(clock, node)
    node = node.with_df(node.df.where(~F.isnan(node.v)))
    prev = F.lag(node.v).over(node.over_time())
    return node.with_df(node.df.withColumn("_r", F.when(prev > 0, F.col(node.v) / prev - 1)))


def _upto(node: Node):
    return node.over_time().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def compound_return(node: Node, clock: DataFrame | None = None) -> Node:
    node = _returns(node, clock)
    first, n = F.first(node.v).over(_upto(node)), F.row_number().over(node.over_time())
    grown = F.pow(F.col(node.v) / first, 1 / F.greatest(n - 1, F.lit(1))) - 1
    value = F.when((first <= 0) | (F.col(node.v) <= 0), ieee.nan()).when(n == 1, 0.0).otherwise(grown)
    return node.derive(value, NAN)


def average_return(node: Node, clock: DataFrame | None = None) -> Node:
    node = _returns(node, clock)
    return node.derive(F.coalesce(F.avg("_r").over(_upto(node)), ieee.nan()), NAN)


def volatility(node: Node, clock: DataFrame | None = None) -> Node:
    node = _returns(node, clock)
    return node.derive(F.coalesce(F.stddev_pop("_r").over(_upto(node)), ieee.nan()), NAN)


def sharpe_ratio(node: Node, clock: DataFrame | None = None) -> Node:
    """Mean over population deviation of returns; NaN where they don't vary (beyond rounding)."""
    node = _returns(node, clock)
    mean, std = F.avg("_r").over(_upto(node)), F.stddev_pop("_r").over(_upto(node))
    return node.derive(F.coalesce(F.when(std > 1e-12, mean / std), ieee.nan()), NAN)


def drawdown(node: Node) -> Node:
    node = node.with_df(node.df.where(~F.isnan(node.v)))
    top = F.max(node.v).over(_upto(node))
    return node.derive(F.when(top <= 0, 0.0).otherwise((F.col(node.v) - top) / top), 0.0)


def turnover(weights: Node) -> Node:
    """Sum over entities of |change of weight|, what isn't finite counting 0; nothing at the first tick."""
    dense = densify(weights)
    change = F.abs(F.col(dense.v) - F.lag(dense.v).over(dense.over_time()))
    df = dense.df.withColumn("_c", F.when(ieee.finite(change), change).otherwise(F.when(change.isNotNull(), 0.0)))
    out = df.groupBy(dense.ts).agg(F.sum("_c").alias("v")).where("v is not null")
    return Node(out, weights.ts, ())


def periods(predictions: Node, target: Node) -> DataFrame:
    """Target ticks with the prediction tick strictly before them (pts) and the next one (until), which closes them."""
    spec = Window.orderBy("pts")
    ticks = predictions.df.select(F.col(predictions.ts).alias("pts")).distinct().withColumn("until", F.lead("pts").over(spec))
    marks = ticks.select(F.col("pts").alias("t"), F.struct("pts", "until").alias("p"), F.lit(1).alias("o"))
    rows = target.df.select(F.col(target.ts).alias("t")).distinct().withColumn("p", F.lit(None).cast(marks.schema["p"].dataType)).withColumn("o", F.lit(0))
    both = marks.unionByName(rows).withColumn("q", F.last("p", True).over(Window.orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)))
    return both.where("o = 0 and q is not null").select("t", "q.*").where("until is not null")


def information_coefficient(predictions: Node, target: Node) -> Node:
    """At each prediction tick but the first: mean over the target ticks since the last one of the Pearson correlation."""
    (e,) = target.entity
    when = F.broadcast(periods(predictions, target))
    y = target.df.select(F.col(target.ts).alias("t"), e, F.col(target.v).alias("y")).join(when, "t")
    x = predictions.df.select(F.col(predictions.ts).alias("pts"), e, F.col(predictions.v).alias("x"))
    both = y.join(x, ["pts", e], "left")
    good = ieee.finite("x") & ieee.finite("y") & F.col("x").isNotNull()
    px, py = F.when(good, F.col("x")), F.when(good, F.col("y"))
    # below two pairs a day counts 0; no variation gives NaN
    daily = both.groupBy("until", "t").agg(F.count(px).alias("n"), F.corr(px, py).alias("c"), F.stddev_pop(px).alias("sx"), F.stddev_pop(py).alias("sy"))
    ic = F.when(F.col("n") < 2, 0.0).when((F.col("sx") == 0) | (F.col("sy") == 0), ieee.nan()).otherwise(F.col("c"))
    out = daily.groupBy("until").agg(F.avg(ic).alias("v"))
    ends = predictions.df.select(F.col(predictions.ts).alias("until")).distinct()
    ends = ends.withColumn("_n", F.row_number().over(Window.orderBy("until"))).where("_n > 1").select("until")
    out = ends.join(out, "until", "left").select(F.col("until").alias(predictions.ts), F.coalesce("v", F.lit(0.0)).alias("v"))
    return Node(out, predictions.ts, ())


def _matrix(pdf: pd.DataFrame) -> tuple[list, np.ndarray]:
    m = pdf.pivot(index="i", columns="j", values="cov")
    names = sorted(set(m.index) | set(m.columns))
    m = m.reindex(index=names, columns=names)
    good = [n for n in names if np.isfinite(m.loc[n, n])]
    return good, m.loc[good, good].to_numpy()


def log_likelihood_kernel(cov: np.ndarray, returns: np.ndarray) -> float:
    """log pseudo-determinant + mean of r' pinv r; rows of returns are ticks, NaN counts 0."""
    u, s, vt = np.linalg.svd(cov)
    keep = s > max(cov.shape) * np.finfo(float).eps * (s[0] if len(s) else 0.0)
    inverse = (vt[keep].T / s[keep]) @ u[:, keep].T
    r = np.where(np.isfinite(returns), returns, 0.0)
    fit = float(np.mean(np.einsum("ti,ij,tj->t", r, inverse, r))) if len(r) else 0.0
    return float(np.log(s[keep]).sum()) + fit


def minimum_variance_kernel(cov: np.ndarray, returns: np.ndarray) -> float:
    """Population variance of the returns of the global minimum-variance weights; log inputs are made linear."""
    if not len(returns) or not len(cov):
        return 0.0
    d = np.diag(cov) / 2
    level = np.exp(d)
    linear = np.outer(level, level) * np.expm1(cov)
    w = np.linalg.pinv(linear) @ np.ones(len(cov))
    w = w / w.sum()
    r = np.expm1(np.where(np.isfinite(returns), returns, 0.0))
    return float(np.var(r @ w))


def _by_period(predictions: Node, target: Node, kernel) -> Node:
    """kernel(covariance, returns) for each prediction tick that is followed by another, at that other tick."""
    (e,) = target.entity
    when = F.broadcast(periods(predictions, target))
    returns = target.df.select(F.col(target.ts).alias("t"), F.col(e).alias("i"), F.col(target.v).alias("y")).join(when, "t").drop("until")
    ticks = predictions.df.select(F.col(predictions.ts).alias("pts")).distinct().withColumn("until", F.lead("pts").over(Window.orderBy("pts"))).where("until is not null")
    cov = predictions.df.select(F.col(predictions.ts).alias("pts"), "i", "j", F.col(predictions.v).alias("cov")).join(F.broadcast(ticks), "pts")
    kind = dict(cov.dtypes)["until"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return nothing("until", "v")
        names, m = _matrix(left)
        r = right.pivot(index="t", columns="i", values="y").reindex(columns=names).to_numpy() if len(right) else np.zeros((0, len(names)))
        return pd.DataFrame({"until": [left["until"].iloc[0]], "v": [kernel(m, r)]})

    out = cov.groupBy("pts").cogroup(returns.groupBy("pts")).applyInPandas(run, f"until {kind}, v double")
    return Node(out.select(F.col("until").alias(predictions.ts), "v"), predictions.ts, ())


def log_likelihood(predictions: Node, target: Node) -> Node:
    return _by_period(predictions, target, log_likelihood_kernel)


def minimum_variance_metric(predictions: Node, target: Node) -> Node:
    return _by_period(predictions, target, minimum_variance_kernel)
