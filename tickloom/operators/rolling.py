"""Rolling windows by count (only when full) or by time; any value in the window that isn't finite makes it NaN."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions import ieee
from tickloom.plans.node import Node

NAN = float("nan")


def _micros(node: Node) -> Column:
    kind = dict(node.df.dtypes)[node.ts]
    if kind.startswith("timestamp"):
        return F.expr(f"timestampdiff(MICROSECOND, cast(timestamp_ntz'1970-01-01 00:00:00' as {kind}), {node.ts})")
    return F.col(node.ts).cast("long")


def _frame(node: Node, window: int | timedelta, partition: tuple[str, ...]) -> tuple[Node, WindowSpec, Column | None]:
    """(node, frame, full): count windows have the flag that they are full; time windows emit from the first row."""
    from pyspark.sql import Window

    if isinstance(window, timedelta):
        if window < timedelta(0):
            raise ValueError("a window's duration can't be negative")
        # an integer time column is in the units of the window's microseconds
        df = node.df.withColumn("_us", _micros(node))
        return node.with_df(df), Window.partitionBy(*partition).orderBy("_us").rangeBetween(-round(window / timedelta(microseconds=1)), 0), None
    if window <= 0:
        raise ValueError("a window's count must be positive")
    spec = Window.partitionBy(*partition).orderBy(node.ts)
    df = node.df.withColumn("_full", F.row_number().over(spec) >= window)
    return node.with_df(df), spec.rowsBetween(1 - window, 0), F.col("_full")


def rolling(node: Node, window: int | timedelta, aggregate: Callable[[Column], Column]) -> Node:
    """Any aggregate Column function over the window: the extension point for window aggregates."""
    node, frame, full = _frame(node, window, node.entity)
    x = F.col(node.v)
    good = F.when(ieee.finite(x), x)
    value = F.when(F.count(good).over(frame) < F.count(F.lit(1)).over(frame), ieee.nan()).otherwise(aggregate(good).over(frame))
    df = node.df.select(*node.keys, value.alias(node.v), *([full.alias("_full")] if full is not None else []))
    if full is not None:
        df = df.where("_full").drop("_full")
    return replace(node, df=df, values=(node.v,), init=NAN)


def rolling_sum(node: Node, window) -> Node:
    return rolling(node, window, F.sum)


def rolling_mean(node: Node, window) -> Node:
    return rolling(node, window, F.avg)


def rolling_variance(node: Node, window) -> Node:
    """Population variance."""
    return rolling(node, window, F.var_pop)


def rolling_sum_prefix(node: Node, window: int) -> Node:
    """rolling_sum by differences of running sums: O(1) a row however long the window is; for values of like size."""
    from pyspark.sql import Window

    spec = node.over_time()
    good = F.when(ieee.finite(node.v), F.col(node.v)).otherwise(F.lit(0.0))
    bad = F.when(ieee.finite(node.v), 0).otherwise(1)
    run = spec.rowsBetween(Window.unboundedPreceding, 0)
    df = node.df.withColumn("_s", F.sum(good).over(run)).withColumn("_b", F.sum(bad).over(run)).withColumn("_n", F.row_number().over(spec))
    part = lambda c, zero: F.col(c) - F.coalesce(F.lag(c, window).over(spec), F.lit(zero))
    df = df.withColumn("_v", F.when(part("_b", 0) > 0, ieee.nan()).otherwise(part("_s", 0.0))).where(F.col("_n") >= window)
    return replace(node, df=df.select(*node.keys, F.col("_v").alias(node.v)), init=NAN)


def rolling_covariance(node: Node, window, axis: str | None = None) -> Node:
    """Population covariance of every two entities of one axis, long: ts, i, j, cov (both triangles).

    Pairs are made at each tick from the entities present there, i <= j, and mirrored.
    """
    if len(node.entity) != 1:
        raise ValueError("covariance takes one entity axis")
    e = node.entity[0]
    a = node.df.select(node.ts, F.col(e).alias("i"), F.col(node.v).alias("x"))
    b = node.df.select(node.ts, F.col(e).alias("j"), F.col(node.v).alias("y"))
    pairs = Node(a.join(b, node.ts).where("i <= j"), node.ts, ("i", "j"), ("x", "y"), NAN)
    pairs, frame, full = _frame(pairs, window, ("i", "j"))
    good = ieee.finite("x") & ieee.finite("y")
    value = F.when(F.count(F.when(good, 1)).over(frame) < F.count(F.lit(1)).over(frame), ieee.nan()).otherwise(F.covar_pop("x", "y").over(frame))
    df = pairs.df.withColumn("cov", value)
    df = df.where(full) if full is not None else df
    half = df.select("i", "j", node.ts, "cov")
    both = half.unionByName(half.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), node.ts, "cov"))
    return Node(both, node.ts, ("i", "j"), ("cov",), NAN)


def ema(node: Node, window: int, *, alpha: float | None = None, span: float | None = None, half_life: float | None = None) -> Node:
    """Weighted mean of the last `window` ticks with weights alpha * (1 - alpha) ** age, when the window is full."""
    if sum(x is not None for x in (alpha, span, half_life)) != 1:
        raise ValueError("give exactly one of alpha, span, half_life")
    if span is not None:
        alpha = 2 / (span + 1)
    elif half_life is not None:
        alpha = 1 - math.exp(-math.log(2) / half_life)
    if not 0 < alpha <= 1 or window <= 0:
        raise ValueError("alpha must be in (0, 1] and window positive")
    node, frame, full = _frame(node, window, node.entity)
    x = F.col(node.v)
    good = F.when(ieee.finite(x), x)
    # oldest first: the mean is a fold acc -> acc * (1 - alpha) + alpha * x over the window, normalised once
    fold = F.aggregate(F.collect_list(good).over(frame), F.lit(0.0), lambda acc, v: acc * (1 - alpha) + v * alpha)
    norm = 1 - (1 - alpha) ** window
    value = F.when(F.count(good).over(frame) < window, ieee.nan()).otherwise(fold / norm)
    df = node.df.select(*node.keys, value.alias(node.v), full.alias("_full")).where("_full").drop("_full")
    return replace(node, df=df, init=NAN)
