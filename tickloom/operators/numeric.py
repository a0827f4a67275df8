"""Cross-tick and cross-sectional numeric operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import ieee
from tickloom.plans.node import Node

NAN = float("nan")


def power(node: Node, n: float) -> Node:
    return node.derive(ieee.power(node.v, n))


def clamp(node: Node, lo: float, hi: float) -> Node:
    return node.derive(ieee.clamp(node.v, lo, hi))


def fillna(node: Node, value: float) -> Node:
    return node.derive(ieee.fillna(node.v, value))


def forward_fill(node: Node) -> Node:
    """Last value that is a number, per entity; NaN before the first."""
    upto = node.over_time().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return node.derive(F.coalesce(F.last(ieee.nn(node.v), True).over(upto), ieee.nan()), NAN)


def diff(node: Node) -> Node:
    return node.derive(F.col(node.v) - F.lag(node.v, 1, NAN).over(node.over_time()), NAN)


def pct_change(node: Node) -> Node:
    return node.derive(ieee.divide(F.col(node.v), F.lag(node.v, 1, NAN).over(node.over_time())) - 1, NAN)


def percentile(node: Node) -> Node:
    """(rank - 0.5) / valid across entities at each tick; ties in order of entity; NaN stays."""
    valid = ieee.nn(node.v)
    rank = F.row_number().over(node.across().orderBy(valid.asc_nulls_last(), *node.entity))
    return node.derive(F.when(F.isnan(node.v), ieee.nan()).otherwise((rank - 0.5) / F.count(valid).over(node.across())))


def gaussianize(node: Node) -> Node:
    p = percentile(node)
    return p.derive(F.when(F.isnan(p.v), ieee.nan()).otherwise(ieee.normal_quantile(p.v)))


def winsorize(node: Node, p: float = 0.01) -> Node:
    """Clip to the k-th smallest and largest valid values of the tick, k = floor(p * valid)."""
    if not 0 <= p < 0.5:
        raise ValueError("p must be in [0, 0.5)")
    valid = ieee.nn(node.v)
    n = F.count(valid).over(node.across())
    rank = F.row_number().over(node.across().orderBy(valid.asc_nulls_last(), *node.entity))
    df = node.df.withColumn("_n", n).withColumn("_r", rank).withColumn("_k", F.floor(F.col("_n") * p))
    low = F.max(F.when(F.col("_r") == F.col("_k") + 1, F.col(node.v))).over(node.across())
    high = F.max(F.when(F.col("_r") == F.col("_n") - F.col("_k"), F.col(node.v))).over(node.across())
    df = df.withColumn("_lo", low).withColumn("_hi", high)
    clipped = F.when(F.isnan(node.v), ieee.nan()).otherwise(F.greatest(F.col("_lo"), F.least(F.col("_hi"), F.col(node.v))))
    return node.with_df(df).derive(clipped)


def top_k_weights(node: Node, k: int) -> Node:
    """Weights of the k largest values of each tick in proportion to the value; zero for the rest."""
    valid = ieee.nn(node.v)
    rank = F.row_number().over(node.across().orderBy(valid.desc_nulls_last(), *node.entity))
    df = node.df.withColumn("_top", F.when((rank <= k) & valid.isNotNull(), F.col(node.v)))
    return node.with_df(df).derive(F.coalesce(F.col("_top") / F.sum("_top").over(node.across()), F.lit(0.0)))


def total(node: Node) -> Node:
    """Sum over entities at each tick, NaN skipped."""
    df = node.df.groupBy(node.ts).agg(F.coalesce(F.sum(ieee.nn(node.v)), F.lit(0.0)).alias(node.v))
    return Node(df, node.ts, (), (node.v,))
