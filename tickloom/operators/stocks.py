"""Corporate actions and year-to-date reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import ieee
from tickloom.plans.align import merge_latest
from tickloom.plans.node import Node

NAN = float("nan")


def forward_adjust(close: Node, dividends: Node, output_prices: bool = True) -> Node:
    """Prices times the running factor of dividends (values share, cash), on price ticks.

    A dividend multiplies the factor by (1 + cash / (previous - cash)) * (1 + share), previous being the last price
    strictly before it; a NaN or absent previous price skips the dividend. A previous price not above the cash
    dividend raises.
    """
    share, cash = dividends.values
    df = merge_latest(close.renamed("price").with_df(close.renamed("price").df, init=None), Node(dividends.df, dividends.ts, dividends.entity, (share, cash), None))
    spec = Window.partitionBy(*close.entity).orderBy(close.ts)
    df = df.withColumn("_p", F.when(F.col("ticked_0"), F.struct("price")))
    df = df.withColumn("_prev", F.last("_p", True).over(spec.rowsBetween(Window.unboundedPreceding, -1))["price"])
    usable = F.col("ticked_1") & F.col("_prev").isNotNull() & ~F.isnan("_prev")
    safe = F.when(F.col("_prev") > F.col(cash), F.col("_prev") - F.col(cash)).otherwise(F.raise_error(F.lit("a cash dividend isn't below the previous price")).cast("double"))
    m = F.when(usable, (1 + F.col(cash) / safe) * (1 + F.col(share))).otherwise(F.lit(1.0))
    df = df.withColumn("_f", F.product(m).over(spec.rowsBetween(Window.unboundedPreceding, 0))).where("ticked_0")
    value = F.col("price") * F.col("_f") if output_prices else F.col("_f")
    return Node(df.select(*close.keys, value.alias("v")), close.ts, close.entity, ("v",), 0.0 if output_prices else 1.0)


def annualize(source: Node) -> Node:
    """Year-to-date values (columns year, day, ytd...) to yearly rates: differences inside a year, by days."""
    year, day, *ytd = source.values
    spec = source.over_time()
    same = F.lag(year).over(spec) == F.col(year)
    days = F.col(day) - F.when(same, F.lag(day).over(spec)).otherwise(0)
    rate = lambda c: F.when(days <= 0, ieee.nan()).otherwise((F.col(c) - F.when(same, F.lag(c).over(spec)).otherwise(0)) * 365 / days)
    df = source.df.select(*source.keys, *[rate(c).alias(c) for c in ytd])
    return Node(df, source.ts, source.entity, tuple(ytd), 0.0)
