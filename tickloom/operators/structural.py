"""Projection, predicates, reshaping and user functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import ieee
from tickloom.plans.align import at_ticks, concat, densify, merge_latest, resample, stack, stack_sync
from tickloom.plans.node import Node

__all__ = ["at_ticks", "concat", "densify", "merge_latest", "resample", "stack", "stack_sync"]


def const(spark: SparkSession, value: float) -> Node:
    """A constant never ticks: an empty table whose init is the value."""
    return Node(spark.createDataFrame([], "ts timestamp, v double"), init=float(value))


def identity(node: Node) -> Node:
    return node


def record(node: Node) -> Node:
    """A batch table is its whole history."""
    return node.with_df(node.df, kind="series")


def last(node: Node, fill: float = 0.0) -> Node:
    """A series' most recent value at each tick; fill before the first."""
    return node.with_df(node.df, kind="array", init=fill)


def map_columns(node: Node, f: Callable[[Column], Column], init: float | None = None) -> Node:
    """f as a Column expression over the value."""
    return node.derive(f(F.col(node.v)), node.init if init is None else init)


def map_ticks(node: Node, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f over the whole cross-section of each tick, Arrow-batched; an empty result suppresses the tick."""
    return node.df.groupBy(node.ts).applyInPandas(f, schema)


def apply_columns(nodes: list[Node], f: Callable[..., Column]) -> Node:
    """f over the latest values of several nodes, on the union of their ticks."""
    names = [f"x{i}" for i in range(len(nodes))]
    df = merge_latest(*[n.renamed(x) for n, x in zip(nodes, names, strict=True)])
    first = nodes[0]
    return Node(df.select(*first.keys, f(*map(F.col, names)).alias("v")), first.ts, first.entity)


def unary(node: Node, op: str) -> Node:
    return node.derive(ieee.UNARY[op](F.col(node.v)))


def binary(a: Node, b: Node, op: str) -> Node:
    """a and b at their latest values on any tick of either; shapes must agree."""
    return apply_columns([a, b], ieee.BINARY[op])


def filter_ticks(node: Node, predicate: Column) -> Node:
    """Keep whole ticks: predicate is an aggregate over the tick's rows, or over its one row."""
    if not node.entity:
        return node.with_df(node.df.where(predicate))
    keep = node.df.groupBy(node.ts).agg(predicate.alias("_keep")).where("_keep").select(node.ts)
    return node.with_df(node.df.join(keep, node.ts, "left_semi"))


def where(node: Node, condition: Column, fill: float = 0.0) -> Node:
    return node.derive(F.when(condition, F.col(node.v)).otherwise(F.lit(fill)), node.init)


def cast(node: Node, to: str) -> Node:
    return node.derive(ieee.saturating_cast(F.col(node.v), to, dict(node.df.dtypes)[node.v]), node.init)


def select_columns(node: Node, *names: str) -> Node:
    return Node(node.df.select(*node.keys, *names), node.ts, node.entity, names, 0.0, node.kind)


def select_entities(node: Node, axis: str, labels: list) -> Node:
    """Labels along an entity axis; a single label leaves the axis out."""
    df = node.df.where(F.col(axis).isin(*labels))
    if len(labels) > 1:
        return node.with_df(df)
    rest = tuple(e for e in node.entity if e != axis)
    return Node(df.select(*rest, node.ts, *node.values), node.ts, rest, node.values, 0.0, node.kind)


def lag(node: Node, offset: int = 1, fill: float = 0.0) -> Node:
    return node.derive(F.lag(node.v, offset, fill).over(node.over_time()), fill)


def clocked(clock: DataFrame, inputs: list[Node], inner: Callable[..., Node]) -> Node:
    """inner over inputs read at the clock's ticks only."""
    return inner(*[resample(clock, n) for n in inputs])
