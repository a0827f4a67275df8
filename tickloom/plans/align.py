"""Aligning tick tables in time: coalescing, latest-value merge, as-of reads, resampling, stacking. No joins where a union and a window do."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.plans.node import Node


def coalesce_ticks(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the last written by `order`."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_s")).select(*keys, "_s.*")


def _merged(nodes: list[Node], by_time_only: set[int] = frozenset()) -> tuple[DataFrame, list[str]]:
    """The union of all ticks with one struct a_i for each node, null where it did not tick."""
    first = nodes[0]
    names = [f"a_{i}" for i in range(len(nodes))]
    parts = []
    for i, node in enumerate(nodes):
        if node.entity != first.entity:
            raise ValueError("nodes differ in their entity columns")
        own = F.struct(*node.values).alias(names[i])
        parts.append(node.df.select(*first.entity, F.col(node.ts).alias(first.ts), own))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.groupBy(*first.entity, first.ts).agg(*[F.max(n).alias(n) for n in names]), names


def merge_latest(*nodes: Node, ticks: str = "any", strict: bool = False) -> DataFrame:
    """The latest values of all nodes at every tick of any of them (or of the i-th: ticks=str(i)).

    Columns: entity, ts, then for node i its values as <value>_i (or the value's own name, where names are distinct)
    and ticked_i. Before its first tick a node reads as its init (null stays null if init is None). strict reads
    nodes other than the ticking one strictly before the tick. One shuffle by entity.
    """
    df, names = _merged(list(nodes))
    first = nodes[0]
    spec = Window.partitionBy(*first.entity).orderBy(first.ts)
    upto = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = spec.rowsBetween(Window.unboundedPreceding, -1)
    distinct = len({v for n in nodes for v in n.values}) == sum(len(n.values) for n in nodes)
    cols: list[Column] = []
    for i, (node, name) in enumerate(zip(nodes, names, strict=True)):
        frame = before if strict and ticks != str(i) else upto
        read = F.last(name, ignorenulls=True).over(frame)
        for v in node.values:
            value = read[v]
            if node.init is not None:
                value = F.when(read.isNull(), F.lit(node.init)).otherwise(value)
            cols.append(value.alias(v if distinct else f"{v}_{i}"))
        cols.append(F.col(name).isNotNull().alias(f"ticked_{i}"))
    out = df.select(*first.entity, first.ts, *cols)
    return out if ticks == "any" else out.where(f"ticked_{ticks}")


def asof_join(left: Node, right: Node, strict: bool = False) -> DataFrame:
    """Every tick of left with right's latest values at or before it (strictly before it); null where there are none."""
    return merge_latest(left, replace(right, init=None), ticks="0", strict=strict).drop("ticked_0", "ticked_1")


def on_all(df: DataFrame, ts: str, node: Node) -> DataFrame:
    """The grid of ticks of df with each entity of node: for clocks, which have no entity."""
    entities = node.df.select(*node.entity).distinct()
    return df.select(ts).distinct().crossJoin(F.broadcast(entities)) if node.entity else df.select(ts).distinct()


def _on_clock(clock: DataFrame, node: Node) -> DataFrame:
    """node's latest values at each tick (node.ts) of a clock for each of its entities, and ticked_1.

    The clock's ticks are spread over the entities as an array on a table of entities, so no row of data is repeated.
    """
    if node.entity:
        all_ticks = clock.agg(F.collect_list(node.ts).alias("_t"))  # a clock: bounded by calendar time
        grid = node.df.select(*node.entity).distinct().join(F.broadcast(all_ticks)).select(*node.entity, F.explode("_t").alias(node.ts))
    else:
        grid = clock
    grid = Node(grid.withColumn("_tick", F.lit(True)), node.ts, node.entity, ("_tick",), None)
    return merge_latest(grid, node, ticks="0")


def resample(clock: DataFrame, node: Node, clock_ts: str = "ts") -> Node:
    """node's latest value at each tick of a clock; before the first tick it reads as init."""
    out = _on_clock(clock.select(F.col(clock_ts).alias(node.ts)).distinct(), node)
    return node.with_df(out.select(*node.keys, *node.values))


def at_ticks(clock: Node, node: Node) -> Node:
    """Semi-join: the rows of node at the clock's ticks."""
    keys = [k for k in clock.keys if k in node.keys]
    return node.with_df(node.df.join(clock.df.select(*keys).distinct(), keys, "left_semi"))


def concat(nodes: list[Node], axis: str, sizes: list[int] | None = None, sync: bool = False) -> Node:
    """Nodes end to end along `axis`, one of their entity columns; they may differ in length there.

    With sizes the axis counts from 0 in each node, and a node's entries come after those of the nodes before it, so many
    as sizes says. Without, entries are named: no two nodes may have the same. At every tick of any node all entries tick:
    with their latest values (init before their first), or, if sync, NaN where they did not tick.
    """
    first = nodes[0]
    if axis not in first.entity:
        raise ValueError(f"no entity column {axis}; stack() makes a new one")
    if any((n.entity, n.values) != (first.entity, first.values) for n in nodes):
        raise ValueError("nodes differ in their entity columns or values")
    if sizes is not None and len(sizes) != len(nodes):
        raise ValueError("sizes has one number for each node")
    clock = reduce(DataFrame.union, [n.df.select(F.col(n.ts).alias(first.ts)) for n in nodes]).distinct()
    parts = []
    for i, n in enumerate(nodes):
        df = n.df.select(*first.entity, F.col(n.ts).alias(first.ts), *n.values)
        if sizes is not None:
            df = df.withColumn(axis, F.col(axis) + sum(sizes[:i]))
        parts.append(_on_clock(clock, n.with_df(df, ts=first.ts)))
    read = [F.when(F.col("ticked_1"), F.col(v)).otherwise(F.lit(float("nan"))).alias(v) if sync else F.col(v) for v in first.values]
    out = reduce(DataFrame.union, [p.select(*first.keys, *read) for p in parts])
    return first.with_df(out, init=float("nan") if sync else first.init)


def concat_sync(nodes: list[Node], axis: str, sizes: list[int] | None = None) -> Node:
    return concat(nodes, axis, sizes, sync=True)


def stack(nodes: list[Node], axis: str = "i", sync: bool = False) -> Node:
    """Nodes side by side along `axis`, a new entity column numbering the input.

    At every tick of any input: the latest value of each (init before its first), or, if sync, the values of those
    that ticked and NaN for the others. Ticks are per entity of the inputs.
    """
    names = [f"x{i}" for i in range(len(nodes))]
    same = [n.renamed(name) for n, name in zip(nodes, names, strict=True)]
    df = merge_latest(*same)
    entries = [F.struct(F.lit(i).alias(axis), (F.when(F.col(f"ticked_{i}"), F.col(n)).otherwise(F.lit(float("nan"))) if sync else F.col(n)).alias("v")) for i, n in enumerate(names)]
    first = nodes[0]
    out = df.select(*first.keys, F.explode(F.array(*entries)).alias("_e")).select(*first.entity, F.col("_e")[axis].alias(axis), first.ts, F.col("_e.v").alias("v"))
    return Node(out, first.ts, (*first.entity, axis), ("v",), float("nan") if sync else 0.0)


def stack_sync(nodes: list[Node], axis: str = "i") -> Node:
    return stack(nodes, axis, sync=True)


def densify(node: Node, fill: float = float("nan")) -> Node:
    """The node on the grid of all its ticks with all its entities, fill where there was no row.

    Lags and windows count the node's ticks, not an entity's rows; a sparse table is made dense before them.
    """
    entities = node.df.select(*node.entity).distinct()
    ticks = node.df.select(node.ts).distinct().withColumn("_k", F.lit(1))
    grid = ticks.join(entities.withColumn("_k", F.lit(1)), "_k").drop("_k")
    out = grid.join(node.df, [*node.entity, node.ts], "left")
    return node.with_df(out.select(*node.keys, *[F.coalesce(c, F.lit(fill)).alias(c) for c in node.values]))
