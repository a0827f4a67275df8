"""Composing lazy nodes by name; running is a Spark action."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans.node import Node


class Engine:
    """Sources and operators under names, in order; nothing runs before a result is asked for."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.nodes = spark, {}

    def add_source(self, name: str, node: Node) -> Node:
        if name in self.nodes:
            raise ValueError(f"there is a node {name}")
        self.nodes[name] = node
        return node

    def add_operator(self, name: str, operator: Callable[..., Node], *inputs: str, **params) -> Node:
        """Inputs must exist, so graphs can't have cycles."""
        return self.add_source(name, operator(*[self.nodes[i] for i in inputs], **params))

    def share(self, name: str) -> Node:
        """Keep a node that several results read."""
        node = self.nodes[name]
        self.nodes[name] = node.with_df(node.df.persist())
        return self.nodes[name]

    def series(self, name: str) -> DataFrame:
        return self.nodes[name].history()

    def array(self, name: str) -> DataFrame:
        return self.nodes[name].latest()

    def run(self, *names: str, on_flush: Callable[[str, int], None] | None = None) -> dict[str, int]:
        """Evaluates the named nodes (all by default); rows of each. on_flush hears of each as it is done."""
        out = {}
        for name in names or self.nodes:
            out[name] = self.nodes[name].df.count()
            if on_flush:
                on_flush(name, out[name])
        return out
