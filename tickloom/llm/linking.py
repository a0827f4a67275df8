"""From bands to components: candidates, exact verification, union-find. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import components, drop_table, materialize

#: A row of a bucket: a function from names to columns.
Side = Callable[[str], Column]
#: Of two rows of a bucket: whether they may be alike.
Close = Callable[[Side, Side], Column]
#: Members of a bucket that one cell of its comparison holds, about.
CELL = 256


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (rep, items) have a Jaccard similarity of percent / 100 or more."""
    left = sets.select(F.col("rep").alias("b"), F.col("items").alias("b_items"))
    right = sets.select(F.col("rep").alias("a"), F.col("items").alias("a_items"))
    both = F.size(F.array_intersect("a_items", "b_items"))
    hit = 100 * both >= percent * (F.size("a_items") + F.size("b_items") - both)
    return pairs.join(left, "b").join(right, "a").where(hit).select("a", "b")


def bounds(sets: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """(rep, s, start, size) for the reps of rest (rep, c) that may be like one of another component.

    Two exact bounds on the similarity of a pair across components. What one component alone holds is in no such
    intersection: s counts the other items. And with all items in one order, rarest first, the starts of two sets
    decide what they share there; the rest of the set whose start ends earlier bounds what they share beyond.
    """
    inside = sets.join(rest.select("rep", "c").distinct(), "rep")
    items = inside.select("rep", "c", F.explode("items").alias("item"))
    known = items.groupBy("item").agg(F.count(F.lit(1)).alias("m"), (F.min("c") == F.max("c")).alias("own"))
    code = F.concat(F.lpad(F.hex("m"), 8, "0"), F.hex("item"))  # whole items, in order of their number
    found = items.join(known, "item").groupBy("rep").agg(F.count(F.lit(1)).alias("size"), F.sum(F.when(F.col("own"), 0).otherwise(1)).alias("s"), F.sort_array(F.collect_list(code)).alias("start"))
    return found.where(100 * F.col("s") >= percent * F.col("size")).withColumn("start", F.slice("start", 1, (F.col("size") * 2 / 5 + 8).cast("int")))


def _near(percent: int):
    """Whether the bounds of two sides allow a similarity of percent / 100."""
    enough = lambda i: 100 * i >= percent * (F.col("size") + F.col("size2") - i)
    beyond = F.when(F.element_at("start", -1) <= F.element_at("start2", -1), F.col("size") - F.size("start")).otherwise(F.col("size2") - F.size("start2"))
    return enough(F.least("s", "s2")) & enough(F.size(F.array_intersect("start", "start2")) + beyond)


def _cells() -> Column:
    return F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("g")


def _across(rest: DataFrame, close) -> DataFrame:
    """Distinct pairs (a, b) of one bucket and different components that are close.

    A bucket of m members is dealt into cells of about CELL x CELL of them, so no task compares a whole large bucket. rest
    may have their number on each side, g.
    """
    if "g" not in rest.columns:
        rest = rest.join(rest.groupBy("key").agg(_cells()), "key")
    dealt = rest.withColumn("at", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
    every = F.sequence(F.lit(0), F.col("g") - 1)
    x = dealt.withColumn("i", F.col("at")).withColumn("j", F.explode(every))
    y = dealt.withColumn("j", F.col("at")).withColumn("i", F.explode(every))
    y = y.select("key", "i", "j", *[F.col(k).alias(f"{k}2") for k in rest.columns if k not in ("key", "g")])
    met = x.join(y, ["key", "i", "j"]).where((F.col("rep") < F.col("rep2")) & (F.col("c") != F.col("c2")) & close)
    return met.select(F.col("rep").alias("a"), F.col("rep2").alias("b")).distinct()


def linked(band: DataFrame, close: Close, verify: Callable[[DataFrame], DataFrame] | None = None, sets_of: Callable[[DataFrame], DataFrame] | None = None, percent: int = 80, attach: Callable[[DataFrame], DataFrame] | None = None, narrow: Callable[[DataFrame], DataFrame] | None = None, closer: Close | None = None) -> DataFrame:
    """(node, component) of the items that link with another.

    band: distinct (rep, key, ...) of distinct sets. attach adds columns to rows of band that met another. Either verify
    gives those of a table of pairs (a, b) that are links, or sets_of the items (rep, items) of a table of reps, of which
    percent must be common. close says of two rows of a bucket, by their further columns, whether they are compared at all.
    In each bucket all are first compared with the member that shares most buckets; after union-find, every close pair of
    a bucket that is still in different components is compared too, unless, with sets_of, the bounds from the rarest items
    of both rule it out, or closer, which has the columns that narrow adds to a table of what is left by then, written anew. So no close pair stays undecided, while a group of m copies costs about m comparisons.
    """
    band = band.repartition("key")  # dealt once: the count reads rep too, so that both sides are the same exchange
    crowd = band.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo != hi").drop("lo", "hi")
    met = materialize(band.join(crowd, "key"))
    if attach is not None:
        met = materialize(attach(met), met)
    more_columns = [c for c in met.columns if c not in ("key", "rep", "m")]
    degree = met.groupBy("rep").agg(F.sum(F.col("m") - 1).alias("degree"))
    hub = met.join(degree, "rep").groupBy("key").agg(F.max(F.struct("degree", "rep", *more_columns)).alias("h"))
    hub = materialize(hub.select("key", *[F.col(f"h.{c}").alias(f"{c}2") for c in ("rep", *more_columns)]))
    mine, other = F.col, lambda c: F.col(f"{c}2")
    star = met.join(hub, "key").where((F.col("rep") != F.col("rep2")) & close(mine, other))
    star = materialize(star.select(F.col("rep2").alias("a"), F.col("rep").alias("b")).distinct())
    sets = None
    if sets_of is not None:
        sets = materialize(sets_of(materialize(met.select("rep").distinct())))
        verify = lambda pairs: verified(pairs, sets, percent)
    links = materialize(verify(star), star)
    found = components(links, "a", "b")

    # the members of buckets whose members but the hub, which has met all of them, still are of several components c
    placed = met.where("m > 2").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", *more_columns, F.coalesce("component", "rep").alias("c"))
    others = placed.join(hub.select("key", "rep2"), "key").where("rep != rep2").drop("rep2")
    mixed = others.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), _cells()).where("c0 != c1").select("key", *["g"] * (narrow is not None))
    rest = materialize(others.join(mixed, "key"), met, hub)
    close_by = close(mine, other)
    if narrow is not None:
        rest = narrow(rest)
        close_by &= closer(mine, other)
    if sets is not None:
        rest = materialize(rest.join(bounds(sets, rest, percent), "rep"), rest)
        close_by &= _near(percent)
    across = materialize(_across(rest, close_by), rest)
    more = materialize(verify(across), across)
    if more.isEmpty():
        drop_table(more)
        return found
    return components(links.unionByName(more), "a", "b")
