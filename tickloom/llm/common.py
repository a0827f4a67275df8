"""What the text operators share: durable intermediate tables, table reading, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.shared import remove, shared_dir

#: A word is a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, *done: DataFrame) -> DataFrame:
    """df as a written table in the shared folder: cuts lineage, survives lost executors.

    Tables in done, which materialize() wrote and only df reads, are removed; the driver's garbage collector is asked
    to run, as it is what frees the shuffle files behind df.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tickloom/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for table in done:
        drop_table(table)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table that materialize() wrote and nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def free_names(*frames: DataFrame | list[str], names: tuple[str, ...]) -> tuple[str, ...]:
    """names, each with as many underscores after it as it takes to clash with no column of frames (case ignored)."""
    taken = {c.lower() for f in frames for c in (f if isinstance(f, list) else f.columns)}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an edge table: (node, component), component being the smallest node reachable.

    Distributed union-find by alternating large-star and small-star steps. Minima are taken by aggregation and
    joined back, so a node with very many neighbours is combined map-side and its join can be split by AQE; no step
    gathers a neighbourhood. Nulls and loops are ignored. Every step is a written table.
    """
    pairs = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    now = materialize(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("lo") != F.col("hi"))).distinct())
    seen = state(now)
    while seen[0]:
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u and v != m").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo != m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        small = small.unionByName(least.select(F.col("m").alias("lo"), "hi"))
        now = materialize(small.distinct(), now)
        old_seen, seen = seen, state(now)
        if seen == old_seen:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def spread_totals(df: DataFrame, keys: list[str], bucket: str, order: list, weight: str = "1", name: str = "before") -> DataFrame:
    """df with `name`: the sum of weight over the rows of the same keys that come earlier in (bucket, order).

    A prefix sum in two levels: buckets are summed (map-side first), their totals accumulated, and only the rows of
    one bucket are sorted together, so a key with a third of all rows is no single task.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(F.expr(weight)).cast("long").alias("_sum"))
    by_key = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(by_key), F.lit(0))).drop("_sum")
    here = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_here", F.coalesce(F.sum(F.expr(weight)).over(here), F.lit(0)))
    return inner.join(offsets, [*keys, bucket]).withColumn(name, (F.col("_base") + F.col("_here")).cast("long")).drop("_base", "_here")
