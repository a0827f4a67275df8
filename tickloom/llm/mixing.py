"""Mixing sources to target weights by a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, materialize, spread_totals

#: Weights of the sources in order, repeating; words of the mix in percent of all words; most times a source is used.
WEIGHTS, PERCENT, EPOCHS = (5, 2, 1), 150, 2
#: Words that a slot of the schedule holds, about.
BLOCK_WORDS = 512
#: Cells of [0, 1) by which points find their source.
CELLS = 4096
#: Buckets of the shuffle of a source's documents.
BUCKETS = 1024
#: 2**64 divided by the golden ratio, odd.
GOLDEN = 11400714819323198485


def sized(docs: DataFrame, seed: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, bucket, h, *carry): size in words, and the place in the shuffle. A null text has size 0."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.xxhash64("text"))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.pmod(h, F.lit(BUCKETS)).alias("bucket"), h.alias("h"), *carry)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, sid, source_size, target) of each source: targets by weight, capped at EPOCHS times the size.

    Sources are numbered by code point, null last. The excess of capped sources is shared by weight among the others
    until none is above its cap: with sources ordered by cap / weight, the capped ones come first, and the level that
    the others share follows from running sums. One row for each source is all that meets in one task.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.orderBy(F.col("source").asc_nulls_last())
    df = by_source.withColumn("sid", F.row_number().over(one))
    df = df.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), ((F.col("sid") - 1) % len(WEIGHTS) + 1).cast("int")))
    df = df.withColumn("cap", F.col("source_size") * float(EPOCHS))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    whole = Window.partitionBy(F.lit(0))
    df = df.withColumn("rank", F.row_number().over(by_ratio))
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(whole) * (PERCENT / 100)
    left = total - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    df = df.withColumn("level", left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(below), F.lit(0.0))))
    df = df.withColumn("open", F.col("cap") > F.col("w") * F.col("level"))
    df = df.withColumn("shared", F.min_by("level", F.when(F.col("open"), F.col("rank"))).over(whole))
    df = df.withColumn("first_open", F.min(F.when(F.col("open"), F.col("rank"))).over(whole))
    target = F.when(F.col("rank") >= F.col("first_open"), F.col("w") * F.col("shared")).otherwise(F.col("cap"))
    return df.select("source", "sid", "source_size", target.alias("target"))


def schedule(wanted: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(position, sid, slot, n_slots): which source fills each position of the mix.

    Position j has the point frac(j / golden ratio), in exact integers; cumulative shares of the targets map it to a
    source. A source's slots are numbered in order of position. A source that gets no position is added at the end.
    """
    spark = wanted.sparkSession
    total = wanted.agg(F.sum("target")).first()[0] or 0.0
    n = int(-(-total // block_words))
    run = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    share = wanted.where("target > 0").withColumn("hi", F.sum("target").over(run) / F.lit(total or 1.0))
    share = share.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0.0)))
    share = share.withColumn("hi", F.when(F.lead("sid").over(Window.orderBy("sid")).isNull(), F.lit(1.0)).otherwise(F.col("hi")))
    cells = share.select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    point = f"cast(((cast(id as decimal(18,0)) * {GOLDEN}BD) % 18446744073709551616BD) as double) / 18446744073709551616D"
    points = spark.range(n).select(F.col("id").alias("position"), F.expr(point).alias("u")).withColumn("u", F.least("u", F.lit(1 - 2**-53)))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS))
    hit = points.join(cells, "cell").where("u >= lo and u < hi").select("position", "sid")
    missing = share.select("sid").join(hit.select("sid").distinct(), "sid", "left_anti").select((F.lit(n) + F.col("sid")).alias("position"), "sid")
    hit = hit.unionByName(missing).withColumn("bucket", F.expr("position div 65536"))
    slots = spread_totals(hit, ["sid"], "bucket", ["position"], name="slot").select("position", "sid", "slot")
    return slots.join(slots.groupBy("sid").agg(F.count(F.lit(1)).alias("n_slots")), "sid")


def mix_pieces(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces).

    documents: doc_id, source, sid, size, source_size, target, *carry, at (start in the source's shuffled stream of words).
    pieces: position, sid, at, from_word, to_word: the words of a document that a position of the mix holds.
    A source's stream, shuffled by hash and read around again where its target asks for more than its size, is cut
    into as many blocks of equal words as it has slots; block r goes to slot r. The blocks of a source make up its
    target exactly, but for the rounding to words.
    """
    sizes = materialize(sized(docs, seed, carry))
    wanted = materialize(targets(sizes))
    slots = materialize(schedule(wanted, block_words))
    placed = sizes.alias("d").join(wanted.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.doc_id", "d.source", "s.sid", "d.size", "s.source_size", "s.target", "d.bucket", "d.h", *[f"d.{c}" for c in carry])
    placed = materialize(spread_totals(placed, ["sid"], "bucket", ["h", "size", "doc_id"], "size", "at").drop("bucket", "h"))
    n_slots = slots.groupBy("sid").agg(F.max("n_slots").alias("n"))
    span = placed.where("size > 0").select("sid", "size", "at", "source_size", F.round("target").cast("long").alias("t")).join(n_slots, "sid")
    span = span.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))))
    span = span.withColumn("lo", F.col("at") + F.col("epoch") * F.col("source_size")).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("t"))).where("lo < hi")
    # slot r holds the words from floor(r * t / n) to floor((r + 1) * t / n)
    edge = lambda r: F.expr(f"cast(floor(cast({r} as decimal(19,0)) * t / n) as bigint)")
    span = span.withColumn("r0", F.expr("greatest(0, cast(floor(cast(lo as decimal(19,0)) * n / t) as bigint) - 1)"))
    span = span.withColumn("r1", F.expr("least(n - 1, cast(floor(cast(hi as decimal(19,0)) * n / t) as bigint) + 1)"))
    span = span.withColumn("slot", F.explode(F.sequence("r0", "r1")))
    span = span.withColumn("b0", F.greatest(edge("slot"), F.col("lo"))).withColumn("b1", F.least(edge("(slot + 1)"), F.col("hi"))).where("b0 < b1")
    pieces = span.join(slots.select("position", "sid", "slot"), ["sid", "slot"])
    return placed, pieces.select("position", "sid", "at", (F.col("b0") - F.col("lo")).alias("from_word"), (F.col("b1") - F.col("lo")).alias("to_word"))


def mix(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken (words the mix takes of it), *carry (columns of docs).

    A document of no words is never taken. Rows that are alike in every column stay rows of their own. An empty table
    gives none. The same input and seed give the same mix.
    """
    placed, pieces = mix_pieces(docs, seed, block_words, carry)
    taken = pieces.groupBy("sid", "at").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    out = placed.join(taken, ["sid", "at"], "left")
    words = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", words.alias("taken"), *carry)
