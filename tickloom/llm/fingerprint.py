"""Document fingerprints: canonical exact digests. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import materialize

#: Seeds of the two halves of the wide hash.
SEEDS = (0x51ED27, 0x2545F491)
#: Up to so many repeated hashes (16 bytes each) are broadcast to find the texts to compare; beyond, they are joined by shuffle.
BROADCAST_HASHES = 1_000_000
#: Rows that a range of the doc_id order holds, about, and the most ranges.
RANGE_ROWS, RANGES = 2_000, 4_096


def canonical(text: Column) -> Column:
    """Unicode-normalised (NFKC), case-folded, normalised again, white space folded to single spaces and trimmed."""
    compose = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    fold = lambda x: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))
    return F.trim(F.regexp_replace(compose(fold(compose(F.coalesce(text, F.lit(""))))), r"(?U)\s+", " "))


def wide_hash(text: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(s), text))), 16, "0") for s in SEEDS])


def _clashes(texts: DataFrame, text: str) -> DataFrame:
    """(_hash, _canon, _r) of canonical forms that differ but share a hash: byte comparison inside equal buckets."""
    hashed = texts.select(canonical(F.col(text)).alias("_canon")).withColumn("_hash", wide_hash(F.col("_canon")))
    again = materialize(hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash"))
    few = again.count() <= BROADCAST_HASHES
    met = hashed.join(F.broadcast(again) if few else again, "_hash", "left_semi")
    differ = met.groupBy("_hash").agg(F.min("_canon").alias("lo"), F.max("_canon").alias("hi")).where("lo != hi").select("_hash")
    forms = met.join(differ, "_hash", "left_semi").distinct()
    return materialize(forms.withColumn("_r", F.row_number().over(Window.partitionBy("_hash").orderBy("_canon")) - 1).where("_r > 0"))


def _named(df: DataFrame, text: str, out: str, clashes: DataFrame | None) -> DataFrame:
    """df with the fingerprint of a text column."""
    df = df.withColumn("_canon", canonical(F.col(text))).withColumn(out, wide_hash(F.col("_canon")))
    if clashes is not None:
        df = df.join(clashes.withColumnRenamed("_hash", out), [out, "_canon"], "left")
        df = df.withColumn(out, F.concat_ws("-", out, F.col("_r").cast("string"))).drop("_r")
    return df.drop("_canon")


def fingerprints(texts: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """texts with a fingerprint for each row: equal exactly for texts of equal canonical form.

    It is a 128-bit xxhash of the canonical form. Forms of one bucket are compared byte by byte; should a bucket hold
    different ones, all but the least carry their rank in it as a suffix. Null counts as the empty text.
    """
    clashes = _clashes(texts, text)
    return _named(texts, text, out, None if clashes.isEmpty() else clashes)


def _ranges(docs: DataFrame) -> Column:
    """The range of doc_id that a row is dealt to, by approximate quantiles; null comes first."""
    ranges = max(1, min(RANGES, docs.count() // RANGE_ROWS))
    share = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", share, 100 * ranges)).first()[0] or [])) if share else []

    def below(lo: int, hi: int) -> Column:
        """The number of bounds that doc_id is above, by halving."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") > bounds[mid], below(mid + 1, hi)).otherwise(below(lo, mid))

    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(below(0, len(bounds)))


def edited_report(docs: DataFrame) -> DataFrame:
    """Each row of docs against an edited text: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last quarter (rounded down) of code points replaced by as many, or all, from
    the start of the text of the next row in ascending (doc_id, text), or of the first row after the last; doc_id null
    comes first. An exact digest knows equal and different: likeness is 1.0 or 0.0. Null texts count as empty. Rows
    are sorted inside ranges of doc_id; the last row of a range meets the first of the next, so no step orders all
    rows in one task. Repeated rows each have a result; an empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    clashes = _clashes(docs, "text")
    clashes = None if clashes.isEmpty() else clashes
    rows = _named(docs.withColumn("part", _ranges(docs)), "text", "fingerprint", clashes)
    order = Window.partitionBy("part").orderBy("doc_id", "text")
    rows = rows.select("doc_id", "text", "fingerprint", "part", F.lead("text").over(order).alias("next_text"), F.lead("fingerprint").over(order).alias("next_fp"), (F.row_number().over(order) == 1).alias("is_first"))

    def edited(df: DataFrame) -> DataFrame:
        k = F.expr("cast(length(text) div 4 as int)")
        df = df.withColumn("edited", F.concat(F.left("text", (F.length("text") - k).cast("int")), F.left(F.coalesce("next_text", F.lit("")), k)))
        df = _named(df, "edited", "edited_fingerprint", clashes)
        return df.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")

    # texts are kept for the first and the last row of a range only
    is_edge = F.col("is_first") | F.col("next_fp").isNull()
    done = edited(rows).select("doc_id", "part", "is_first", "fingerprint", "edited_fingerprint", "next_fp", "n_chars", "edited_sha256", F.when(is_edge, F.col("text")).alias("text"))
    done = materialize(done)
    starts = done.where("is_first").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fp"))
    by_part = Window.orderBy("part")
    follows = starts.select("part").withColumn("next_part", F.coalesce(F.lead("part").over(by_part), F.min("part").over(Window.partitionBy(F.lit(0)))))
    after = follows.join(starts.withColumnRenamed("part", "next_part"), "next_part").drop("next_part")
    last = edited(done.where("next_fp is null").select("doc_id", "part", "text", "fingerprint").join(after, "part"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fp"]
    out = done.where("next_fp is not null").select(*names).unionByName(last.select(*names))
    like = lambda x: F.when(F.col("fingerprint") == F.col(x), 1.0).otherwise(0.0)
    return out.select(*names[:5], like("edited_fingerprint").alias("near_edited"), like("next_fp").alias("near_next"))
