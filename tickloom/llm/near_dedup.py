"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full shingle sets, union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import kernels as K
from tickloom.llm.common import materialize
from tickloom.llm.linking import linked

U = np.uint64
#: 44 bands of 7 values: a pair at a similarity of 0.8 is missed with a probability of 3e-5, and at 0.25, as documents
#: have that share a long passage, it is a candidate with one of 0.003.
BANDS, ROWS = 44, 7


#: Elements whose permutations are held at once, and the most places of a signature.
BLOCK, PLACES = 49_152, 1024


def super_minhash(values: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (rows x m) of sets of 64-bit hashes; set i is values[at[i]:at[i + 1]].

    In round j every element draws a fraction r and the next place of its own random permutation (Fisher-Yates) and
    offers the correlated rank j + r there; each place keeps the least offer. A set stops early, as soon as all its
    places hold ranks of rounds that are over. Elements are taken in blocks, as what one offers depends on itself only.
    Ranks are integers: j in the top 10 bits, r below. Empty sets keep the largest value everywhere.
    """
    if m > PLACES:
        raise ValueError(f"a signature has {PLACES} places at most")
    sig = np.full((len(at) - 1, m), np.iinfo(U).max, U)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for lo in range(0, len(values), BLOCK):
        own = owner[lo : lo + BLOCK]
        _offers(values[lo : lo + BLOCK], own - own[0], sig[own[0] : own[-1] + 1], m)
    return sig


def _offers(x: np.ndarray, owner: np.ndarray, sig: np.ndarray, m: int) -> None:
    """Lowers the signatures of some sets (rows of sig) by the offers of elements x; owner is the row of each."""
    flat, order = sig.reshape(-1), None
    for j in range(m):
        rank = K.mix(x + U((2 * j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        swap = j + (K.mix(rank ^ U(0x5851F42D4C957F2D)) % U(m - j)).astype(np.int64)
        if j == 0:
            place, first_swap = swap, swap
        else:
            if order is None:
                order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), len(x))
                row = np.arange(len(x)) * m
                order[row + first_swap] = 0
                order[row] = first_swap
            row = np.arange(len(x)) * m
            place = order[row + swap].astype(np.int64)
            order[row + swap] = order[row + j]
            order[row + j] = place
        np.minimum.at(flat, owner * m + place, (U(j) << U(54)) | (rank >> U(10)))
        keep = (sig.max(axis=1) >= U((j + 1) << 54 if j < PLACES - 1 else np.iinfo(U).max))[owner]
        if not keep.all():
            x, owner = x[keep], owner[keep]
            if not len(x):
                return
            if j == 0:
                first_swap = first_swap[keep]
            else:
                order = order.reshape(-1, m)[keep].reshape(-1)


def _signed(shingle: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for row, data, offsets in K.slices(batch.column("text"), 1 << 19):
                got, at = K.shingles(data, offsets, shingle)
                sig = super_minhash(got, at, bands * rows).reshape(-1, bands, rows)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=U), sig.shape[:2])
                for r in range(rows):
                    key = K.mix(key * U(0xD6E8FEB86659FD93) + sig[:, :, r])
                # two sums over the whole set name it: equal sets, and only they, have equal keys
                sums = [np.add.reduceat(np.append(K.mix(got ^ U(c)), U(0)), np.minimum(at[:-1], len(got))) for c in (0x1234567, 0x89ABCDEF01)]
                n = np.diff(at)
                for s in sums:
                    s[n == 0] = 0
                flat = np.where(n[:, None] > 0, np.arange(bands) >= 0, False)
                lens = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))])
                yield pa.record_batch([ids.slice(row, len(n)), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), K.lists(np.ascontiguousarray(key)[flat], lens)], schema=schema)

    return run


def _sets(shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for row, data, offsets in K.slices(batch.column("text")):
                got, at = K.shingles(data, offsets, shingle)
                yield pa.record_batch([batch.column("doc_id").slice(row, len(at) - 1), K.lists(got, at)], schema=schema)

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if the Jaccard similarity of their distinct word shingles is percent / 100 or more;
    component_id is the smallest doc_id reachable by links, kept is doc_id = component_id. Rows with equal sets
    (exact copies among them) are one class and take part once, as their smallest doc_id. Candidates share a band of
    their SuperMinHash signatures; every candidate is verified on full sets or already in one component (linked()).

    Null or wordless texts have no shingles and link with nothing. Rows that share a doc_id are one document. A null
    doc_id is linked with nothing: component_id null, kept true. Other columns are ignored. An empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(docs.mapInArrow(_signed(shingle, bands, rows), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    alone = classes.groupBy("rep").agg(F.max("n_shingles").alias("n"))
    band = usable.join(classes.select(F.col("rep").alias("doc_id"), "k1", "k2", "n_shingles"), ["doc_id", "k1", "k2", "n_shingles"], "left_semi").select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        sets = docs.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").mapInArrow(_sets(shingle), "doc_id long, items array<long>")
        return sets.groupBy(F.col("doc_id").alias("rep")).agg(F.max("items").alias("items"))

    close = lambda x, y: 100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n"))  # noqa: E731  no pair is more alike than its sizes
    found = linked(band.distinct().join(alone, "rep"), close, sets_of=sets_of, percent=percent)
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2", "n_shingles"], "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
