"""Best-fit packing of tokenised documents, after a Martello-Toth reduction by dominance."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import defaultdict
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialize, spread_totals

CAPACITY, END_ID = 2048, 0
#: Words whose ids a worker remembers; the memory is emptied when it is full.
CACHE_WORDS = 400_000
#: Buckets by which documents of equal length are numbered.
BUCKETS = 256
#: Fixed value: how byte-level BPE of this kind splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_STATE: dict = {}


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """A byte-level vocabulary with bytes in place of the printable characters that stand for them in its file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    return {bytes(map(byte.__getitem__, token)): i for token, i in vocabulary.items() if all(c in byte for c in token)}


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, the same as the tokenizer file gives.

    Byte-level BPE splits a text before every single space that stands between two characters that are not white
    space, whatever stands further off; so the words between such spaces are encoded once each and remembered. New
    words are encoded by the same merges (a token's id is the rank of its merge) in a library that costs less for
    each call. A text with other spaces, or with the string of a special token, is encoded as a whole by the file.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = {k: v for k, v in self.tokenizer.get_vocab().items() if k not in special}
        core = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=byte_ranks(vocabulary), special_tokens={})._core_bpe
        self.words, self.one = core.encode_ordinary, core.encode_single_piece
        self.odd = re.compile("|".join([r" \s|\s |^ | \Z", *map(re.escape, special)]))
        self.hints = ("  ", " \n", "\n ", *special)
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        plain = text.isprintable() or text.replace("\n", "").isprintable()  # then its only white space is " ", "\n"
        if text[0] == " " or text[-1] == " " or any(x in text for x in self.hints) or not plain and self.odd.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        head, *rest = text.split(" ")
        known, words = self.known, self.words
        try:
            tail = b"".join(map(known.__getitem__, rest))
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for x in set(rest).difference(known):
                known[x] = array("I", self.one((" " + x).encode()) if x.isalpha() else words(" " + x)).tobytes()
            tail = b"".join(map(known.__getitem__, rest))
        return array("I", words(head)).tobytes() + tail


def _cut(path: str, capacity: int, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(batches):
        if path not in _STATE:
            _STATE[path] = Encoder(path)
        encode, end = _STATE[path], END_ID.to_bytes(4, "little")
        for batch in batches:
            for row in range(0, batch.num_rows, 500):
                part = batch.slice(row, 500)
                out: list[list] = [[] for _ in schema]
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = encode(text or "") + end
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)] if n > capacity else [0, n]
                    for i, (a, b) in enumerate(pairwise(cuts)):
                        own = ids[4 * a : 4 * b]
                        for to, x in zip(out, (doc_id, i, a, b - a, zlib.crc32(own), own), strict=False):
                            to.append(x)
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and a closing id 0, cut to capacity.

    Only documents of more than capacity ids are cut; all their pieces but the first are full. A null text is empty.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_cut(tokenizer, capacity, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix the sets that dominate every other set with their largest item; counts keeps what is left.

    Martello and Toth: a feasible set with item j dominates all others with j if it is j alone where nothing else
    fits, j with an item that fills the rest exactly, or j with the largest item that fits where no two items fit.
    Some best packing then uses that set, so it is fixed and the smaller instance reduced again. Items of one length
    are handled together.
    """
    fixed = []
    changed = True
    while changed:
        changed = False
        for length in sorted((x for x in counts if counts[x]), reverse=True):
            while counts[length]:
                rest = capacity - length
                left = sorted(x for x in counts if counts[x] - (x == length) > 0)
                fits = [x for x in left if x <= rest]
                if not fits:
                    fixed.append(((length,), counts[length]))
                    counts[length] = 0
                else:
                    low = fits[0]
                    second = low if counts[low] - (low == length) > 1 else (left[1] if len(left) > 1 else capacity + 1)
                    mate = fits[-1]
                    if mate != rest and low + second <= rest:
                        break
                    n = counts[length] // 2 if mate == length else min(counts[length], counts[mate])
                    fixed.append(((length, mate), n))
                    counts[length] -= n
                    counts[mate] -= n
                changed = True
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over (length: count), bins of equal content handled together: (content, bins)."""
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for length in sorted((x for x in counts if counts[x]), reverse=True):
        todo = counts[length]
        for room in sorted(r for r in bins if r >= length):
            for content in list(bins[room]):
                each, have = room // length, bins[room][content]
                full, rest = divmod(min(todo, each * have), each)
                for n, times in ((full, each), (1 if rest else 0, rest)):
                    if n:
                        bins[room - times * length][content + (length,) * times] += n
                        bins[room][content] -= n
                        todo -= n * times
                if not bins[room][content]:
                    del bins[room][content]
                if not todo:
                    break
            if not todo:
                break
        each = capacity // length
        full, rest = divmod(todo, each)
        if full:
            bins[capacity - each * length][(length,) * each] += full
        if rest:
            bins[capacity - rest * length][(length,) * rest] += 1
    return [(content, n) for of in bins.values() for content, n in of.items() if n]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(content, sequences) packing counts[length] items of each length."""
    left = dict(counts)
    fixed = reduce_by_dominance(left, capacity)
    return fixed + best_fit(left, capacity)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, from rank, to rank, first sequence, offset): where the items of a length go, by their rank."""
    out, used, sequence = [], defaultdict(int), 0
    for content, n in patterns:
        offset = 0
        for length in content:
            out.append((length, used[length], used[length] + n, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with a column length, 1 to capacity) with sequence_id and offset.

    All that is planned in one place is the count of pieces of each length, capacity rows at most; the pieces then
    look their places up by (length, rank). Pieces of equal length are ranked in two levels, so no length is one task.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = spark.createDataFrame(slots(plan(counts, capacity)), "length long, r0 long, r1 long, s0 long, offset long")
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)))
    ranked = spread_totals(keyed, ["length"], "_bucket", ["doc_id", "piece", "ids_crc32"], name="_rank")
    out = ranked.join(F.broadcast(places), ["length"]).where("_rank >= r0 and _rank < r1")
    return out.withColumn("sequence_id", F.col("s0") + F.col("_rank") - F.col("r0")).drop("_rank", "_bucket", "r0", "r1", "s0")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of docs is packed, rows alike included; a null or empty text is its closing id alone. An empty table
    gives none. Other columns are ignored.
    """
    out = pack(materialize(tokenize(docs, tokenizer, capacity)), capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
