"""Exact repeats of fixed length across a table: screening by anchors, decision by a given index, byte-exact result.

A unit is a byte or a word; a window is `window` consecutive units of one text. Every window is owned by one anchor:
its least gram of `gram` units (the last of equals), so equal windows are owned by equal grams at equal places. The
windows that one anchor owns form a piece. Screening only drops what can hold no repeat: the pieces of a gram that
occurs once, and all but two of equal pieces. What is left is dealt out by gram and decided by the index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import kernels as K
from tickloom.llm.common import materialize

U = np.uint64
#: Units of pieces that are decided together, about.
BATCH_UNITS = 200_000
#: Windows whose owners are sought at once; longer texts are taken in parts.
PART = 1 << 17


@dataclass(frozen=True)
class Kind:
    """What a unit is, and the sizes: window, gram, and the block in which the index reads a piece."""

    by_word: bool
    window: int
    gram: int
    block: int
    #: (symbols, ends, n) -> for each symbol a name of the run of n symbols from it, equal for equal runs and no others;
    #: -1 where its piece has fewer left
    index: Callable[[np.ndarray, np.ndarray, int], np.ndarray]

    @property
    def blocks(self) -> int:
        """Whole blocks that every window holds."""
        return (self.window - self.block + 1) // self.block

    @property
    def rest(self) -> int:
        """Units of a window around them."""
        return self.window - self.blocks * self.block


def units(kind: Kind, data: np.ndarray, offsets: np.ndarray):
    """(hash of each unit, first unit of each row, start byte, end byte); bytes need no places."""
    if kind.by_word:
        start, end, value, first = K.words(data, offsets)
        return value, first, start, end
    return K._BYTE[data], offsets, None, None


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """For each run of w entries the place of its least, the last of equals: block-wise prefix and suffix minima."""
    n = len(x)
    pad = -n % w
    # order by (value, -place): the top bits of the value, then the place counted backwards, kept unique in a block pair
    y = np.concatenate([x, np.full(pad, np.iinfo(U).max, U)]).reshape(-1, w)
    at = np.arange(n + pad).reshape(-1, w)

    def scan(v: np.ndarray, later: bool) -> tuple[np.ndarray, np.ndarray]:
        best, place = v.copy(), np.broadcast_to(np.arange(w), v.shape).copy()
        step = 1
        while step < w:  # doubling: after it, each entry has the least of 2 * step entries up to it
            if later:
                a, b = best[:, :-step], best[:, step:]
                take = b <= a  # what stands later wins ties
                best[:, :-step], place[:, :-step] = np.where(take, b, a), np.where(take, place[:, step:], place[:, :-step])
            else:
                a, b = best[:, step:], best[:, :-step]
                take = b < a
                best[:, step:], place[:, step:] = np.where(take, b, a), np.where(take, place[:, :-step], place[:, step:])
            step *= 2
        return best, place

    pre, pre_at = scan(y, False)
    suf, suf_at = scan(y, True)
    pre_at, suf_at = (pre_at + at[:, :1]).ravel(), (suf_at + at[:, :1]).ravel()
    pre, suf = pre.ravel(), suf.ravel()
    m = n - w + 1
    left, right = suf[:m], pre[w - 1 : w - 1 + m]
    return np.where(right <= left, pre_at[w - 1 : w - 1 + m], suf_at[:m])


def pieces(kind: Kind, value: np.ndarray, first: np.ndarray):
    """(row, from window, to window, anchor, gram hash, piece hash): the pieces of each row; windows by their first unit.

    Windows are taken in parts, so a piece may be cut into two.
    """
    parts = [_pieces(kind, value[lo : lo + PART + kind.window - 1], first, lo) for lo in range(0, max(len(value) - kind.window + 1, 1), PART)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _pieces(kind: Kind, value: np.ndarray, first: np.ndarray, lo: int):
    w = kind.window - kind.gram + 1
    total = len(value)
    empty = np.zeros(0, np.int64)
    if total < kind.window:
        return empty, empty, empty, empty, np.zeros(0, U), np.zeros(0, U)
    gram = K.mix(K.grams(value, kind.gram))
    owner = sliding_argmin(gram, w)
    row = np.searchsorted(first, np.arange(lo, lo + len(owner)), "right") - 1
    inside = np.arange(lo, lo + len(owner)) + kind.window <= first[row + 1]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(inside & new)
    stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)) + 1
    up, down = K._POWERS.get(total + 1)
    sums = np.zeros(total + 1, U)
    np.cumsum(K.mix(value + U(1)) * up[:total], out=sums[1:])
    last = stop + kind.window - 1
    whole = K.mix((sums[last] - sums[begin]) * down[begin] + (last - begin).astype(U) * U(0xD6E8FEB86659FD93) + K.mix((owner[begin] - begin).astype(U)))
    base = first[row[begin]] - lo
    return row[begin], begin - base, stop - base, owner[begin] - base, gram[owner[begin]], whole


def _anchors(kind: Kind):
    schema = pa.schema([("gram", pa.int64()), ("piece", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("w0", pa.int32()), ("w1", pa.int32()), ("anchor", pa.int32())])

    def run(batches):
        for batch in batches:
            k1, k2 = (np.asarray(batch.column(c)) for c in ("k1", "k2"))
            for row, data, offsets in K.slices(batch.column("text")):
                value, first, _, _ = units(kind, data, offsets)
                at, w0, w1, anchor, gram, piece = pieces(kind, value, first)
                at = at + row
                yield pa.record_batch([pa.array(x) for x in (gram.view(np.int64), piece.view(np.int64), k1[at], k2[at], w0.astype(np.int32), w1.astype(np.int32), anchor.astype(np.int32))], schema=schema)

    return run


def _content(kind: Kind):
    """Rows of a text and its wanted pieces to (gram, piece, lead, twice, content): lead is the anchor's place in the piece."""
    schema = pa.schema([("gram", pa.int64()), ("piece", pa.int64()), ("lead", pa.int32()), ("twice", pa.bool_()), ("content", pa.binary())])

    def run(batches):
        for batch in batches:
            wanted = batch.column("wanted").to_pylist()
            for row, data, offsets in K.slices(batch.column("text")):
                value, first, _, _ = units(kind, data, offsets)
                raw = value if kind.by_word else data
                out: list[list] = [[], [], [], [], []]
                for r in range(len(offsets) - 1):
                    base = first[r]
                    for x in wanted[row + r]:
                        own = raw[base + x["w0"] : base + x["w1"] + kind.window - 1].tobytes()
                        for to, y in zip(out, (x["gram"], x["piece"], x["anchor"] - x["w0"], x["twice"], own), strict=True):
                            to.append(y)
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run


def decide(kind: Kind, gram: np.ndarray, lead: np.ndarray, twice: np.ndarray, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece number, from window, to window): the windows of pieces that occur elsewhere too.

    Pieces of one gram are aligned at it and read in blocks of kind.block units. kind.index, built over the blocks of all
    pieces, names each run of kind.blocks blocks: equal runs, and only they, have equal names. Every window holds such a
    run, and kind.rest units around it: windows are equal if their runs have one name and the units around are equal,
    unit by unit. A window of a piece that stands for several places (twice) counts as two.
    """
    unit = 8 if kind.by_word else 1
    raw = np.frombuffer(b"".join(contents), U if kind.by_word else np.uint8)
    size = np.array([len(x) for x in contents], np.int64) // unit
    at = np.cumsum(size) - size
    b = kind.block
    # blocks of piece p start at lead[p] % b, counted from the anchor
    skip = lead % b
    n_blocks = np.maximum(size - skip, 0) // b
    block_piece = np.repeat(np.arange(len(size), dtype=np.int32), n_blocks)
    first_block = np.cumsum(n_blocks) - n_blocks
    block_no = np.arange(len(block_piece)) - first_block[block_piece]
    symbol = _names(_rows(raw, at[block_piece] + skip[block_piece] + block_no * b, b))
    # a block stands for its content, its gram and its place from the gram
    _, gram_no = np.unique(gram, return_inverse=True)
    symbol = _both(_both(symbol, gram_no[block_piece]), block_no - (lead // b)[block_piece])
    run = kind.index(symbol, first_block + n_blocks, kind.blocks)
    # windows of each piece, and the name of their first whole blocks
    n_win = np.maximum(size - kind.window + 1, 0)
    piece = np.repeat(np.arange(len(size), dtype=np.int32), n_win)
    start = np.arange(len(piece)) - (np.cumsum(n_win) - n_win)[piece]
    low = np.maximum(-((skip[piece] - start) // b), 0)
    name = run[first_block[piece] + low] if len(run) else np.zeros(0, np.int64)
    before = skip[piece] + low * b - start  # units before the run
    key = np.empty((len(piece), kind.rest + 16 // unit), raw.dtype)
    begin = at[piece] + start
    for k in range(kind.rest):
        key[:, k] = raw[begin + k + np.where(before <= k, kind.blocks * b, 0)]
    key[:, kind.rest :] = np.stack([name, before], axis=1).astype(np.int64).view(raw.dtype).reshape(len(piece), -1)
    same = _names(key)
    found = np.bincount(same, 1 + twice[piece])[same] > 1 if len(piece) else np.zeros(0, bool)
    piece, start = piece[found], start[found]
    new = np.ones(len(piece), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(piece)) - 1
    return (piece[head], start[head], start[tail] + 1) if len(piece) else (piece, start, start)


def _rows(raw: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """The n units from each start, a row each."""
    if not len(start):
        return np.zeros((0, n), raw.dtype)
    return np.lib.stride_tricks.sliding_window_view(raw, n)[start]


def _names(rows: np.ndarray) -> np.ndarray:
    """A number for each row, equal exactly for equal rows: sorted by a hash, neighbours are compared in full."""
    if not len(rows):
        return np.zeros(0, np.int64)
    pad = -rows.shape[1] * rows.itemsize % 8 // rows.itemsize
    wide = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(U)
    hashed = wide[:, 0].copy()
    for k in range(1, wide.shape[1]):
        hashed = K.mix(hashed) ^ wide[:, k]
    hashed = K.mix(hashed)
    order = np.argsort(hashed)
    ahead, behind = order[1:], order[:-1]
    equal = np.ones(len(ahead), bool)
    for k in range(wide.shape[1]):
        equal &= wide[ahead, k] == wide[behind, k]
    if (~equal & (hashed[ahead] == hashed[behind])).any():  # different rows of one hash: sort by all bytes
        return np.unique(wide.view(f"V{wide.shape[1] * 8}").reshape(-1), return_inverse=True)[1].reshape(-1)
    out = np.empty(len(rows), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(~equal)])
    return out


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of small integers, equal exactly for equal pairs."""
    if not len(a):
        return np.zeros(0, np.int64)
    b = b - b.min()
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].reshape(-1)


def _decided(kind: Kind):
    """Rows sorted by gram to (gram, piece, lo, hi); whole grams are decided together, a bounded number at a time."""
    schema = pa.schema([("gram", pa.int64()), ("piece", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        gram, piece, lead = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        p, lo, hi = decide(kind, gram, lead, np.array([r[3] for r in rows], bool), [r[4] for r in rows])
        return pa.record_batch([pa.array(gram[p]), pa.array(piece[p]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], schema=schema)

    def run(batches):
        rows, held, last = [], 0, None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("gram", "piece", "lead", "twice", "content")), strict=True):
                if held >= BATCH_UNITS * (8 if kind.by_word else 1) and r[0] != last:
                    yield flush(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[4])
                last = r[0]
        if rows:
            yield flush(rows)

    return run


def _removed(kind: Kind):
    names = ["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256"]
    schema = pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches):
        for batch in batches:
            ranges = batch.column("ranges").to_pylist()
            ids = batch.column("doc_id")
            for row, data, offsets in K.slices(batch.column("text")):
                if kind.by_word:
                    start, end, _, first = K.words(data, offsets, hashes=False)
                else:
                    start = end = None
                    first = offsets
                out: list[list] = [[] for _ in schema]
                text = data.tobytes()
                for r in range(len(offsets) - 1):
                    a, b = int(first[r]), int(first[r + 1])
                    spans: list[list[int]] = []
                    for x in sorted((x["lo"], x["hi"] + kind.window - 1) for x in ranges[row + r] or ()):
                        if spans and x[0] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], x[1])
                        else:
                            spans.append(list(x))
                    keep = list(pairwise([0, *(y for s in spans for y in s), b - a]))[::2]
                    if kind.by_word:
                        kept = b" ".join(text[s:e] for lo, hi in keep for s, e in zip(start[a + lo : a + hi].tolist(), end[a + lo : a + hi].tolist(), strict=True))
                    else:
                        kept = b"".join(text[a + lo : a + hi] for lo, hi in keep)
                    gone = sum(hi - lo for lo, hi in spans)
                    for to, y in zip(out, (ids[row + r].as_py(), b - a, gone, len(spans), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                        to.append(y)
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    assert names == schema.names[:5]
    return run


def remove_repeats(docs: DataFrame, kind: Kind) -> DataFrame:
    """One row for each row of docs: doc_id, n_units, n_removed, n_spans, kept_sha256, kept (bytes).

    Every unit is removed that a window covers whose content also starts anywhere else, in the same text or another.
    Null texts count as empty; rows alike in every column are different places. Texts are whole; other columns are
    ignored; an empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(0x2545F491), "text"))
    found = docs.select("text", "k1", "k2").mapInArrow(_anchors(kind), "gram long, piece long, k1 long, k2 long, w0 int, w1 int, anchor int")
    found = materialize(found)
    often = materialize(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    met = materialize(found.join(often.hint("shuffle_hash"), "gram", "left_semi"), found, often)  # the same way at every size
    # equal pieces are counted; one of their places stands for them
    one = met.groupBy("gram", "piece").agg((F.count(F.lit(1)) > 1).alias("twice"), *[F.first(c).alias(c) for c in ("k1", "k2", "w0", "w1", "anchor")])
    wanted = materialize(one.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "piece", "w0", "w1", "anchor", "twice")).alias("wanted")))
    keys = wanted.select("k1", "k2")
    few = wanted.count() <= 1_000_000  # keys of 16 bytes
    texts = docs.join(F.broadcast(keys) if few else keys, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.max("text").alias("text"))
    content = texts.join(wanted, ["k1", "k2"]).select("text", "wanted").mapInArrow(_content(kind), "gram long, piece long, lead int, twice boolean, content binary")
    repeated = content.repartition("gram").sortWithinPartitions("gram").mapInArrow(_decided(kind), "gram long, piece long, lo int, hi int")
    repeated = materialize(repeated, wanted)
    ranges = met.join(repeated, ["gram", "piece"]).groupBy("k1", "k2").agg(F.collect_set(F.struct((F.col("w0") + F.col("lo")).alias("lo"), (F.col("w0") + F.col("hi")).alias("hi"))).alias("ranges"))
    out = docs.join(ranges, ["k1", "k2"], "left").select("doc_id", "text", "ranges")
    return out.mapInArrow(_removed(kind), "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string, kept binary")
