"""Line dedup: fuzzy lines by MinHash over character shingles; signatures and set comparisons in NumPy over Arrow."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import kernels as K
from tickloom.llm.common import WORD, drop_table, free_names, materialize
from tickloom.llm.linking import Side, linked

U = np.uint64
#: Characters of a shingle, and the similarity in percent from which lines are one: one character edited inside a line
#: of different shingles leaves it one from 49 characters.
SHINGLE, PERCENT = 5, 80
#: Bands of a signature, and values of a band. Lines at a similarity of 0.8 are missed with a probability of 2e-3, at
#: 0.9 of 3e-7.
BANDS, ROWS = 16, 5
#: Lines of LONG shingles or more have one hash for each shingle, of which each band has its own bin; lines of SHORT or
#: less, and those that seem to have SPARSE different ones or less, have a hash for each band. Like lines differ in the
#: number of different shingles by a quarter at most, so they meet in one way or both.
LONG, SHORT, SPARSE = 96, 150, 180
#: Up to so many lines (8 bytes each) whose texts are wanted are broadcast; beyond, they are joined by shuffle.
BROADCAST_LINES = 1_000_000
#: A sketch has the last PLANES bits of each of 64 values, the bits of one place together. Of two lines' 64 values so
#: many may differ at most, else the lines are not compared in full: at a similarity of 0.8 more differ with a
#: probability of 1e-5, at 0.5 some 30 do.
PLANES, DIFFER = 4, 26
SKETCH = [f"s{p}" for p in range(PLANES)]
#: Each shingle of a line sets one bit of MARKS. Of lines alike, the bits that only one has are few: more than their
#: mean and SURE standard deviations have a probability of 1e-5 at most.
MARKS, SURE = 1024, 4.3
#: Size of a line with more than 0.95 of its marks set, which tell it no more.
FULL = 1e9
SEED = 0x2545F491
#: Characters whose shingles are hashed at once, and characters of the lines taken together.
BLOCK, TOGETHER = 1 << 16, 1 << 20
#: Names of lines that a task remembers, so that a line it meets again isn't signed again.
REMEMBERED = 1_000_000
#: Fills lines shorter than a shingle; no line has it.
FILL = "\n"


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, d1, no, line, h1, h2) of each line with a word; line is trimmed and lower case."""
    df = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("d1"), F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("no", "line"))
    df = df.where(F.col("line").rlike(WORD)).withColumn("line", F.lower(F.trim("line")))
    return df.select("doc_id", "d1", "no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(SEED), "line").alias("h2"))


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lines end to end, where each starts, its number of shingles; one shorter than a shingle is filled up."""
    text = "".join(x if len(x) >= SHINGLE else x.ljust(SHINGLE, FILL) for x in lines)
    size = np.fromiter((max(len(x), SHINGLE) for x in lines), np.int64, len(lines))
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), np.cumsum(size) - size, size - (SHINGLE - 1)


def _shingles(lines: list[str]):
    """(hashes, line of each) of the shingles of lines in order, BLOCK at once."""
    codes, start, count = _codes(lines)
    for lo in range(0, len(codes) - SHINGLE + 1, BLOCK):
        x = K.mix(K.grams(codes[lo : lo + BLOCK + SHINGLE - 1].astype(U), SHINGLE))
        hi = lo + len(x)
        i, j = np.searchsorted(start, lo, "right") - 1, np.searchsorted(start, hi, "left")
        first = np.maximum(start[i:j], lo)
        own = np.repeat(np.arange(i, j), np.append(first[1:], hi) - first)
        inside = np.arange(lo, hi) < (start + count)[own]
        yield x[inside], own[inside]


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n)) if n else x


def _keys(least: np.ndarray, kind: int) -> np.ndarray:
    """Band keys of values (lines, BANDS, ROWS); the last bit says which way they were made."""
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), least.shape[:2])
    for r in range(ROWS):
        key = K.mix(key * U(0xD6E8FEB86659FD93) + least[:, :, r])
    return (key & ~U(1)) | U(kind)


def _planes(least: np.ndarray) -> np.ndarray:
    """(lines, PLANES): the last bits of the first 4 values of each band, those of one place together."""
    values = least[:, :, :4].reshape(len(least), -1)
    at = np.arange(values.shape[1], dtype=U)
    return np.stack([np.bitwise_or.reduce(((values >> U(p)) & U(1)) << at, axis=1) for p in range(PLANES)], axis=1)


def _mark(marks: np.ndarray, x: np.ndarray, own: np.ndarray) -> None:
    marks[own * MARKS + ((x >> U(20)) % U(MARKS)).astype(np.int64)] = True


def _short_values(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lines, BANDS, ROWS) values, and marks: a band's values are the least of a hash of its own, seeded before mixing, turned by fifths of
    64 bits, so that each orders the shingles by other bits."""
    least = np.full((BANDS, ROWS, len(lines)), np.iinfo(U).max, U)
    marks = np.zeros(len(lines) * MARKS, bool)
    for x, own in _shingles(lines):
        if not len(x):
            continue
        _mark(marks, x, own)
        cut = np.flatnonzero(np.diff(own, prepend=-1))
        who = own[cut]
        for b in range(BANDS):
            y = K.mix(x ^ U(0x9E3779B97F4A7C15 * (b + 1) % (1 << 64)))
            for j in range(ROWS):
                least[b, j, who] = np.minimum(least[b, j, who], np.minimum.reduceat(_turn(y, 64 // ROWS * j), cut))
    return np.ascontiguousarray(least.transpose(2, 0, 1)), marks


def _long_values(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values and marks as above by one hash, whose bits deal a shingle to a band; (lines, BANDS) whether a band has a shingle;
    whether a line is sparse: the minima tell how many different shingles there are, within a ninth."""
    least = np.full(len(lines) * BANDS * ROWS, np.iinfo(U).max, U)
    marks = np.zeros(len(lines) * MARKS, bool)
    for x, own in _shingles(lines):
        _mark(marks, x, own)
        place = (own * BANDS + ((x >> U(40)) % U(BANDS)).astype(np.int64)) * ROWS
        for j in range(ROWS):
            np.minimum.at(least, place + j, _turn(x, 64 // ROWS * j))
    least = least.reshape(-1, BANDS, ROWS)
    has = least[:, :, 0] != np.iinfo(U).max
    share = np.where(has[:, :, None], least / 2.0**64, 0).sum(axis=(1, 2))
    return least, marks, has, ~has.all(axis=1) | (BANDS * BANDS * ROWS <= SPARSE * share)


BANDS_SCHEMA = pa.schema([("rep", pa.int64()), ("keys", pa.list_(pa.int64())), *[(s, pa.int64()) for s in SKETCH], ("marks", pa.list_(pa.int64())), ("size", pa.float64())])


def _signed(names: np.ndarray, lines: list[str]):
    """Record batches of BANDS_SCHEMA: a row for each line and way; one of a line's two has its marks."""

    def rows(which: np.ndarray, least: np.ndarray, marks: np.ndarray, kind: int, has: np.ndarray) -> pa.RecordBatch:
        at = np.concatenate([[0], np.cumsum(has.sum(axis=1))])
        planes = _planes(least).view(np.int64)
        here = (size[which] >= LONG) == kind
        bits = np.packbits(marks.reshape(-1, MARKS)[here], axis=1, bitorder="little").view(U)
        filled = marks.reshape(-1, MARKS).mean(axis=1)
        sizes = np.where(filled > 0.95, FULL, -MARKS * np.log1p(-np.minimum(filled, 0.95)))
        marks = K.lists(bits.ravel(), np.concatenate([[0], np.cumsum(here * (MARKS // 64))]))
        return pa.record_batch([pa.array(names[which]), K.lists(_keys(least, kind)[has], at), *[pa.array(planes[:, p]) for p in range(PLANES)], marks, pa.array(sizes)], schema=BANDS_SCHEMA)

    size = np.fromiter((len(x) for x in lines), np.int64, len(lines)) - (SHINGLE - 1)
    long, short = np.flatnonzero(size >= LONG), size <= SHORT
    if len(long):
        least, marks, has, sparse = _long_values([lines[i] for i in long])
        short[long[sparse]] = True
        yield rows(long, least, marks, 1, has)
    some = np.flatnonzero(short)
    if len(some):
        least, marks = _short_values([lines[i] for i in some])
        yield rows(some, least, marks, 0, np.ones(least.shape[:2], bool))


def _sign(batches):
    seen = set()
    for batch in batches:
        names, column = batch.column("h1").to_pylist(), batch.column("line").cast(pa.large_binary())
        some, lines, size = [], [], 0
        for i, name in enumerate(names):
            if name in seen:
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(name)
            line = column[i].as_py().decode("utf-8", "replace")
            some.append(name)
            lines.append(line)
            size += len(line)
            if size >= TOGETHER:
                yield from _signed(np.array(some, np.int64), lines)
                some, lines, size = [], [], 0
        if some:
            yield from _signed(np.array(some, np.int64), lines)


def _texts(lines: DataFrame) -> DataFrame:
    """(h1, line), one row for each h1."""
    return lines.groupBy("h1").agg(F.first("line").alias("line"))


def _wanted(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """(h1, line) of the ids (h1)."""
    return _texts(lines.join(F.broadcast(ids) if ids.count() <= BROADCAST_LINES else ids, "h1", "left_semi"))


def _packed(codes: np.ndarray, most_bits: int) -> tuple[np.ndarray, int]:
    """(a number for each run of SHINGLE code points, its bits, most_bits at most): equal runs, and only they, have equal ones."""
    known = np.unique(codes)
    table = np.zeros(int(known[-1]) + 1, U)
    table[known] = np.arange(len(known), dtype=U)
    code = table[codes]
    bits, n = max(1, (len(known) - 1).bit_length()), len(codes) - SHINGLE + 1
    packed, used = code[:n], bits
    for i in range(1, SHINGLE):
        if used + bits > 64:
            packed, used = _ranks(packed)
        packed, used = (packed << U(bits)) | code[i : n + i], used + bits
    return (packed, used) if used <= most_bits else _ranks(packed)


def _ranks(packed: np.ndarray) -> tuple[np.ndarray, int]:
    known, rank = np.unique(packed, return_inverse=True)
    return rank.astype(U), max(1, (len(known) - 1).bit_length())


def like(lines: list[str], percent: int) -> np.ndarray:
    """Of lines a, b, a, b, ...: whether the sets of shingles of each a and b have a Jaccard similarity of percent / 100 or more."""
    codes, start, count = _codes(lines)
    item, bits = _packed(codes, 64 - len(lines).bit_length())
    own = np.repeat(np.arange(len(lines)), count)
    item = item[np.arange(len(own)) + np.repeat(start - (np.cumsum(count) - count), count)]
    item = np.sort((own.astype(U) << U(bits)) | item)  # a line's number above each of its shingles
    item = item[np.append(True, item[1:] != item[:-1])]
    first = np.searchsorted(item, np.arange(len(lines) + 1, dtype=U) << U(bits))
    size = np.diff(first).reshape(-1, 2).sum(axis=1)
    own = np.repeat(np.arange(len(lines)) // 2, np.diff(first)).astype(U)
    item = np.sort((own << U(bits)) | (item & U((1 << bits) - 1)))
    both = np.bincount((item[1:][item[1:] == item[:-1]] >> U(bits)).astype(np.int64), minlength=len(size))
    return 100 * both >= percent * (size - both)


def _likes(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            one, two = (batch.column(c).cast(pa.large_binary()) for c in ("a_line", "b_line"))
            lines, size, first = [], 0, 0
            for i in range(len(one)):
                x, y = (c[i].as_py().decode("utf-8", "replace") for c in (one, two))
                lines += (x, y)
                size += len(x) + len(y)
                if size >= BLOCK or i == len(one) - 1:
                    hit = pa.array(like(lines, percent))
                    yield pa.record_batch([batch.column(c).slice(first, len(hit)).filter(hit) for c in ("a", "b")], schema=schema)
                    lines, size, first = [], 0, i + 1

    return run


def _like(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of lines whose sets of shingles have a Jaccard similarity of percent / 100 or more: lines are
    joined, and shingles made where they are compared."""
    ids = materialize(pairs.select(F.col("a").alias("h1")).unionByName(pairs.select(F.col("b").alias("h1"))).distinct())
    texts = materialize(_wanted(lines, ids), ids)
    one, two = (texts.select(F.col("h1").alias(c), F.col("line").alias(f"{c}_line")) for c in ("a", "b"))
    met = pairs.join(one, "a").join(two, "b").select("a", "b", "a_line", "b_line")
    return materialize(met.mapInArrow(_likes(percent), "a long, b long"), texts)


def line_bands(lines: DataFrame) -> DataFrame:
    """(rep, keys, *SKETCH, marks, size): the bands of the MinHash signatures of lines (h1, line), which may repeat; a row for
    each line and way, more where several tasks meet the line."""
    return materialize(lines.select("h1", "line").mapInArrow(_sign, f"rep long, keys array<long>, {', '.join(f'{s} long' for s in SKETCH)}, marks array<long>, size double"))


def _meeting(batches):
    """Of rows (key, rep) in order: those whose key another rep has, once each."""
    schema = pa.schema([("rep", pa.int64()), ("key", pa.int64())])
    key, rep, met = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # the last row, and whether one before it has its key
    for batch in batches:
        key = np.append(key, batch.column("key").to_numpy())
        rep = np.append(rep, batch.column("rep").to_numpy())
        if not len(key):
            continue
        once = np.append(True, (key[1:] != key[:-1]) | (rep[1:] != rep[:-1]))
        key, rep = key[once], rep[once]
        same = key[1:] == key[:-1]
        keep = np.append(met, same) | np.append(same, False)
        if len(key) > 1:
            yield pa.record_batch([pa.array(rep[:-1][keep[:-1]]), pa.array(key[:-1][keep[:-1]])], schema=schema)
        key, rep, met = key[-1:], rep[-1:], bool(keep[-1])
    if len(key) and met:
        yield pa.record_batch([pa.array(rep), pa.array(key)], schema=schema)


def meeting(bands: DataFrame) -> DataFrame:
    """Distinct (rep, key) of the keys that several lines have: sorted by key and read as a stream, in four exchanges of
    a quarter of the keys, so that only one takes disk at a time."""
    rows = bands.select("rep", F.explode("keys").alias("key"))

    def some_of(bits: int) -> DataFrame:
        some = rows.where(F.col("key").bitwiseAND(F.lit(6).cast("long")) == bits)
        return materialize(some.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_meeting, "rep long, key long"))

    return reduce(DataFrame.unionByName, [some_of(bits) for bits in (0, 2, 4, 6)])


def sketched(met: DataFrame, bands: DataFrame) -> DataFrame:
    """met (rep, key, ...) with the sketch of rep made the way that key was."""
    kind = lambda key: F.col(key).bitwiseAND(F.lit(1).cast("long")).alias("kind")
    sketches = bands.groupBy("rep", F.col("keys")[0].bitwiseAND(F.lit(1).cast("long")).alias("kind")).agg(*[F.max(s).alias(s) for s in SKETCH])
    return met.withColumn("kind", kind("key")).join(sketches, ["rep", "kind"]).drop("kind")


def marked(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """rows (rep, ...) with the marks of rep, and its number of different shingles as they tell it."""
    ids = materialize(rows.select("rep").distinct())
    marks = bands.where("size(marks) > 0").select("rep", "marks", "size")
    marks = marks.join(F.broadcast(ids) if ids.count() <= BROADCAST_LINES else ids, "rep", "left_semi").dropDuplicates(["rep"])
    return rows.join(marks, "rep")


def marks_close(x: Side, y: Side) -> Column:
    """Whether lines of marks x and y, of so many different shingles together, may have a similarity of PERCENT / 100.

    Of two such lines (100 - PERCENT) / (100 + PERCENT) of both sizes are in one only; of these each sets a bit that only
    one line has, unless one that both have has set it. Full marks tell nothing.
    """
    n, total = float(MARKS), x("size") + y("size")
    apart = reduce(lambda a, b: a + b, [F.bit_count(x("marks")[i].bitwiseXOR(y("marks")[i])) for i in range(MARKS // 64)])
    alone = total * ((100 - PERCENT) / (100 + PERCENT))
    free = F.exp(total * (-PERCENT / (100 + PERCENT) / n))  # share of bits that no shingle of both has set
    error = F.exp(total / (2 * n)) - total / (2 * n) - 1  # of a size told by marks: its variance for each bit
    mean = n * free * (1 - F.exp(alone / -n))
    spread = F.sqrt(alone * free * (1 - free) + n * error * F.pow(free * (2 * (100 - PERCENT) / (100 + PERCENT)), 2))
    return (total >= FULL) | (apart <= mean + SURE * spread + 0.5)


def line_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(occurrences, repeats): all lines (doc_id, d1, no, h1, h2), and for those that have a like, the place kept.

    repeats: h1, h2, keep (doc_id, no, d1): the first occurrence, in order of (doc_id, line number), of any line of
    the component. Lines are like if their sets of character shingles have a similarity of PERCENT / 100 or more.
    """
    all_lines = _lines(docs)
    occurrences = materialize(all_lines.drop("line"))
    # h1 names a line while links are sought; should two different lines have the same, they are only matched exactly
    shared_name = materialize(occurrences.groupBy("h1").agg(F.min("h2").alias("a"), F.max("h2").alias("b")).where("a != b").select("h1"))
    lines = all_lines.select("h1", "line")
    if not shared_name.isEmpty():
        lines = lines.join(F.broadcast(shared_name) if shared_name.count() <= BROADCAST_LINES else shared_name, "h1", "left_anti")
    bands = line_bands(lines)
    close = lambda x, y: F.bit_count(reduce(lambda a, b: a.bitwiseOR(b), [x(s).bitwiseXOR(y(s)) for s in SKETCH])) <= DIFFER
    met = meeting(bands)
    bands = materialize(bands.withColumn("keys", F.slice("keys", 1, 1)), bands)  # one tells the way; the others are no more needed
    found = linked(met, close, lambda pairs: _like(pairs, lines, PERCENT), attach=lambda met: sketched(met, bands), narrow=lambda rest: materialize(marked(rest, bands), rest, bands), closer=marks_close)
    drop_table(met)
    found = found.withColumnRenamed("node", "h1")
    once = occurrences.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "no", "d1")).alias("at")).join(found, "h1", "left")
    once = materialize(once.where("n > 1 or component is not null").select("h1", "h2", "at", F.struct(F.coalesce("component", "h1").alias("c"), F.when(F.col("component").isNull(), F.col("h2")).alias("h2")).alias("component")))
    keep = once.groupBy("component").agg(F.min("at").alias("keep"))
    return occurrences, once.join(keep, "component").select("h1", "h2", "keep")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text reduced to the lines kept, and n_lines (lines with a word), n_removed.

    One line of each component of like lines stays in the whole table: its first occurrence in order of (doc_id, line
    number), doc_id null first. Columns of docs named n_lines or n_removed are replaced. Lines without a word stay where they are. A null text stays null and has no lines;
    rows alike in doc_id and text are one document and have the same result. Columns other than doc_id and text pass
    through. An empty table gives none.
    """
    occurrences, repeats = line_classes(docs.select("doc_id", "text"))
    out = occurrences.join(repeats, ["h1", "h2"])
    out = out.where(~F.struct("doc_id", "no", "d1").eqNullSafe(F.col("keep")))
    d1, d0, gone, n_lines, n_removed = free_names(docs, ["n_lines", "n_removed"], names=("_d1", "_d0", "_gone", "_lines", "_removed"))
    lost = out.groupBy(F.col("d1").alias(d1), F.coalesce("doc_id", F.lit(-1)).alias(d0)).agg(F.collect_set("no").alias(gone))
    lost = materialize(lost, occurrences)
    df = docs.withColumn(d1, F.xxhash64("doc_id", "text")).withColumn(d0, F.coalesce("doc_id", F.lit(-1)))
    df = df.join(lost, [d1, d0], "left")
    lines = F.split(F.col("text"), "\n", -1)
    df = df.withColumn(n_lines, F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.filter(lines, lambda x: x.rlike(WORD)))).cast("long"))
    df = df.withColumn(n_removed, F.coalesce(F.when(F.col(gone).isNotNull(), F.size(gone)), F.lit(0)).cast("long"))
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    df = df.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(left))
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return df.select(*kept, F.col(n_lines).alias("n_lines"), F.col(n_removed).alias("n_removed"))
