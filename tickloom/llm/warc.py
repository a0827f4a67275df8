"""WARC records and their Merkle fixity audit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import materialize

#: Bytes of a WARC file, about; bytes of a file that a leaf of its tree covers; and the children of a tree node.
FILE_BYTES, RANGE_BYTES, FANOUT = 64 << 20, 64 << 10, 16
#: Fixed value: record date, as pages carry none.
DATE = "2024-01-01T00:00:00Z"


def record(url: Column, body: Column) -> Column:
    """A WARC/1.1 resource record as text; null parts count as empty."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit(f"\r\nWARC-Date: {DATE}\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def _placed(pages: DataFrame, file_bytes: int, keep: list[str]) -> DataFrame:
    """(file, offset, length, page_id, sha, *keep) of the record of each page; what is not kept is hashed before it is shuffled."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    df = pages.withColumn("record", record(F.col("url"), F.col("html"))).withColumn("length", F.octet_length("record").cast("long"))
    total = df.agg(F.sum("length")).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    df = df.select("page_id", "url", "length", F.sha2("record", 256).alias("sha"), F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(files)).alias("file"), *keep)
    before = Window.partitionBy("file").orderBy("page_id", "url", "sha").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return df.select("file", "offset", "length", "page_id", "sha", *keep)


def to_records(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(file, offset, length, page_id, record) of each page: pages are dealt to files of about file_bytes by a hash.

    Inside a file records stand in order of (page_id, url, hash of the record). Files are bounded, so their offsets are
    running sums of bounded groups. Nulls in any column count as empty text (page_id null comes first); rows alike are
    records of their own; an empty table gives none.
    """
    return _placed(pages, file_bytes, ["record"]).drop("sha")


def leaves(records: DataFrame) -> DataFrame:
    """(file, offset, length, page_id, sha) of records (file, offset, page_id, record): each is hashed where it is."""
    return records.select("file", "offset", F.octet_length("record").cast("long").alias("length"), "page_id", F.sha2("record", 256).alias("sha"))


def depth_of(*leaf: DataFrame, range_bytes: int = RANGE_BYTES) -> int:
    """Levels above the leaves that the largest file needs to have one root."""
    most = max(x.agg(F.max("offset")).first()[0] or 0 for x in leaf) // range_bytes
    depth = 0
    while most:
        most, depth = most // FANOUT, depth + 1
    return depth


def tree(leaf: DataFrame, depth: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(level, file, node, digest) of all nodes of each file's tree.

    A leaf (level 0) covers a range of offsets, node * range_bytes on, and hashes the records that start there in order of
    their offset; FANOUT neighbouring ranges are hashed in order into the node above, up to one root a file at depth. A
    lost or changed record changes its own range and the nodes above it only. Ranges without a record have no node.
    """
    name = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "sha")
    level = leaf.select("file", F.expr(f"offset div {range_bytes}").alias("node"), F.struct("offset", name.alias("digest")).alias("c"))
    out = None
    for k in range(depth + 1):
        if k:
            level = level.select("file", F.expr(f"node div {FANOUT}").alias("node"), F.struct("node", "digest").alias("c"))
        level = level.groupBy("file", "node").agg(F.sort_array(F.collect_list("c")).alias("cs"))  # one range, or FANOUT at most
        level = level.select("file", "node", F.sha2(F.array_join(F.col("cs.digest"), ";"), 256).alias("digest"))
        found = level.select(F.lit(k).alias("level"), "file", "node", "digest")
        out = found if out is None else out.unionByName(found)
    return out


def _apart(x: DataFrame, y: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of both, of x only, of y only); the n-th row of x with some keys is that of y, in order of offset."""
    number = Window.partitionBy(*keys).orderBy("offset")
    x, y = (d.withColumn("_n", F.row_number().over(number)) for d in (x, y))
    same = [*keys, "_n"]
    return x.join(y.select(*same), same, "left_semi").drop("_n"), x.join(y.select(*same), same, "left_anti").drop("_n"), y.join(x.select(*same), same, "left_anti").drop("_n")


def audit(ours: DataFrame, theirs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """What differs between two replicas' records (file, offset, length, page_id, sha): file, offset, page_id, status.

    Roots are compared first; then only the children of differing nodes are, level by level down to ranges of offsets,
    so what is compared grows with the damage and not with the archive. Records of differing ranges are then matched:
    'shifted' have the same content at another offset of the file, 'corrupt' the same page_id and another content,
    'extra' are only in ours, the replica to check, 'missing' only in theirs (at their offset). Of records alike in
    what is matched, the first is that of the other side's first. Null page_ids are one id. Empty tables are files with
    no record. What is the same in both is not returned.
    """
    columns = ["file", "offset", "length", "page_id", "sha"]
    ours, theirs = (materialize(x.select(*columns)) for x in (ours, theirs))
    depth = depth_of(ours, theirs, range_bytes=range_bytes)
    a, b = (materialize(tree(x, depth, range_bytes)) for x in (ours, theirs))
    keys, suspects = ["file", "node"], None
    for level in range(depth, -1, -1):
        x, y = (d.where(F.col("level") == level).select(*keys, "digest") for d in (a, b))
        if suspects is not None:
            below = suspects.select("file", F.explode(F.sequence(F.col("node") * FANOUT, F.col("node") * FANOUT + FANOUT - 1)).alias("node"))
            x, y = (d.join(below, keys, "left_semi") for d in (x, y))
        both = x.join(y.withColumnRenamed("digest", "digest2"), keys, "full")
        suspects = materialize(both.where(~F.col("digest").eqNullSafe(F.col("digest2"))).select(*keys))
    number = F.expr(f"offset div {range_bytes}")
    x, y = (d.withColumn("node", number).join(suspects, keys, "left_semi").drop("node").withColumn("page", F.coalesce(F.col("page_id").cast("string"), F.lit(""))) for d in (ours, theirs))
    _, x, y = _apart(x, y, ["file", "offset", "length", "page", "sha"])
    x, y = materialize(x), materialize(y)
    shifted, x, y = _apart(x, y, ["file", "length", "page", "sha"])
    corrupt, x, y = _apart(x, y, ["file", "page"])
    parts = [d.select("file", "offset", "page_id", F.lit(s).alias("status")) for d, s in ((shifted, "shifted"), (corrupt, "corrupt"), (x, "extra"), (y, "missing"))]
    return materialize(reduce(DataFrame.unionByName, parts), a, b)


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of the records of a WARC file, plain or with a gzip member for each record."""
    at = 0
    while at < len(data):
        raw, size = data, None
        if data[at : at + 2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            raw = member.decompress(data[at:])
            size, start = len(data) - at - len(member.unused_data), 0
        else:
            start = at
        head_end = raw.find(b"\r\n\r\n", start)
        if not raw[start:].startswith(b"WARC/") or head_end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = raw[start:head_end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        body = head_end + 4
        end = body + int(headers["content-length"])
        if end > len(raw):
            raise ValueError(f"truncated WARC record at byte {at}")
        size = size or end + 4 - at
        yield at, size, headers, raw[body:end]
        at += size


def _parsed(batches):
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("url", pa.string()), ("block", pa.binary())])
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            rows = [(path, at, size, h.get("warc-type"), h.get("warc-target-uri"), block) for at, size, h, block in parse(data)]
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, schema, strict=True)], schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, length, type, url, block) of every record of the WARC files at path; a damaged file raises."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_parsed, "path string, offset long, length long, type string, url string, block binary")


def fixity(pages: DataFrame, replica: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """One row for each record of pages, and one for each that only the replica has: page_id, file, offset, length, digest, status.

    replica has the columns of to_records(). status is 'ok', or what audit() finds; a 'missing' row has the replica's
    offset and neither length nor digest. The digest covers offset, length and content. Repeated pages are records of
    their own; other columns are ignored; with both tables empty there are no rows.
    """
    ours = materialize(_placed(pages, file_bytes, []))
    found = audit(ours, leaves(replica))
    digest = F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "sha"), 256)
    out = ours.select("page_id", "file", "offset", "length", digest.alias("digest")).join(found.where("status != 'missing'").select("file", "offset", "status"), ["file", "offset"], "left")
    out = out.select("page_id", "file", "offset", "length", "digest", F.coalesce("status", F.lit("ok")).alias("status"))
    none = found.where("status = 'missing'").select("page_id", "file", "offset", F.lit(None).cast("long").alias("length"), F.lit(None).cast("string").alias("digest"), "status")
    return out.unionByName(none)
