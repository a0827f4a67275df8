"""Sources: in-memory arrays, CSV ticks, clocks, financial reports, user-defined data sources."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from tickloom.functions import leap
from tickloom.plans.node import Node

NAN = float("nan")


def array_source(spark: SparkSession, timestamps, values, schema: str | None = None) -> Node:
    """In-memory history: 1-D non-decreasing timestamps and values of equal length; the last of equal timestamps counts."""
    ts, v = pd.Series(timestamps), list(values)
    if len(ts) != len(v):
        raise ValueError("timestamps and values differ in length")
    if not ts.is_monotonic_increasing:
        raise ValueError("timestamps must not decrease")
    pdf = pd.DataFrame({"ts": ts, "v": v}).drop_duplicates("ts", keep="last")
    return Node(spark.createDataFrame(pdf, schema))


def carry_in(df: DataFrame, ts: str, start, end, entity: tuple[str, ...] = ()) -> DataFrame:
    """Rows in [start, end], and each entity's last row before start as a row at start (unless one is there)."""
    inside = df
    if end is not None:
        inside = inside.where(F.col(ts) <= F.lit(end))
    if start is None:
        return inside
    s = F.lit(start).cast(df.schema[ts].dataType)
    rest = [c for c in df.columns if c not in (*entity, ts)]
    before = inside.where(F.col(ts) <= s).groupBy(*entity).agg(F.max_by(F.struct(*rest), ts).alias("_s"), F.count(F.lit(1)).alias("_n")).where("_n > 0")
    carried = before.select(*entity, s.alias(ts), "_s.*").select(*df.columns)
    return inside.where(F.col(ts) > s).unionByName(carried)


def csv_source(spark: SparkSession, path: str, columns: list[str], *, time_column: str = "date", entity: Column | None = None, start=None, end=None, offset: timedelta = timedelta(0), is_utc: bool = True, tz_offset: timedelta = timedelta(0)) -> Node:
    """Ticks from CSV with a header: the date is the first ten characters of time_column, values are doubles, empty is NaN.

    All files at path are read at once; `entity` (such as a part of input_file_name()) tells them apart. Rows of one
    timestamp coalesce, the last in the file counting. Dates are of UTC, or of TAI without is_utc, tz_offset east of
    Greenwich; offset is added.
    """
    # the header decides the order, so all columns are read as text and only the wanted ones survive pruning
    raw = spark.read.csv(path, header=True, inferSchema=False)
    ts = leap.day_start(F.to_date(F.substring(time_column, 1, 10), "yyyy-MM-dd"), is_utc, tz_offset, offset)
    values = [F.coalesce(F.nullif(F.trim(f"`{c}`"), F.lit("")).cast("double"), F.lit(NAN)).alias(c.replace(".", "_")) for c in columns]
    names = [c.replace(".", "_") for c in columns]
    keys = ("entity",) if entity is not None else ()
    df = raw.select(*([entity.alias("entity")] if keys else []), ts.alias("ts"), *values, F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_o"))
    df = df.groupBy(*keys, "ts").agg(F.max_by(F.struct(*names), "_o").alias("_s")).select(*keys, "ts", "_s.*")
    return Node(carry_in(df, "ts", start, end, keys), "ts", keys, tuple(names))


def estimate_rows(df: DataFrame, bytes_per_row: int = 64) -> int:
    """A guess from the plan's size statistics, for progress only."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // bytes_per_row


def clock(spark: SparkSession, timestamps: Iterable, is_utc: bool = True) -> DataFrame:
    """Explicit ticks. With integer nanoseconds and is_utc they are moved to TAI."""
    df = spark.createDataFrame(pd.DataFrame({"ts": list(timestamps)}))
    return df.select(leap.utc_to_tai(F.col("ts")).alias("ts")) if is_utc and dict(df.dtypes)["ts"] == "bigint" else df


def daily_clock(spark: SparkSession, start: str, end: str, tz: str = "UTC") -> DataFrame:
    """Every local midnight in [start, end], as UTC timestamps."""
    days = spark.sql(f"select explode(sequence(to_date('{start}') - 1, to_date('{end}') + 1, interval 1 day)) d")
    return _midnights(days, start, end, tz)


def monthly_clock(spark: SparkSession, start: str, end: str, tz: str = "UTC") -> DataFrame:
    """The first local midnight of each month in [start, end]; a month that began before start is skipped."""
    days = spark.sql(f"select explode(sequence(trunc(to_date('{start}'), 'MM'), to_date('{end}') + 1, interval 1 month)) d")
    return _midnights(days, start, end, tz)


def _midnights(days: DataFrame, start: str, end: str, tz: str) -> DataFrame:
    ts = F.to_utc_timestamp(F.to_timestamp("d"), tz)
    return days.select(ts.alias("ts")).where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") <= F.lit(end).cast("timestamp")))


def financial_reports(df: DataFrame, values: list[str], *, report: str = "report_date", notice: str | None = "notice_date", entity: tuple[str, ...] = (), order: str | None = None, with_report_date: bool = False, use_effective_date: bool = True, fallback: timedelta = timedelta(days=90), start=None, end=None, is_utc: bool = True, tz_offset: timedelta = timedelta(0)) -> Node:
    """Reports as ticks at the day they are known: the later of report and notice date.

    A missing notice counts as report date + fallback. In effective-date mode reports that are no newer than one
    already known are dropped; otherwise the tick is the report date. with_report_date puts year and day of year first. is_utc and tz_offset are as in
    csv_source.
    """
    r = F.to_date(report)
    late = F.date_add(r, fallback.days)
    known = F.coalesce(F.to_date(notice), late) if notice else late
    df = df.withColumn("_r", r).withColumn("ts", leap.day_start(F.greatest(r, known) if use_effective_date else r, is_utc, tz_offset))
    ties = [F.col(order)] if order else [F.col("_r")]
    if use_effective_date:
        seen = F.max("_r").over(Window.partitionBy(*entity).orderBy("ts", *ties).rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumn("_seen", seen).where("_seen is null or _r > _seen")
    dated = [F.year("_r").cast("double").alias("year"), F.dayofyear("_r").cast("double").alias("day")] * with_report_date
    names = ["year", "day"] * with_report_date + values
    df = df.select(*entity, "ts", "_r", *dated, *values).groupBy(*entity, "ts").agg(F.max_by(F.struct(*names), "_r").alias("_s")).select(*entity, "ts", "_s.*")
    return Node(carry_in(df, "ts", start, end, entity), "ts", entity, tuple(names))


def iter_source(spark: SparkSession, make: Callable[[], Iterator[tuple]], schema: str, name: str = "ticks") -> DataFrame:
    """Any iterator of rows as a data source, pulled on an executor when read; make is called for each read."""

    class Reader(DataSourceReader):
        def read(self, partition):
            yield from make()

    class Ticks(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str | StructType:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Ticks)
    return spark.read.format(name).load()


def empty(spark: SparkSession, schema: str = "ts timestamp, v double") -> DataFrame:
    return spark.createDataFrame([], schema)


def parse_market(symbol: Column) -> Column:
    """Exchange suffix of CODE.SUFFIX, lower case; null where there is none."""
    return F.when(F.instr(symbol, ".") > 0, F.lower(F.element_at(F.split(symbol, r"\."), -1)))


def data_start(start: date, days: int) -> date:
    return start - timedelta(days=days)
