"""Live ticks: Structured Streaming versions of the stateful operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.functions.shared import remove, shared_dir

#: State schema shared by the per-entity operators: the clock so far and a bounded buffer.
STATE = "last_us long, ts array<long>, v array<double>"


def watermarked(df: DataFrame, ts: str = "ts", delay: str = "0 seconds") -> DataFrame:
    return df.withWatermark(ts, delay)


def stateful(df: DataFrame, entity: str, step: Callable[[list, list, int, float], float | None], keep: Callable[[list, list], tuple[list, list]], ts: str = "ts", v: str = "v", clamp: bool = True) -> DataFrame:
    """An operator with a bounded buffer for each entity: (entity, ts, v) for each output tick.

    Each micro-batch is sorted by time. A late event is never dropped: its time is moved forward to the entity's last
    tick, and of several arrivals for one output time the last counts (clamp=False keeps original times). step sees
    the buffer with the new value and returns the output, or None to suppress; keep trims the buffer.
    """
    kind = dict(df.dtypes)[entity]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, times, values = state.get if state.exists else (-(2**63), [], [])
        times, values = list(times), list(values)
        rows = pd.concat(list(batches), ignore_index=True)
        us = rows["_us"].to_numpy()
        order = np.argsort(us, kind="stable")
        out: dict[int, float] = {}
        for t, x in zip(us[order].tolist(), rows["_v"].to_numpy()[order].tolist(), strict=True):
            t = max(t, last) if clamp else t
            if times and times[-1] == t:
                times.pop(), values.pop()
            times.append(t)
            values.append(x)
            y = step(times, values, t, x)
            if y is not None:
                out[t] = y
            last = max(last, t)
            times, values = map(list, keep(times, values))
        state.update((last, times, values))
        yield pd.DataFrame({entity: [key[0]] * len(out), "_us": list(out), "v": list(out.values())})

    src = df.select(entity, F.unix_micros(ts).alias("_us"), F.col(v).cast("double").alias("_v"))
    out = src.groupBy(entity).applyInPandasWithState(run, f"{entity} {kind}, _us long, v double", STATE, "append", GroupStateTimeout.NoTimeout)
    return out.select(entity, F.timestamp_micros("_us").alias(ts), "v")


def rolling_mean(df: DataFrame, entity: str, window: int, **kwargs) -> DataFrame:
    """Mean of the last `window` ticks once there are as many; NaN while one of them isn't finite."""

    def step(times, values, t, x):
        last = np.array(values[-window:])
        if len(last) < window:
            return None
        return float(last.mean()) if np.isfinite(last).all() else float("nan")

    return stateful(df, entity, step, lambda ts, vs: (ts[-window:], vs[-window:]), **kwargs)


def forward_fill(df: DataFrame, entity: str, **kwargs) -> DataFrame:
    def step(times, values, t, x):
        good = [y for y in values if not np.isnan(y)]
        return good[-1] if good else float("nan")

    def keep(ts, vs):
        pairs = [(t, y) for t, y in zip(ts, vs, strict=True) if not np.isnan(y)][-1:]
        return [t for t, _ in pairs], [y for _, y in pairs]

    return stateful(df, entity, step, keep, **kwargs)


def clamp_late(df: DataFrame, entity: str, **kwargs) -> DataFrame:
    """Late events moved forward to the last tick, where they overwrite."""
    return stateful(df, entity, lambda times, values, t, x: x, lambda ts, vs: (ts[-1:], vs[-1:]), **kwargs)


def tumbling(df: DataFrame, entity: str, width: str, delay: str = "0 seconds", ts: str = "ts", v: str = "v", slide: str | None = None) -> DataFrame:
    """Mean and count in windows of event time, final once the watermark has passed."""
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    return df.withWatermark(ts, delay).groupBy(entity, win.alias("w")).agg(F.avg(v).alias("mean"), F.count(F.lit(1)).alias("n")).select(entity, F.col("w.start").alias("start"), "mean", "n")


def sessions(df: DataFrame, entity: str, gap: str, delay: str = "0 seconds", ts: str = "ts") -> DataFrame:
    return df.withWatermark(ts, delay).groupBy(entity, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(entity, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def files(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """A folder of Parquet as a stream: history first, what arrives later after it; back-pressure by files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything there is now through the stream, as a table and temporary view `name`; an error in the query is raised here.

    Rows are written as Parquet to the shared folder by the executors, so the driver holds none of them. In append mode
    the file sink writes each row once; in complete mode the last result stays, in update mode all of them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tickloom/{name}-{uuid.uuid4().hex}"
    writer = df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/state")
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{path}/rows")
    else:
        spark.createDataFrame([], df.schema).write.parquet(f"{path}/rows")
        writer = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/rows"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    remove(spark, f"{path}/state")
    done = spark.read.schema(df.schema).parquet(f"{path}/rows")
    done.createOrReplaceTempView(name)
    return done


class Progress(StreamingQueryListener):
    """Calls on_flush(rows so far) after each micro-batch."""

    def __init__(self, on_flush: Callable[[int], None]) -> None:
        self.on_flush, self.rows = on_flush, 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        self.on_flush(self.rows)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
