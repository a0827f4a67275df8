import pandas as pd

from tickloom.operators import rolling
from tickloom.plans.node import Node
from tickloom.streaming import live


def stream(spark, tmp_path, parts):
    schema = "k int, ts timestamp, v double"
    src = tmp_path / "in"
    for i, rows in enumerate(parts):
        pdf = pd.DataFrame([(k, pd.Timestamp(t, unit="s"), float(v)) for k, t, v in rows], columns=["k", "ts", "v"])
        spark.createDataFrame(pdf, schema).coalesce(1).write.parquet(str(src / f"p={i}"))
    return live.files(spark, str(src), schema + ", p int", 1).drop("p")


def test_rolling_equals_batch(spark, tmp_path):
    parts = [[(k, 10 * i + j, i * j + k) for j in range(5) for k in (0, 1)] for i in range(3)]
    got = live.run_available(live.rolling_mean(stream(spark, tmp_path, parts), "k", 4), "roll")
    rows = [(k, t, float(v)) for p in parts for k, t, v in p]
    want = rolling.rolling_mean(Node(spark.createDataFrame(rows, "k int, ts long, v double"), "ts", ("k",)), 4).df
    key = lambda r: (r[0], r[1])
    a = sorted(((r.k, int(r.ts.timestamp()), round(r.v, 9)) for r in got.collect()), key=key)
    assert a == sorted(((r.k, r.ts, round(r.v, 9)) for r in want.collect()), key=key)


def test_late_event_is_clamped(spark, tmp_path):
    got = live.run_available(live.clamp_late(stream(spark, tmp_path, [[(0, 100, 1)], [(0, 50, 2)]]), "k"), "late")
    assert [(int(r.ts.timestamp()), r.v) for r in got.collect()][-1] == (100, 2.0)


def test_windows(spark, tmp_path):
    s = stream(spark, tmp_path, [[(0, 1, 1), (0, 5, 3)], [(0, 100, 9)], [(0, 300, 9)]])
    got = live.run_available(live.tumbling(s, "k", "10 seconds"), "tumble")
    assert (got.orderBy("start").first().mean, got.orderBy("start").first().n) == (2.0, 2)


def test_rows_do_not_pass_the_driver(spark, tmp_path):
    """The result is files in the shared folder, the whole of it in every mode, and empty where no row comes out."""
    parts = [[(0, 1, 1), (0, 2, 3)], [(0, 30, 9)]]
    src = stream(spark, tmp_path, parts)
    ticks = live.run_available(live.clamp_late(src, "k"), "files_append")
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert ticks.inputFiles() and all(shared in f for f in ticks.inputFiles())
    assert sorted(r.v for r in ticks.collect()) == sorted(r.v for r in spark.table("files_append").collect()) == [1.0, 3.0, 9.0]
    counts = src.groupBy("k").count()
    assert [r["count"] for r in live.run_available(counts, "files_complete", "complete").collect()] == [3]
    assert sorted(r["count"] for r in live.run_available(counts, "files_update", "update").collect()) == [2, 3]
    none = live.run_available(live.rolling_mean(src, "k", 4), "files_none")
    assert none.columns == ["k", "ts", "v"] and none.count() == 0


def test_query_reads_a_table_of_several_files(spark, tmp_path, data):
    from tickloom.plans import queries

    spark.read.parquet(f"{data}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got, want = (queries.QUERIES["stream_rolling_mean"](spark, d).collect() for d in (str(tmp_path), data))
    assert sorted(got) == sorted(want) == sorted(queries.QUERIES["rolling_mean"](spark, data).collect()) and got
