"""Stages of the pipeline against brute force on small tables with null ids and rows that share one."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline as P  # noqa: E402
from tickloom.llm import mixing  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    """Every row has its own number of words, so that mix() tells rows without a doc_id apart."""
    rng = random.Random(5)
    out = []
    for i in range(60):
        text = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(20 + i))
        out.append((None if i % 3 == 0 else i // 2, text, "en", f"s{i % 2}", len(text)))
    return out


def test_mixing_stage(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = {r["size"]: r.taken for r in mixing.mix(docs).collect()}
    want = Counter()
    for r in rows:
        n = len(r[1].split())
        want[r] += int(taken[n] / n + 0.5)
    got = P.mixing(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == +want
    assert any(r[0] is None for r in +want)


def test_stages_take_any_column_names(spark, tmp_path, rows):
    """Names that stages use inside pass through unchanged, in full and in empty tables; nulls and repeats included."""
    names = ["q_text", "q_row", "_once", "n_lines", "n_removed", "_d1", "_gone", "_n", "first_text", "n", "_times", "row", "time", "size", "bucket", "h", "taken", "rep", "key"]
    docs = spark.createDataFrame([*rows, rows[0], (7, None, None, None, None), (8, "", "", "", 0)], SCHEMA)
    docs = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in names])
    spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, docs.limit(0)):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == docs.columns, name
            got = out.collect()
            assert all(r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}" for r in got for c in names), name
            assert bool(got) == (table is docs)


def test_near_dedup_and_line_dedup_stages(spark):
    """One document of each group of near copies stays, and one line of each component; what is unlike is left alone."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [[word() for _ in range(120)] for _ in range(8)]
    near = [[*b[:60], "other", *b[61:]] for b in base[:4]]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate([*base, *near, base[0]])], SCHEMA)
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, "").collect()) == list(range(8))
    lines = spark.createDataFrame([(i, " ".join(w) + "\nA line of boilerplate that stands in every document, number " + "x" * (i % 2), "en", "s", 1) for i, w in enumerate(base)], SCHEMA)
    got = sorted(P.line_dedup(spark, lines, "").collect())
    assert [r.text.count("\n") for r in got] == [1] + [0] * 7 and [r.text.split("\n")[0] for r in got] == [" ".join(w) for w in base]
    assert all(r.n_chars == len(r.text) for r in got[1:])
