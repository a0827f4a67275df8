"""Quality rules with risk-controlled thresholds. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import SPACE, WORD, materialize

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
#: What one unit of badness is, for each signal; a document's score is its worst signal in these units.
UNITS = {
    "symbols_per_word": 0.25,
    "shouts_per_word": 0.25,
    "upper_share": 0.40,
    "digit_share": 0.35,
    "mean_word": 14.0,
    "dup_line_share": 0.80,
    "repeat_share": 0.20,
    "stutter_share": 0.30,
}
#: Cutoffs on the score, from the most lenient to the strictest that may be chosen.
LEVELS = [6.0, 5.0, 4.0, 3.5, 3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.0]
#: Labelled documents whose ids (8 bytes each) are broadcast to find their texts; beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: At most this share of the good documents of a stratum may be rejected, but for a probability of DELTA over all strata.
ALPHA, DELTA = 0.02, 0.05


def _n(chars: str, text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def signals(docs: DataFrame) -> DataFrame:
    """docs with the base counts and the columns of UNITS, `score` and `base_failed` (all prefixed with q_).

    A null text has no words. Counts are over whole texts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumn("q_text", text)
    df = df.withColumn("q_w", F.expr(rf"regexp_extract_all(q_text, r'{WORD}', 0)"))
    df = df.withColumn("q_n_words", F.size("q_w").cast("long"))
    df = df.withColumn("q_h", F.expr("transform(q_w, x -> xxhash64(x))")).drop("q_w")
    df = df.withColumn("q_n_stutter", F.expr("size(filter(q_h, (x, i) -> i > 0 and x = get(q_h, i - 1)))"))
    k = REPEAT_WINDOW
    df = df.withColumn("q_win", F.expr(f"if(size(q_h) < {k}, cast(array() as array<bigint>), transform(sequence(1, size(q_h) - {k - 1}), i -> xxhash64(slice(q_h, i, {k}))))")).drop("q_h")
    df = df.withColumn("q_again", F.expr("size(array_distinct(q_win)) < size(q_win)"))
    df = df.withColumn("q_sorted", F.expr("if(q_again, array_sort(transform(q_win, (h, i) -> struct(h as h, i as i))), null)")).drop("q_win")
    df = df.withColumn("q_at", F.expr("array_sort(filter(transform(q_sorted, (x, j) -> if(get(q_sorted, j - 1).h = x.h or get(q_sorted, j + 1).h = x.h, x.i, null)), x -> x is not null))")).drop("q_sorted")
    df = df.withColumn("q_n_repeat_words", F.expr(f"cast(coalesce(aggregate(zip_with(q_at, slice(q_at, 2, size(q_at)), (a, b) -> least({k}, coalesce(b - a, {k}))), 0, (s, x) -> s + x), 0) as bigint)")).drop("q_at")
    text = F.col("q_text")
    df = df.withColumn("q_word_chars", F.length(F.regexp_replace(text, SPACE, "")).cast("long"))
    df = df.withColumn("q_n_symbols", _n(SYMBOLS, text).cast("long"))
    df = df.withColumn("q_lines", F.expr(rf"filter(split(q_text, '\n'), l -> l rlike r'{WORD}')"))
    df = df.withColumn("q_n_lines", F.size("q_lines")).withColumn("q_n_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long")).drop("q_lines")
    words, chars = F.greatest("q_n_words", F.lit(1)), F.greatest("q_word_chars", F.lit(1))
    shares = {
        "symbols_per_word": F.col("q_n_symbols") / words,
        "shouts_per_word": _n("!", text) / words,
        "upper_share": _n("ABCDEFGHIJKLMNOPQRSTUVWXYZ", text) / chars,
        "digit_share": _n("0123456789", text) / chars,
        "mean_word": F.col("q_word_chars") / words,
        "dup_line_share": F.col("q_n_dup_lines") / F.greatest("q_n_lines", F.lit(1)),
        "repeat_share": F.col("q_n_repeat_words") / words,
        "stutter_share": F.col("q_n_stutter") / words,
    }
    df = df.withColumn("q_score", F.greatest(*[shares[s] / F.lit(u) for s, u in UNITS.items()])).drop("q_text", "q_n_lines", "q_again", "q_n_stutter")
    failed = (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > REPEAT_PERCENT * F.col("q_n_words"))
    return df.withColumn("q_base_failed", failed)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exactly but for rounding."""
    if k >= n:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in log))


def fit_cutoffs(scored: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> dict[str, float]:
    """The strictest cutoff on q_score for each stratum whose false rejections are certified.

    The holdout is every labelled document of quality 1 that passes the base rules (of several labels for a doc_id
    the largest quality counts). For a cutoff, "more than alpha of the good documents are rejected" is refuted if
    P(Binomial(n, alpha) <= rejected) <= delta / number of strata (Bonferroni); cutoffs are tested from lenient to
    strict and the first that isn't refuted ends the sequence, which needs no further correction. A stratum with no
    certified cutoff is absent: nothing is rejected there. What comes to the driver is one row for each stratum and
    level. Null strata count as ''.
    """
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("_quality")).where("_quality = 1").select("doc_id")
    hold = scored.where(~F.col("q_base_failed")).join(good, "doc_id", "left_semi")
    counts = [F.sum(F.when(F.col("q_score") >= level, 1).otherwise(0)).alias(f"k{i}") for i, level in enumerate(LEVELS)]
    rows = hold.groupBy(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("s")).agg(F.count(F.lit(1)).alias("n"), *counts).collect()
    out = {}
    for row in rows:
        for i, level in enumerate(LEVELS):
            if binomial_tail(row[f"k{i}"], row["n"], alpha) > delta / len(rows):
                break
            out[row["s"]] = level
    return out


def verdict(cutoffs: dict[str, float], stratum: str = "lang") -> Column:
    """True for rows of signals() that are kept."""
    key = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    cutoff = F.lit(None).cast("double")
    if cutoffs:
        cutoff = F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(cutoffs.items()) for x in pair]), key)
    return ~F.col("q_base_failed") & F.coalesce(F.col("q_score") < cutoff, F.lit(True))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, lang, the base counts, score, base_failed, kept."""
    docs = docs.select("doc_id", "text", "lang")
    scored = materialize(signals(docs).drop("text"))
    cutoffs = fit_cutoffs(scored, labels)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed"]
    return scored.select("doc_id", "lang", *[F.col(f"q_{c}").alias(c) for c in names], verdict(cutoffs).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass, all columns unchanged, whatever their names.

    Null texts have no words and fail; without a column lang, and where it is null, languages are one; rows alike pass or
    fail alike; an empty table gives none.
    """
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    row = docs.select("text", lang.alias("lang"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("q_row"))
    good = materialize(labels.select("doc_id").distinct())
    good = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    held = docs.select("doc_id", "text", lang.alias("lang")).join(good, "doc_id", "left_semi")
    cutoffs = fit_cutoffs(materialize(signals(held).drop("text")), labels)
    # a filter would be pushed below the signals, with a copy of their expressions for each use; an explosion isn't
    out = signals(row).select("q_row", F.explode(F.when(verdict(cutoffs), F.array(F.lit(1)))).alias("q_once"))
    return out.select("q_row.*")
