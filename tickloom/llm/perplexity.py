"""Quality classifier: interpolated modified Kneser-Ney character model of trusted text."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import kernels as K
from tickloom.llm.common import materialize

#: Length of an n-gram. A symbol is a code point or START, which stands before a text; VOCABULARY is how many there are.
#: A context of ORDER - 1 symbols is one number, BITS for each.
ORDER, BITS, START = 4, 21, 0x110000
VOCABULARY = START + 1
#: What workers look up without a join: all n-grams of the SYMBOLS - 2 most frequent characters (ids from 2; 1 is any
#: other, 0 is START), and the TAIL most frequent of all other n-grams. The rest is joined with the whole model.
SYMBOLS, TAIL = 64, 500_000
#: Different n-grams that a worker counts before it hands them on.
HELD = 1_000_000
#: Distinct n-grams looked up by join that are broadcast to the documents; beyond, they are joined by shuffle.
BROADCAST_GRAMS = 1_000_000
#: Trusted documents whose ids (8 bytes each) are broadcast to find their texts; beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Documents are dropped whose perplexity lies outside these quantiles of the trusted documents of their language. Texts
#: are dealt into FOLDS by hash, and each is scored by the model of the trusted texts of the other folds.
LOW, HIGH, FOLDS = 0.01, 0.99, 2
#: A language with fewer trusted documents than this has the quantiles of those of all languages.
LEAST_TRUSTED = 50


def _spread(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, place of each character among them, row of each): a text is preceded by ORDER - 1 START."""
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    size = np.diff(chars)
    row = np.repeat(np.arange(len(size)), size)
    spread = np.full(len(code) + (ORDER - 1) * len(size), START, np.int64)
    at = np.arange(len(code)) + (ORDER - 1) * (row + 1)
    spread[at] = code
    return spread, at, row


def _context(spread: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for k in range(ORDER - 1, 0, -1):
        out = (out << BITS) | spread[at - k]
    return out


def _key(context: np.ndarray, letter: np.ndarray) -> np.ndarray:
    return K.mix(K.mix(context.astype(np.uint64)) + letter.astype(np.uint64))


def _counts():
    schema = pa.schema([("context", pa.int64()), ("letter", pa.int32()), ("n", pa.int64())])

    def merged(parts):
        key, context, letter, n = (np.concatenate(x) for x in zip(*parts))
        key, first, which = np.unique(key, return_index=True, return_inverse=True)
        return key, context[first], letter[first], np.bincount(which, n, len(key)).astype(np.int64)

    def out(part):
        for k in range(0, len(part[0]), 100_000):
            _, context, letter, n = (x[k : k + 100_000] for x in part)
            yield pa.record_batch([pa.array(context), pa.array(letter.astype(np.int32)), pa.array(n)], schema=schema)

    def run(batches):
        held, more = None, []
        for batch in batches:
            for _, data, offsets in K.slices(batch.column("text")):
                spread, at, _ = _spread(data, offsets)
                context, letter = _context(spread, at), spread[at]
                key, first, n = np.unique(_key(context, letter), return_index=True, return_counts=True)
                more.append((key, context[first], letter[first], n))
                if sum(len(x[0]) for x in more) > HELD:
                    held, more = merged([*([held] if held else []), *more]), []
                    if len(held[0]) > HELD:
                        yield from out(held)
                        held = None
        if held or more:
            yield from out(merged([*([held] if held else []), *more]))

    return run


def train(trusted: DataFrame) -> tuple[dict[int, int], DataFrame]:
    """(letters, model) from trusted texts; letters: ids of the most frequent characters; model: order, context,
    letter, value, n. A row of order k has the probability of letter after context (k - 1 symbols) and its count n;
    one of order -k the share that the context leaves to the order below. Any code point is a letter.

    Counts are made on every partition, summed by n-gram (sharded by its hash), and joined: each order's counts with
    the sums of their contexts and with the probabilities of the order below. The highest order counts occurrences,
    the lower ones the different characters to the left; discounts are the modified ones (for 1, 2, and 3 or more).
    Below the lowest order every symbol is as likely as any other.
    """
    counts = trusted.select("text").mapInArrow(_counts(), "context long, letter int, n long").groupBy("context", "letter").agg(F.sum("n").alias("n"))
    orders = {ORDER: materialize(counts)}
    top = orders[ORDER].groupBy("letter").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "letter").limit(SYMBOLS - 2).collect()
    letters = {r["letter"]: i + 2 for i, r in enumerate(top)}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = materialize(orders[k + 1].groupBy(_last("context", k - 1).alias("context"), "letter").agg(F.count(F.lit(1)).alias("n")))
    lower, model = None, None
    for k in range(1, ORDER + 1):
        n = F.col("n")
        c = orders[k].agg(*[F.sum(F.when(n == i, 1).otherwise(0)).cast("double").alias(f"c{i}") for i in (1, 2, 3, 4)]).first()
        c1, c2, c3, c4 = (c[f"c{i}"] or 0.0 for i in (1, 2, 3, 4))
        y = c1 / (c1 + 2 * c2) if c1 + c2 else 0.5
        d = [min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) if a and b else 0.5 for i, a, b in ((1, c1, c2), (2, c2, c3), (3, c3, c4))]
        discount = F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
        rows = orders[k]
        sums = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum(discount).alias("kept_back"))
        rows = rows.join(sums, "context").withColumn("own", (n - discount) / F.col("total")).withColumn("back", F.col("kept_back") / F.col("total"))
        if lower is None:
            rows = rows.withColumn("below", F.lit(1.0 / VOCABULARY))
        else:
            below = lower.select(F.col("context").alias("suffix"), "letter", F.col("p").alias("below"))
            rows = rows.withColumn("suffix", _last("context", k - 2)).join(below, ["suffix", "letter"])
        lower = materialize(rows.select("context", "letter", (F.col("own") + F.col("back") * F.col("below")).alias("p"), "back", "n"))
        found = lower.select(F.lit(k).alias("order"), "context", "letter", F.col("p").alias("value"), "n")
        backs = lower.groupBy("context").agg(F.first("back").alias("value"))
        found = found.unionByName(backs.select(F.lit(-k).alias("order"), "context", F.lit(0).alias("letter"), "value", F.lit(0).cast("long").alias("n")))
        model = found if model is None else model.unionByName(found)
    return letters, materialize(model)


def _last(context: str, k: int):
    """The last k symbols of a context."""
    return F.col(context).bitwiseAND(F.lit((1 << BITS * k) - 1).cast("long"))


def _ids(letters: dict[int, int]) -> np.ndarray:
    table = np.ones(VOCABULARY, np.int64)
    table[START] = 0
    table[list(letters)] = list(letters.values())
    return table


def dense(rows: pa.Table, letters: dict[int, int] | None = None) -> np.ndarray:
    """log2 probability of every n-gram of letters (by default the likeliest of the model), START and, as one, all else.

    Bounded by SYMBOLS ** ORDER. What stands for all else is only right where the model has no other letter.
    """
    order, context, letter, value = (np.asarray(rows.column(c)) for c in ("order", "context", "letter", "value"))
    if letters is None:
        one = order == 1
        letters = {x: i + 2 for i, x in enumerate(letter[one][np.argsort(-value[one], kind="stable")][: SYMBOLS - 2].tolist())}
    ids = _ids(letters)
    at, known = np.zeros(len(order), np.int64), np.ones(len(order), bool)
    for k in range(ORDER - 2, -1, -1):
        there = np.abs(order) > k + 1
        symbol = np.where(there, ids[np.where(there, (context >> (BITS * k)) & ((1 << BITS) - 1), START)], 0)
        at, known = at * SYMBOLS + symbol, known & (symbol != 1)
    mine = ids[letter]
    p = np.zeros(SYMBOLS)
    p[[0, *letters.values()]] = 1 / VOCABULARY
    p[1] = 1 - p.sum()
    for k in range(1, ORDER + 1):
        back = np.ones(SYMBOLS ** (k - 1))
        of = known & (order == -k)
        back[at[of]] = value[of]
        wide = np.resize(p.astype(np.float32), SYMBOLS**k)
        by_context = wide.reshape(-1, SYMBOLS)
        by_context *= back.astype(np.float32)[:, None]
        of = known & (order == k) & (mine != 1)
        wide[at[of] * SYMBOLS + mine[of]] = value[of]
        p = wide
    with np.errstate(divide="ignore"):
        return np.log2(p, out=p)


def _cache(letters: dict[int, int], model: DataFrame) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(table, keys, values): what SYMBOLS and TAIL describe, as log2 probabilities; both are bounded. The table is packed by zstd."""
    near = [F.lit(x) for x in [*letters, START]]
    symbols = [F.shiftright("context", BITS * k).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int") for k in range(ORDER - 1)]
    frequent = (F.col("order") < 0) | F.col("letter").isin(*near)
    for k, x in enumerate(symbols):
        frequent &= (F.abs("order") <= k + 1) | x.isin(*near)
    table = dense(model.where(frequent).select("order", "context", "letter", "value").toArrow(), letters)
    tail = model.where((F.col("order") == ORDER) & ~frequent)
    least, total = 1, 0
    for r in tail.groupBy("n").count().orderBy(F.col("n").desc()).collect():
        total += r["count"]
        if total > TAIL:
            least = r["n"] + 1
            break
    rows = tail.where(F.col("n") >= least).select("context", "letter", "value").toArrow()
    context, letter, value = (np.asarray(rows.column(c)) for c in ("context", "letter", "value"))
    keys = _key(context, letter)
    by = np.argsort(keys)
    return pa.compress(pa.py_buffer(table), "zstd", asbytes=True), keys[by], np.log2(value[by])


def _scores(letters: dict[int, int], shared):
    gap = pa.struct([("context", pa.int64()), ("letter", pa.int32()), ("n", pa.int64())])
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("n_chars", pa.int64()), ("bits", pa.float64()), ("gaps", pa.list_(gap))])

    def run(batches):
        packed, keys, values = shared.value
        table = np.frombuffer(pa.decompress(packed, 4 * SYMBOLS**ORDER, "zstd"), np.float32)
        ids = _ids(letters)
        for batch in batches:
            for r, data, offsets in K.slices(batch.column("text")):
                spread, at, row = _spread(data, offsets)
                near, rows = ids[spread], len(offsets) - 1
                gram, rare = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
                for k in range(ORDER - 1, -1, -1):
                    symbol = near[at - k]
                    gram, rare = gram * SYMBOLS + symbol, rare | (symbol == 1)
                n = np.bincount(row, minlength=rows)
                bits = np.bincount(row, np.where(rare, 0, table[gram]), minlength=rows)
                at, row = at[rare], row[rare]
                context, letter = _context(spread, at), spread[at]
                key = _key(context, letter)
                if len(keys):
                    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    hit = keys[place] == key
                    bits += np.bincount(row[hit], values[place[hit]], minlength=rows)
                    context, letter, key, row = context[~hit], letter[~hit], key[~hit], row[~hit]
                by = np.lexsort((key, row))
                context, letter, key, row = context[by], letter[by], key[by], row[by]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(key)))
                gaps = pa.StructArray.from_arrays([pa.array(context[first]), pa.array(letter[first].astype(np.int32)), pa.array(times)], fields=list(gap))
                ends = np.searchsorted(row[first], np.arange(rows + 1)).astype(np.int32)
                kept = [batch.column(c).slice(r, rows) for c in ("row", "doc_id", "lang")]
                yield pa.record_batch([*kept, pa.array(n.astype(np.int64)), pa.array(bits), pa.ListArray.from_arrays(pa.array(ends), gaps)], schema=schema)

    return run


def _looked_up(grams: DataFrame, model: DataFrame) -> DataFrame:
    """(context, letter, bits) of distinct n-grams by joins with the model, from the highest order down."""
    df = grams.withColumn("p", F.lit(None).cast("double")).withColumn("left", F.lit(1.0))
    for k in range(ORDER, 0, -1):
        own = model.where(F.col("order") == k).select(F.col("context").alias("c"), "letter", F.col("value").alias("own"))
        back = model.where(F.col("order") == -k).select(F.col("context").alias("c"), F.col("value").alias("back"))
        # as many rows as code points at most
        own, back = F.broadcast(own) if k == 1 else own, F.broadcast(back) if k <= 2 else back
        df = df.withColumn("c", _last("context", k - 1)).join(own, ["c", "letter"], "left").join(back, "c", "left")
        df = df.select("context", "letter", F.coalesce("p", F.col("left") * F.col("own")).alias("p"), (F.col("left") * F.coalesce("back", F.lit(1.0))).alias("left"))
    return df.select("context", "letter", F.log2(F.coalesce("p", F.col("left") / VOCABULARY)).alias("bits"))


def scores(docs: DataFrame, letters: dict[int, int], model: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars, perplexity (by character, null for an empty text) of each row of docs (doc_id, lang, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(_cache(letters, model))
    rows = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "lang", "text")
    found = materialize(rows.mapInArrow(_scores(letters, shared), "row long, doc_id long, lang string, n_chars long, bits double, gaps array<struct<context:long,letter:int,n:long>>"))
    shared.destroy()  # found is written
    gaps = found.select("row", F.explode("gaps").alias("g")).select("row", "g.*")
    bits = materialize(_looked_up(gaps.select("context", "letter").distinct(), model))
    if not bits.isEmpty():
        bits = F.broadcast(bits) if bits.count() <= BROADCAST_GRAMS else bits
        more = gaps.join(bits, ["context", "letter"]).groupBy("row").agg(F.sum(F.col("n") * F.col("bits")).alias("more"))
        found = found.drop("gaps").join(more, "row", "left").withColumn("bits", F.col("bits") + F.coalesce("more", F.lit(0.0)))
    score = F.when(F.col("n_chars") > 0, F.pow(F.lit(2.0), -F.col("bits") / F.col("n_chars")))
    return found.select("doc_id", "lang", "n_chars", score.alias("perplexity"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, lang, n_chars, perplexity, low, high, kept.

    Trusted are the documents with a label of quality 1 and none of quality 0 or toxic. No text is scored by a model that
    it trained, so every trusted document is held out when thresholds are taken; only where a fold has no trusted text
    does the model of all of them score all. A document is kept if its perplexity by character lies between the LOW and
    HIGH quantiles of the trusted ones of its language, or of all languages if its own has fewer than LEAST_TRUSTED.
    Empty and null texts have no perplexity and are not kept. Only with no trusted text at all are there no thresholds
    (null) and every text is kept. Null languages are one. An empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0").select("doc_id")
    docs = docs.withColumn("fold", F.coalesce(F.pmod(F.xxhash64("text"), F.lit(FOLDS)), F.lit(0)).cast("int"))
    # ids go to the texts; each text is written once, and only where it is trusted
    good = materialize(good)
    trusted = docs.join(F.broadcast(good) if good.count() <= BROADCAST_IDS else good, "doc_id", "left_semi").where("text != ''").select("fold", "text")
    trusted = materialize(trusted)
    if trusted.select("fold").distinct().count() == FOLDS:
        parts = [scores(docs.where(F.col("fold") == i), *train(trusted.where(F.col("fold") != i))) for i in range(FOLDS)]
        scored = reduce(DataFrame.unionByName, parts)
    else:
        scored = scores(docs, *train(trusted))
    scored = materialize(scored.withColumn("_lang", F.coalesce("lang", F.lit(""))))
    p = "perplexity"
    sure = scored.join(good, "doc_id", "left_semi").where(F.col(p).isNotNull())
    quantiles = F.count(F.lit(1)).alias("n"), F.percentile_approx(p, LOW, 100_000).alias("low"), F.percentile_approx(p, HIGH, 100_000).alias("high")
    cuts = sure.groupBy("_lang").agg(*quantiles).where(F.col("n") >= LEAST_TRUSTED).drop("n")
    pooled = sure.agg(*quantiles).first()
    out = scored.join(F.broadcast(cuts) if cuts.count() < 10_000 else cuts, "_lang", "left")
    for name in ("low", "high"):
        out = out.withColumn(name, F.coalesce(name, F.lit(pooled[name]).cast("double")))
    inside = F.coalesce((F.col(p) >= F.col("low")) & (F.col(p) <= F.col("high")), F.lit(True))
    return out.select("doc_id", "lang", "n_chars", p, "low", "high", (F.col(p).isNotNull() & inside).alias("kept"))
