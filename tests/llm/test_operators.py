"""Text operators against brute force on small tables with nulls, ties, repeated rows, odd texts and extra columns."""

import dataclasses
import hashlib
import random
import re
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import fingerprint, line_dedup, mixing, near_dedup, packing, perplexity, quality_rules, repeats, substring_dedup, suffix_dedup, warc
from tickloom.llm import kernels as K
from tickloom.llm.common import components

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rep string, c string"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ba", "ko", "ti", "ré", "zu", "mo", "la"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = [sentence(rng, rng.randint(30, 160)) for _ in range(40)]
    passage = sentence(rng, 70)
    texts = list(base)
    for t in base[:12]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += base[12:16] + [passage + "\n" + base[1], base[2] + "\n" + passage, passage]
    texts += [None, "", " ", "one", "one", "\n\n", "a  b\tc \n d", "ab" * 3000, "the " * 400, "é" * 500, base[0] + "\n" + base[0], "# * $ | <>" * 30]
    out = [(i, t, ("en", "de", None)[i % 3], (f"s{i % 4}", None)[i % 9 == 0], len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return out + [out[3], out[3], (None, base[5], "en", "s1", 0, "x", "y", "z")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sets_of(text, n):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def roots(nodes, like):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in nodes:
        for b in nodes:
            if a < b and like(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n in nodes}


def test_near_dedup(docs, rows):
    sets = {i: sets_of(t, 4) for i, t, *_ in rows if i is not None}
    want = roots(sorted(sets), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = near_dedup.near_duplicates(docs, shingle=4).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 100, 100))
    values = np.concatenate([common, a, common, b, common[:1]])
    s = near_dedup.super_minhash(values, np.array([0, 700, 1400, 1401, 1401]), 256)
    assert abs((s[0] == s[1]).mean() - 0.75) < 0.1
    assert (s[3] == np.iinfo(np.uint64).max).all() and sorted((s[2] >> np.uint64(54)).tolist()) == list(range(256))


def test_super_minhash_of_few_elements_fills_all_places():
    """More places than 256 rounds, and sets in several blocks: every element offers at every place."""
    x = np.arange(1, 8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = near_dedup.super_minhash(x, np.array([0, 1, 7]), 308)
    assert sorted((whole[0] >> np.uint64(54)).tolist()) == list(range(308))
    old, near_dedup.BLOCK = near_dedup.BLOCK, 2
    try:
        assert (near_dedup.super_minhash(x, np.array([0, 1, 7]), 308) == whole).all()
    finally:
        near_dedup.BLOCK = old


def units(text, by_word):
    return WORD.findall(text or "") if by_word else list((text or "").encode())


@pytest.mark.parametrize("by_word", [True, False])
def test_repeats(docs, rows, by_word):
    kind = substring_dedup.WORDS if by_word else suffix_dedup.BYTES
    w = kind.window
    starts = Counter(tuple(u[i : i + w]) for r in rows for u in [units(r[1], by_word)] for i in range(len(u) - w + 1))

    def want(text):
        u = units(text, by_word)
        gone = set()
        for i in range(len(u) - w + 1):
            if starts[tuple(u[i : i + w])] > 1:
                gone.update(range(i, i + w))
        kept = [x for i, x in enumerate(u) if i not in gone]
        return len(u), len(gone), hashlib.sha256(" ".join(kept).encode() if by_word else bytes(kept)).hexdigest()

    got = repeats.remove_repeats(docs, kind).collect()
    assert Counter((r.doc_id, r.n_units, r.n_removed, r.kept_sha256) for r in got) == Counter((i, *want(t)) for i, t, *_ in rows)


@pytest.mark.parametrize("index", [suffix_dedup.named_runs, substring_dedup.named_runs])
def test_index(index):
    rng = random.Random(3)
    for _ in range(300):
        parts = [[rng.randrange(3) for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(0, 5))]
        n = rng.randint(1, 4)
        runs = [tuple(p[s : s + n]) if s + n <= len(p) else None for p in parts for s in range(len(p))]
        got = index(np.array([c for p in parts for c in p], np.int64), np.cumsum([len(p) for p in parts]).astype(np.int64), n).tolist()
        assert [x >= 0 for x in got] == [r is not None for r in runs]
        pairs = {(x, r) for x, r in zip(got, runs, strict=True) if x >= 0}
        assert len(pairs) == len({x for x, _ in pairs}) == len({r for _, r in pairs})


def test_pieces_in_parts(monkeypatch):
    """Texts taken in parts have the same windows, owned by the same grams at the same places."""
    data = np.frombuffer(sentence(random.Random(3), 900).encode(), np.uint8)
    first = np.array([0, 0, 1500, 1600, len(data)])
    windows = lambda: {(r, s, a, g) for r, lo, hi, a, g, _ in zip(*(x.tolist() for x in repeats.pieces(suffix_dedup.BYTES, K._BYTE[data], first)), strict=True) for s in range(lo, hi)}
    whole = windows()
    monkeypatch.setattr(repeats, "PART", 301)
    assert windows() == whole and len(whole) == sum(max(0, b - a - 199) for a, b in zip(first, first[1:], strict=False))


@pytest.mark.parametrize("kind", [suffix_dedup.BYTES, substring_dedup.WORDS])
def test_the_index_decides(spark, rows, kind):
    """With an index that gives every run one name the result is another."""
    blind = dataclasses.replace(kind, index=lambda symbols, ends, n: np.zeros(len(symbols), np.int64))
    rng = random.Random(21)
    # equal around the runs, different inside them: one unit is changed in the middle
    base = [sentence(rng, 60) for _ in range(6)]
    edited = [" ".join(w if i != 30 else w[::-1] + "x" for i, w in enumerate(t.split(" "))) for t in base]
    docs = spark.createDataFrame(list(enumerate([*base, *edited, base[0]])), "doc_id long, text string")
    right, wrong = (sorted((r.doc_id, r.n_removed) for r in repeats.remove_repeats(docs, k).collect()) for k in (kind, blind))
    assert right != wrong


def test_suffix_array():
    rng = random.Random(4)
    for _ in range(500):
        x = [rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 40))]
        assert suffix_dedup.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def test_line_dedup(docs, rows):
    def clean(line):
        return line.strip(" ").lower()

    places = {}
    for i, t, *_ in sorted({r[:2] for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, line in enumerate((t or "").split("\n")):
            if WORD.search(line):
                places.setdefault(clean(line), []).append((i, n))
    k = line_dedup.SHINGLE
    sets = {x: {x[i : i + k] for i in range(len(x) - k + 1)} or {x} for x in places}
    root = roots(sorted(places), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    order = lambda p: (p[0] is not None, p[0] or 0, p[1])
    keep = {}
    for x, at in places.items():
        keep[root[x]] = min([*([keep[root[x]]] if root[x] in keep else []), *at], key=order)
    want = Counter()
    for i, t, *_ in rows:
        lines = None if t is None else [x for n, x in enumerate(t.split("\n")) if not WORD.search(x) or keep[root[clean(x)]] == (i, n)]
        want[(i, None if lines is None else "\n".join(lines))] += 1
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want


def test_line_edits_of_short_lines(spark):
    """One edited character in lines of 40 to 100: the copy goes wherever the similarity is 0.8 by shingles of five."""
    rng = random.Random(12)
    rows, want = [], {}
    for i in range(300):
        a = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40 + i % 61))
        at = rng.randrange(len(a))
        b = a[:at] + ("#" if a[at] != "#" else "+") + a[at + 1 :]
        x, y = ({s[j : j + 5] for j in range(len(s) - 4)} for s in (a, b))
        rows += [(2 * i, a), (2 * i + 1, b)]
        want[2 * i + 1] = 5 * len(x & y) >= 4 * len(x | y)
    gone = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()}
    due = {i for i, w in want.items() if w}
    assert len(due) > 200 and gone <= due and len(due - gone) <= 0.01 * len(due)


def test_line_likeness_is_exact():
    """Comparison of lines against Python sets: small and large alphabets, repeats, lines shorter than a shingle."""
    rng = random.Random(3)
    k = line_dedup.SHINGLE
    shingles = lambda x: {x[i : i + k] for i in range(len(x) - k + 1)} or {x}
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz ", [chr(c) for c in range(0x4E00, 0x9E00)] + ["\U0010ffff"]):
        for n in (1, 7, 60):
            lines = []
            for _ in range(n):
                a = "".join(rng.choices(alphabet, k=rng.randint(1, 300)))
                b = "".join(rng.choice(alphabet) if rng.random() < 0.02 else c for c in a)
                lines += [a, b[: rng.randint(max(1, len(b) - 40), len(b))]]
            sets = [shingles(x) for x in lines]
            want = [100 * len(a & b) >= 80 * len(a | b) for a, b in zip(sets[::2], sets[1::2])]
            assert line_dedup.like(lines, 80).tolist() == want


def test_line_buckets_read_as_a_stream():
    """Rows whose key another line has, once each, wherever batches end."""
    rng = random.Random(4)
    rows = sorted((rng.randrange(40), rng.randrange(6)) for _ in range(120))
    lines_of = Counter(key for key, _ in set(rows))
    want = sorted((key, rep) for key, rep in set(rows) if lines_of[key] > 1)
    for size in (1, 2, 7, 200):
        batches = [pa.record_batch({"rep": pa.array([r for _, r in rows[i : i + size]], pa.int64()), "key": pa.array([x for x, _ in rows[i : i + size]], pa.int64())}) for i in range(0, len(rows), size)]
        got = [(key, rep) for b in line_dedup._meeting(iter(batches)) for key, rep in zip(b.column("key").to_pylist(), b.column("rep").to_pylist())]
        assert got == want


def test_line_bands_recall(spark):
    """Pairs of lines at a similarity of 0.8 or a little more meet in a band as often as independent values would, at
    every length and across the bounds of the two ways, with shingles that repeat and without."""
    rng = random.Random(11)
    k, pairs = line_dedup.SHINGLE, []
    shingles = lambda x: {x[i : i + k] for i in range(len(x) - k + 1)}
    for least, most, times in ((8, 20, 1), (60, 130, 1), (125, 160, 1), (150, 205, 1), (190, 260, 1), (250, 500, 1), (30, 80, 6)):
        found = 0
        while found < 600:
            a = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=k + rng.randint(least, most)))
            b = a[: len(a) - rng.randint(1, max(4, len(a) // 5))]
            b = b * rng.randint(1, times) if times > 1 else b
            both, union = len(shingles(a) & shingles(b)), len(shingles(a) | shingles(b))
            if 0.8 <= both / union <= 0.85:
                pairs.append((a, b))
                found += 1
    table = spark.createDataFrame([(2 * i + s, x) for i, p in enumerate(pairs) for s, x in enumerate(p)], "h1 long, line string")
    bands = line_dedup.line_bands(table)
    keys = bands.select("rep", F.explode("keys").alias("key")).withColumn("pair", F.expr("rep div 2")).groupBy("pair", "key").agg(F.countDistinct("rep").alias("n")).where("n = 2")
    got = Counter(r.pair // 600 for r in keys.select("pair").distinct().collect())
    assert all(got[i] >= 0.99 * 600 for i in range(7)), got
    met = line_dedup.sketched(keys.selectExpr("2 * pair as rep", "key", "pair").unionByName(keys.selectExpr("2 * pair + 1 as rep", "key", "pair")), bands)
    apart = met.groupBy("pair", "key").agg(F.bit_count(reduce(lambda a, b: a.bitwiseOR(b), [F.bit_xor(s) for s in line_dedup.SKETCH])).alias("n")).groupBy("pair").agg(F.min("n").alias("n"))
    assert apart.where(F.col("n") > line_dedup.DIFFER).count() <= 2


def test_line_marks_keep_like_pairs(spark):
    """Marks of lines at a similarity of 0.8 or more, of any length, never rule the pair out, and mostly do so at 0.65."""
    rng, k, pairs = random.Random(14), line_dedup.SHINGLE, []
    while len(pairs) < 900:
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(int(rng.choice([30, 120, 300, 700, 2500]) * rng.uniform(0.7, 1.3)))).strip()
        other, edits = list(line), max(1, int(len(line) * rng.uniform(0.01, 0.05)))
        for _ in range(edits):
            other[rng.randrange(len(other))] = rng.choice("abcdefghijklmnopqrstuvwxyz")
        a, b = ({x[i : i + k] for i in range(max(1, len(x) - k + 1))} for x in (line, "".join(other)))
        similar = len(a & b) / len(a | b)
        if 0.8 <= similar < 0.83 or 0.6 <= similar < 0.65 and len(line) < 700:
            pairs.append((line, "".join(other), similar))
    table = spark.createDataFrame([(2 * i + s, p[s]) for i, p in enumerate(pairs) for s in (0, 1)], "h1 long, line string")
    bands = line_dedup.line_bands(table)
    one = line_dedup.marked(table.selectExpr("h1 as rep"), bands)
    two = one.select(*[F.col(c).alias(f"{c}2") for c in one.columns])
    met = one.join(two, (F.col("rep2") == F.col("rep") + 1) & (F.col("rep") % 2 == 0)).where(line_dedup.marks_close(F.col, lambda c: F.col(f"{c}2")))
    kept = {r.rep // 2 for r in met.select("rep").collect()}
    like = {i for i, p in enumerate(pairs) if p[2] >= 0.8}
    assert len(like) > 100 and like <= kept
    assert len(kept - like) < 0.05 * (len(pairs) - len(like))


def test_line_pairs_below_the_bound_are_not_compared_in_full(spark, monkeypatch):
    """Lines that share many shingles but are not alike are told apart by their marks, not pair by pair by their texts."""
    rng = random.Random(15)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(320)).strip() + "z"

    def edited(line, n):
        line = list(line)
        for i in range(n):  # apart, so that each takes five shingles
            line[i * (len(line) // n) + rng.randrange(len(line) // n - 5)] = rng.choice("0123456789")
        return "".join(line)

    lines = [edited(base, 7) for _ in range(90)]
    copies = [edited(x, 1) for x in lines[:20]]
    compared, full = [], line_dedup._like
    monkeypatch.setattr(line_dedup, "_like", lambda pairs, *rest: compared.append(pairs.count()) or full(pairs, *rest))
    rows = spark.createDataFrame(list(enumerate(lines + copies)), "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.dedup_lines(rows).where("n_removed > 0").collect()}
    assert gone == set(range(90, 110))
    assert sum(compared) < 10 * len(lines + copies)


def test_mixing(docs, rows):
    got = mixing.mix(docs, block_words=16).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    targets = {r.source: (r.target, r.source_size) for r in got}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * total)
    for s, (t, n) in targets.items():
        assert t <= 2 * n + 1e-6
        assert sum(r.taken for r in got if r.source == s) == pytest.approx(t, abs=1)
    # water level: uncapped sources share one level by weight
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(targets, key=lambda s: (s is None, s or "")))}
    level = {round(t / weight[s], 6) for s, (t, n) in targets.items() if t < 2 * n - 1e-6}
    assert len(level) <= 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs, block_words=16).collect()), key=str)


def test_fingerprint(spark, docs, rows):
    got = fingerprint.edited_report(docs).collect()
    assert len(got) == len(rows)
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for i, (doc_id, t) in enumerate(ordered):
        k = len(t) // 4
        edited = t[: len(t) - k] + ordered[(i + 1) % len(ordered)][1][:k]
        want[(doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    t = spark.createDataFrame([("Straße  É\n",), ("STRASSE é",), ("ﬁn",), ("fin",), (None,), ("",)], "text string")
    f = [r.fingerprint for r in fingerprint.fingerprints(t).collect()]
    assert len(set(f)) == 3


def test_packing(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, 64).collect()
    pieces = Counter()
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)] if len(ids) > 64 else [0, len(ids)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            pieces[(i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == pieces
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(by) <= 1.05 * sum(r.length for r in got) / 64 + 1


def test_encoder_is_exact():
    e = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ["", " ", " a", "a ", "a  b", "a \n b", "x\ty z  q", "a <|endoftext|> b", "it's we'll 'tis", "a b c", "\n\nfoo bar \n", "12 a1 !! ?a é ß 中 文", "a　b\x85c d"]:
        assert np.frombuffer(e(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_plan_is_best_on_small_instances():
    rng = random.Random(5)
    for _ in range(60):
        counts = Counter(rng.randint(1, 10) for _ in range(rng.randint(0, 9)))
        items = sorted(counts.elements(), reverse=True)

        def best(left, bins):
            if not left:
                return len(bins)
            tries = {tuple(sorted(b + (i == k) * left[0] for i, b in enumerate(bins))) for k in range(len(bins)) if bins[k] + left[0] <= 10}
            return min([best(left[1:], (*bins, left[0])), *(best(left[1:], t) for t in tries)])

        got = packing.plan(counts, 10)
        assert Counter(x for content, n in got for x in content * n) == +counts
        assert sum(n for _, n in got) <= best(items, ()) + 1


def test_quality(spark, docs, rows):
    got = quality_rules.quality_report(docs, spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)

    def want(t):
        t = t or ""
        w = WORD.findall(t)
        runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        again = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)

    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((r[0], *want(r[1])) for r in rows)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    assert quality_rules.binomial_tail(0, 100, 0.02) == pytest.approx(0.98**100)
    assert quality_rules.binomial_tail(2, 5, 0.5) == pytest.approx(0.5)


def test_classifier(spark, docs, rows):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = perplexity.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(r.kept is False for r in got if r.n_chars == 0)
    letters, model = perplexity.train(docs)
    p = np.exp2(perplexity.dense(model.toArrow())).reshape(-1, perplexity.SYMBOLS).sum(axis=1)
    assert np.allclose(p, 1, atol=1e-4) and len(letters) <= perplexity.SYMBOLS - 2
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert perplexity.classify(docs, none).count() == len(rows)


def test_classifier_has_no_vocabulary_cap(spark):
    """Perplexities against a plain Kneser-Ney model over all code points, in five scripts, with a small and no cache."""
    rng = random.Random(13)
    scripts = ["abcdefghij", "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x3B1, 0x3C9))), "".join(map(chr, range(0x4E00, 0x4E80))), "\U0001f600\U0001f601"]
    words = [["".join(rng.choices(s, k=4)) for _ in range(12)] for s in scripts]
    good = [" ".join(rng.choices(words[i % 5], k=30)) for i in range(60)]
    junk = ["".join(rng.choices(s, k=120)) for s in scripts[1:4]] + ["\u0e01\u0e02\u0e03" * 20, "0", ""]
    texts = good + junk + [None, good[0]]
    start, size = perplexity.START, perplexity.ORDER
    grams = [{} for _ in range(size + 1)]
    for t in good:
        s = [start] * (size - 1) + [ord(c) for c in t]
        for i in range(size - 1, len(s)):
            g = tuple(s[i - size + 1 : i + 1])
            grams[size][g] = grams[size].get(g, 0) + 1
    for k in range(size - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    sums, cut = {}, {}
    for k in range(1, size + 1):
        c1, c2, c3, c4 = (sum(n == i for n in grams[k].values()) for i in (1, 2, 3, 4))
        y = c1 / (c1 + 2 * c2) if c1 + c2 else 0.5
        cut[k] = [min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) if a and b else 0.5 for i, a, b in ((1, c1, c2), (2, c2, c3), (3, c3, c4))]
        for g, n in grams[k].items():
            total, back = sums.get((k, g[:-1]), (0, 0.0))
            sums[k, g[:-1]] = (total + n, back + cut[k][min(n, 3) - 1])

    def prob(g):
        if not g:
            return 1 / perplexity.VOCABULARY
        k, n = len(g), grams[len(g)].get(g, 0)
        total, back = sums.get((k, g[:-1]), (1, 1.0))
        return ((n - cut[k][min(n, 3) - 1]) / total if n else 0) + back / total * prob(g[1:])

    def want(t):
        s = [start] * (size - 1) + [ord(c) for c in t or ""]
        bits = [np.log2(prob(tuple(s[i - size + 1 : i + 1]))) for i in range(size - 1, len(s))]
        return 2 ** -np.mean(bits) if bits else None

    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    letters, model = perplexity.train(docs.where(f"doc_id < {len(good)}"))
    for most in (perplexity.TAIL, 50):
        old, perplexity.TAIL = perplexity.TAIL, most
        try:
            got = {r.doc_id: r.perplexity for r in perplexity.scores(docs, letters, model).collect()}
        finally:
            perplexity.TAIL = old
        assert len(got) == len(texts)
        assert all(got[i] is None if want(t) is None else got[i] == pytest.approx(want(t), rel=1e-4) for i, t in enumerate(texts))
    assert min(got[len(good) + i] for i in range(3)) > 3 * max(got[i] for i in range(len(good)))


def test_classifier_rejects_junk(spark):
    """Labelled junk goes, trusted text stays; a language with few trusted documents has thresholds too."""
    rng = random.Random(14)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(300)]
    good = [" ".join(rng.choices(words, k=rng.randint(60, 120))) for _ in range(600)]
    odd = ["".join(rng.choices("qrstuvwxyz", k=300)) for _ in range(2)]  # trusted by mistake
    junk = [x for i in range(40) for x in ("the " * (50 + i), "".join(rng.choices("abcdefghijklmnop #!7", k=300)))]
    rows = [(i, t, "en" if i % 20 else "small") for i, t in enumerate([*good, *odd, *junk])]
    labels = [(i, int(i < 602), 0) for i in range(len(rows))]
    got = {r.doc_id: r for r in perplexity.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i].low is not None and got[i].high is not None for i in got)
    assert sum(got[i].kept for i in range(600)) >= 0.95 * 600
    assert sum(got[i].kept for i in range(602, len(rows))) <= 0.02 * len(junk)


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(i % 30, f"http://x/{i}", f"<p>é{i}</p>" * (i % 5)) for i in range(80)] + [(None, None, None)], "page_id long, url string, html string")
    records = warc.to_records(pages, 2000).collect()
    files = {}
    for r in sorted(records, key=lambda r: (r.file, r.offset)):
        files[r.file] = files.get(r.file, b"") + r.record.encode()
    assert len(files) > 2
    for f, data in files.items():
        assert [(a, b) for a, b, *_ in warc.parse(data)] == [(r.offset, r.length) for r in sorted(records, key=lambda r: r.offset) if r.file == f]
        (tmp_path / f"{f}.warc").write_bytes(data)
    assert warc.read_warc(spark, str(tmp_path)).count() == 81
    replica = warc.to_records(pages, 2000).withColumn("record", F.when(F.col("page_id") == 7, F.lit("bad")).otherwise(F.col("record")))
    got = warc.fixity(pages, replica, 2000).collect()
    assert len(got) == 81 and {r.page_id for r in got if r.status == "corrupt"} == {7} and {r.status for r in got} == {"ok", "corrupt"}
    one = spark.createDataFrame([(i, f"http://y/{i}", "<p>" * 9) for i in range(100)], "page_id long, url string, html string")
    whole = warc.to_records(one)
    status = lambda ours, replica: Counter((r.page_id, r.status) for r in warc.fixity(ours, replica).collect() if r.status != "ok")
    assert status(one, whole) == {}
    assert status(one, whole.where("page_id != 40")) == {(40, "extra"): 1}
    assert status(one.where("page_id != 99"), whole) == {(99, "missing"): 1}
    late = warc.to_records(one.where("page_id != 40"))  # later records stand at other offsets
    assert status(one, late) == {(40, "extra"): 1} | {(i, "shifted"): 1 for i in range(41, 100)}
    assert status(one.where("page_id != 40"), whole) == {(40, "missing"): 1} | {(i, "shifted"): 1 for i in range(41, 100)}
    assert status(one, whole.limit(0)) == {(i, "extra"): 1 for i in range(100)}
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort"))


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    for df in (near_dedup.near_duplicates(empty), line_dedup.dedup_lines(empty), mixing.mix(empty), fingerprint.edited_report(empty), packing.pack_documents(empty, path), quality_rules.quality_report(empty, labels), suffix_dedup.remove_repeated_bytes(empty), substring_dedup.remove_repeated_words(empty), perplexity.classify(empty, labels)):
        assert df.count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.fixity(pages, warc.to_records(pages)).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(None, 1), (5, 5)] + [(i, i + 1) for i in range(100, 140)]
    nodes = sorted({x for e in edges for x in e if x is not None})
    linked = {frozenset(e) for e in edges}
    want = roots(nodes, lambda a, b: frozenset((a, b)) in linked)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got and all(want[n] == c for n, c in got.items())
    assert {n for n in nodes if want[n] != n} <= set(got)


def test_kernels():
    text = ["a bb  ccc", "", "x"]
    data = "".join(text).encode()
    start, end, value, first = K.words(np.frombuffer(data, np.uint8), np.array([0, 9, 9, 10]))
    assert [data[a:b] for a, b in zip(start, end, strict=True)] == [b"a", b"bb", b"ccc", b"x"] and first.tolist() == [0, 3, 3, 4] and len(set(value.tolist())) == 4
