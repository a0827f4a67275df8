"""Suffix-array dedup: repeated byte strings, found by a linear grouping construction of the suffix array."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tickloom.llm.repeats import Kind, remove_repeats


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of non-negative integers, by Baier's grouping.

    Phase 1 groups suffixes by their Lyndon prefix: groups, at first of equal first symbols, are processed in
    descending order; each member points to the previous smaller position, and positions pointed to l times move to a
    group of their own above their old one, more often ones higher. Phase 2 emits each group's order from left to
    right along the same pointers. Nothing is renamed or sorted recursively.
    """
    text = [x + 1 for x in text] + [0]
    n = len(text)
    array = sorted(range(n), key=text.__getitem__)
    place, group, last = [0] * n, [0] * n, [0] * n
    begin = 0
    for k, i in enumerate(array):
        place[i] = k
        if text[i] != text[array[begin]]:
            begin = k
        group[i] = begin
        last[begin] = k
    previous = [-1] * n
    high = n - 1
    while high > 0:
        own = group[array[high]]
        pointed: dict[int, int] = {}
        members = (array[high],) if own == high else sorted(array[own : high + 1])
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= own:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if len(pointed) == 1:
            levels = [list(pointed)]
        else:
            by_count: dict[int, list[int]] = {}
            for j, c in pointed.items():
                by_count.setdefault(c, []).append(j)
            levels = [by_count[c] for c in sorted(by_count, reverse=True)]
        for level in levels:
            for j in level:  # to the back of its group
                g = group[j]
                back, at = last[g], place[j]
                other = array[back]
                array[at], array[back] = other, j
                place[other], place[j] = at, back
                last[g] = back - 1
            old_end: dict[int, int] = {}
            for j in level:
                g = group[j]
                old_end[g] = max(old_end.get(g, 0), place[j])
            for j in level:
                g = group[j]
                new = last[g] + 1
                group[j] = new
                if new != g:
                    last[new] = old_end[g]
                else:
                    old_end.setdefault(g, place[j])
            for g, end in old_end.items():
                if last[g] < g:  # the whole group moved: it stays what it was
                    last[g] = end
        high = own - 1
    out, done = [0] * n, [False] * n
    out[0] = n - 1
    done[n - 1] = True
    free = group[:]  # by group: its next free place
    next_free = {g: g for g in set(free)}
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[next_free[g]] = j
            next_free[g] += 1
            done[j] = True
            j = previous[j]
    return out[1:]


def named_runs(symbols: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """For each symbol a name of the run of n symbols from it, equal for equal runs and no others; -1 where fewer are left.

    Suffix array of all pieces, each closed by a common symbol, and the common prefixes of neighbours (Kasai): suffixes
    that share n symbols are neighbours, and where neighbours share fewer a new name begins.
    """
    names = np.full(len(symbols), -1, np.int64)
    if not len(symbols):
        return names
    text, starts, left = [], [], []
    begin = 0
    values = (symbols + 1).tolist()
    for end in ends.tolist():
        starts.extend(range(len(text), len(text) + end - begin))
        left.extend(range(end - begin, 0, -1))
        text.extend(values[begin:end])
        text.append(0)
        begin = end
    order = suffix_array(text)
    size = len(text)
    rank = [0] * size
    for k, i in enumerate(order):
        rank[i] = k
    common = [0] * (size + 1)  # of order[k] and order[k - 1]
    h = 0
    for i in range(size):
        k = rank[i]
        if not k:
            h = 0
            continue
        j = order[k - 1]
        while i + h < size and j + h < size and text[i + h] == text[j + h]:
            h += 1
        common[k] = h
        if h:
            h -= 1
    name = np.cumsum(np.array(common[:-1]) < n)
    whole = np.array(left) >= n
    names[whole] = name[np.array(rank)[starts][whole]]
    return names


#: 200 bytes, screened by grams of 32 bytes, indexed in blocks of 32.
BYTES = Kind(by_word=False, window=200, gram=32, block=32, index=named_runs)


def remove_repeated_bytes(docs: DataFrame, kind: Kind = BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept: texts as UTF-8 bytes without their repeated strings."""
    return remove_repeats(docs, kind).withColumnRenamed("n_units", "n_bytes")
