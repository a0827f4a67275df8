"""Substring dedup: repeated runs of words, found by matching statistics against suffix automata."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tickloom.llm.repeats import Kind, remove_repeats


class Automaton:
    """Suffix automaton of several sequences; each state knows how many places its strings end at."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, count: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        self.count.append(count)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, 0, self.next[q].copy())
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int]) -> None:
        moves, link, length, last = self.next, self.link, self.length, 0
        for c in sequence:
            q = moves[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                self.count[last] += 1
                continue
            new = self._state(length[last] + 1, 1, {})
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = new

    def finish(self) -> None:
        """Adds up the places along suffix links, longest strings first."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def statistics(self, sequence: list[int], times: int = 2, most: int | None = None) -> tuple[list[int], list[int]]:
        """Matching statistics: for each place the length of the longest string ending there that ends at `times` places
        or more (at most `most`), and its state."""
        moves, link, length, count = self.next, self.link, self.length, self.count
        lengths, states, v, n = [], [], 0, 0
        for c in sequence:
            q = moves[v].get(c)
            while v and (q is None or count[q] < times):
                v = link[v]
                n = length[v]
                q = moves[v].get(c)
            if q is not None and count[q] >= times:
                v, n = q, n + 1
                if most is not None and n > most:  # the last `most` symbols may belong to a shorter state
                    n = most
                    while length[link[v]] >= n:
                        v = link[v]
            else:
                n = 0
            lengths.append(n)
            states.append(v)
        return lengths, states


def named_runs(symbols: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """For each symbol a name of the run of n symbols from it, equal for equal runs and no others; -1 where fewer are left.

    The pieces, reversed, are the automaton's reference; each is streamed through it again for matching statistics. A
    state has one string of each length at most, so the state that n symbols lead to names them.
    """
    values, begin, pieces = symbols.tolist(), 0, []
    for end in ends.tolist():
        pieces.append(values[begin:end][::-1])
        begin = end
    automaton = Automaton()
    for x in pieces:
        automaton.add(x)
    automaton.finish()
    out: list[int] = []
    for x in pieces:
        lengths, states = automaton.statistics(x, 1, n)
        out.extend(v if m >= n else -1 for m, v in zip(reversed(lengths), reversed(states), strict=True))
    return np.array(out, np.int64)


#: 35 words, screened by grams of 8 words, indexed in blocks of 5.
WORDS = Kind(by_word=True, window=35, gram=8, block=5, index=named_runs)


def remove_repeated_words(docs: DataFrame, kind: Kind = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256, kept: the words outside repeated windows, joined by spaces."""
    return remove_repeats(docs, kind).withColumnRenamed("n_units", "n_words")
