"""Runs: stretches of words that repeat with a period, found by their Lyndon roots."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fanplume.llm.common import map_columns, rolled, words_of

RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def lyndon_array(codes: Sequence[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each position, by the first phase of Baier's suffix sorter.

    Suffixes are grouped by a prefix that starts as their first symbol. Groups are taken from the greatest to the
    least; by then the prefix w of a group is the longest Lyndon word there. The nearest position before, all between
    being greater or equal, takes in each w that follows it, and moves to a new group just above its old one: the more
    it took in, the higher. No suffix is ever compared. Each position is taken once and takes part in at most one move.
    """
    n = len(codes)
    if not n:
        return []
    length = [1] * n
    order = sorted(set(codes))
    number = {c: k + 1 for k, c in enumerate(order)}
    group = [number[c] for c in codes]
    members: list[list[int]] = [[] for _ in range(len(order) + 1)]
    for i, g in enumerate(group):
        members[g].append(i)
    # Groups as a linked list; 0 is below all.
    below = [0, *range(len(order))]
    above = [*range(1, len(order) + 1), 0]
    left = list(range(-1, n))  # left[i + 1]: a position at or before i, with none between that isn't done
    done = bytearray(n)
    g = len(order)
    while g:
        own = [i for i in members[g] if group[i] == g]
        members[g] = []
        for i in own:
            done[i] = 1
        took: dict[int, int] = {}
        for i in own:
            p = left[i]
            if p >= 0 and done[p]:
                path = [i]
                while p >= 0 and done[p]:
                    path.append(p)
                    p = left[p]
                for x in path:
                    left[x] = p
            if p >= 0:
                took[p] = took.get(p, 0) + 1
        if took:
            w = length[own[0]]
            moves: dict[tuple[int, int], list[int]] = {}
            for p, k in took.items():
                length[p] += k * w
                moves.setdefault((-k, group[p]), []).append(p)
            for (_, old), moved in sorted(moves.items()) if len(moves) > 1 else moves.items():
                new, top = len(members), above[old]
                members.append(moved)
                below.append(old)
                above.append(top)
                above[old] = new
                if top:
                    below[top] = new
                for p in moved:
                    group[p] = new
        g = below[g]
    return length


class Equal:
    """How far two positions of a sequence agree, exactly: equal blocks of 2^k symbols have equal numbers."""

    def __init__(self, codes: np.ndarray) -> None:
        self.n, self.levels = len(codes), [np.unique(codes, return_inverse=True)[1].astype(np.int64)]
        while (size := 1 << len(self.levels)) <= self.n // 2:  # runs and their repeats are never longer than half
            last = self.levels[-1]
            pairs = last[: self.n - size + 1] * (int(last.max()) + 1) + last[size // 2 : self.n - size // 2 + 1]
            self.levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The number of symbols from `i` on that equal those from `j` on, for i < j."""
        i, j, found = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        top = len(self.levels) - 1
        again = np.ones(len(i), bool)
        while again.any():  # whole blocks of the largest size first
            again &= j + (1 << top) <= self.n
            again[again] = self.levels[top][i[again]] == self.levels[top][j[again]]
            for x in (i, j, found):
                x[again] += 1 << top
        for k in range(top)[::-1]:
            fits = np.flatnonzero(j + (1 << k) <= self.n)
            fits = fits[self.levels[k][i[fits]] == self.levels[k][j[fits]]]
            for x in (i, j, found):
                x[fits] += 1 << k
        return found

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The number of symbols before `i` that equal those before `j`, for i < j."""
        i, j, found = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        top = len(self.levels) - 1
        again = np.ones(len(i), bool)
        while again.any():
            again &= i >= 1 << top
            again[again] = self.levels[top][i[again] - (1 << top)] == self.levels[top][j[again] - (1 << top)]
            for x, sign in ((i, -1), (j, -1), (found, 1)):
                x[again] += sign << top
        for k in range(top)[::-1]:
            fits = np.flatnonzero(i >= 1 << k)
            fits = fits[self.levels[k][i[fits] - (1 << k)] == self.levels[k][j[fits] - (1 << k)]]
            for x, sign in ((i, -1), (j, -1), (found, 1)):
                x[fits] += sign << k
        return found


def runs_of(codes: np.ndarray, least: int = 1) -> np.ndarray:
    """All runs of a sequence of at least `least` symbols, as rows of start, length and smallest period, in order.

    Each run holds a Lyndon word of its period's length under the order of the symbols or under its reverse, and that
    is the longest one at its position. So extending all of them both ways as far as the period holds gives all runs.
    """
    n = len(codes)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    at, equal, found = np.arange(n), Equal(codes), []
    for signed in (codes, -codes):
        period = np.array(lyndon_array(signed.tolist()), np.int64)
        roots = at[at + period < n]
        p = period[roots]
        # A run of two periods goes on behind the root or before it.
        roots = roots[(codes[roots + p] == codes[roots]) | ((roots > 0) & (codes[roots - 1] == codes[roots + p - 1]))]
        p = period[roots]
        before, behind = equal.back(roots, roots + p), equal.ahead(roots, roots + p)
        length = before + p + behind
        good = length >= np.maximum(2 * p, least)
        found.append(np.stack([roots - before, length, p], 1)[good])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def stretches(codes: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """Where runs of at least twice `gram` symbols can be: the maximal stretches of symbols covered by `gram` in a row
    that occur again in the sequence. Such a run has a repeat of `gram` symbols at each end, and they cover it."""
    if len(codes) < 2 * gram:
        return []
    hashes = rolled(codes.astype(np.uint64), gram)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return []
    marks = np.zeros(len(codes) + 1, np.int64)
    twice = np.zeros(len(hashes), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + gram, -1)
    inside = np.concatenate([[False], np.cumsum(marks[:-1]) > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= 2 * gram]


def runs_of_text(words: list[bytes], least: int = 12) -> np.ndarray:
    """The runs of at least `least` words in a text, as rows of start, length and smallest period, in order."""
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    found = [np.zeros((0, 3), np.int64)]
    for a, b in stretches(codes, max(1, least // 2)):
        part = runs_of(np.unique(codes[a:b], return_inverse=True)[1].astype(np.int64), least)
        part[:, 0] += a
        found.append(part)
    return np.concatenate(found)


def find_runs(docs: DataFrame, text_col: str = "text", least: int = 12) -> DataFrame:
    """Find the periodic runs of every text, and the text without their repeats.

    A run is a maximal stretch of words with smallest period q that holds at least two periods and `least` words. Words
    are what white space (space, tab, LF, VT, FF, CR) separates. A text is one task's work, in memory that grows with
    that text alone; nothing is shuffled. Only stretches of words that occur again are searched for runs, which finds
    all of them.

    Returns the columns of `docs` plus n_words, runs (start in words, length, period; by start, then period) and
    collapsed (the words that no run holds behind its first period, joined by one space); columns of those names are
    replaced. Null, empty and blank texts have no words, no runs and an empty collapsed text; ids don't matter, so null
    and repeated ones, and repeated rows, are each judged alone. An empty table gives an empty one.
    """

    def rows(texts: list[str | None]) -> tuple[list, list, list]:
        counts, runs, kept = [], [], []
        for text in texts:
            words = words_of(text)
            own = runs_of_text(words, least)
            if len(own):
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, own[:, 0] + own[:, 2], 1)
                np.add.at(gone, own[:, 0] + own[:, 1], -1)
                words_kept = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
            else:
                words_kept = words
            counts.append(len(words))
            runs.append([{"start": s, "length": m, "period": q} for s, m, q in own.tolist()])
            kept.append(b" ".join(words_kept).decode("utf-8", "surrogatepass"))
        return counts, runs, kept

    made = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUN), T.StructField("collapsed", T.StringType())]
    return map_columns(docs, [text_col], made, rows)
