"""Stretches of words that repeat with a period: a suffix automaton whose link tree is read by link-cut access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from textmeter.llm.common import derive

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: A stretch is looked at so often for words that cannot lie in a run; what is left then is searched as it is.
ROUNDS = 8
#: Odd factor of the 64-bit hash of word groups.
FACTOR = 0x9E3779B97F4A7C15


# --- the words that can lie in a run -----------------------------------------

def necessary_groups(min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """(k, times): inside a run every group of k neighbouring words occurs so often at least.

    A run of period q has max(min_length, min_exponent * q) words or more, so a
    group that begins r < q words behind its start recurs every q words up to
    the end. The longest groups that occur twice, and the longest that occur
    three times, if there are any.
    """
    def times(k: int) -> int:
        return min((max(min_length, min_exponent * q) - k - (q - 1)) // q + 1 for q in range(1, min_length + 2))

    found = []
    for least in (2, 3):
        k = max((k for k in range(1, min_length + 1) if times(k) >= least), default=0)
        if k:
            found.append((k, least))
    return found


def stretches(words: np.ndarray, min_length: int, min_exponent: int) -> Iterator[tuple[int, int]]:
    """(first, end) of the parts of the text outside of which no run can lie, ascending.

    Word groups that occur too rarely cut the text, and the parts are judged
    anew by themselves. Equal hashes of unlike groups only keep more.
    """
    groups = necessary_groups(min_length, min_exponent)
    todo = [(0, len(words), 0)]
    while todo:
        first, end, rounds = todo.pop()
        if end - first < min_length:
            continue
        for k, least in groups if rounds < ROUNDS else ():
            n = end - first - k + 1
            key = np.zeros(n, "u8")
            for i in range(k):
                key = key * np.uint64(FACTOR) + words[first + i:first + i + n]
            order = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
            often = np.empty(n, bool)
            sizes = np.diff(np.append(new, n))
            often[order] = np.repeat(sizes >= least, sizes)
            if not often.all():
                edges = np.flatnonzero(np.diff(np.concatenate(([False], often, [False])).astype("i1")))
                parts = [(first + int(a), first + int(b) + k - 1, rounds + 1) for a, b in zip(edges[::2], edges[1::2])]
                todo.extend(reversed(parts))
                break
        else:
            yield first, end


# --- the automaton -----------------------------------------------------------

def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, link, prefix): longest word group and suffix link of each state, and the state of each prefix."""
    length, link, after, prefix = [0], [-1], [{}], []
    last = 0
    for word in words:
        state = len(length)
        length.append(length[last] + 1), link.append(0), after.append({}), prefix.append(state)
        at = last
        while at >= 0 and word not in after[at]:
            after[at][word] = state
            at = link[at]
        if at >= 0:
            target = after[at][word]
            if length[target] == length[at] + 1:
                link[state] = target
            else:
                copy = len(length)
                length.append(length[at] + 1), link.append(link[target]), after.append(after[target].copy())
                while at >= 0 and after[at].get(word) == target:
                    after[at][word] = copy
                    at = link[at]
                link[target] = link[state] = copy
        last = state
    return length, link, prefix


class LastEnds:
    """For each node of a tree the last moment something below it was visited, kept on paths.

    A link-cut forest: each preferred path is a splay tree ordered by depth, and
    the moment stands at that tree's root. ``visit`` walks from a node to the
    tree's root, takes what it passes out of the paths it lay on, and makes all
    of it one path of the present moment.
    """

    def __init__(self, parent: list[int]):
        # Nodes count from one; zero is none.
        self.up = [0, *(p + 1 for p in parent)]
        self.left, self.right = [0] * len(self.up), [0] * len(self.up)
        self.moment = [-1] * len(self.up)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            up[inner] = p
        up[p], up[x] = x, g
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x

    def _to_root(self, x: int) -> int:
        """Splay the node; the moment of its path."""
        up, left, right, rotate = self.up, self.left, self.right, self._rotate
        r = x
        while (p := up[r]) and (left[p] == r or right[p] == r):
            r = p
        moment = self.moment[r]
        while x != r:
            p = up[x]
            if p == r:
                rotate(x)
                break
            g = up[p]
            rotate(p if (left[p] == x) == (left[g] == p) else x)
            rotate(x)
            if g == r:
                break
        self.moment[x] = moment
        return moment

    def visit(self, node: int, moment: int) -> list[tuple[int, int]]:
        """(deepest node, last moment) of each path segment from the node to the root that was visited before."""
        up, right = self.up, self.right
        below, x = 0, node + 1
        passed = []
        while x:
            before = self._to_root(x)
            if right[x]:
                self.moment[right[x]] = before
            right[x] = below
            if before >= 0:
                passed.append((x - 1, before))
            below, x = x, up[x]
        self.moment[below] = moment
        return passed


# --- runs --------------------------------------------------------------------

def runs_of(words: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run of a row of word numbers, by start and period.

    Each word appended visits its prefix's state. A segment passed there, with
    longest group h, ended last d words before: the h + d words up to here have
    period d, and no smaller one, since that would be a later end. A run of
    period d shows by h >= (min_exponent - 1) * d at the latest when its first
    min_exponent periods are complete, and is extended once to both sides.
    """
    found = []
    for first, end in stretches(words, min_length, min_exponent):
        row = words[first:end].tolist()
        length, link, prefix = suffix_automaton(row)
        ends, known = LastEnds(link), {}
        for at, state in enumerate(prefix):
            for node, before in ends.visit(state, at):
                period = at - before
                if length[node] < (min_exponent - 1) * period or at < known.get(period, 0):
                    continue
                a, b = at + 1 - length[node] - period, at + 1
                while a and row[a - 1] == row[a - 1 + period]:
                    a -= 1
                while b < len(row) and row[b] == row[b - period]:
                    b += 1
                known[period] = b
                if b - a >= max(min_length, min_exponent * period):
                    found.append((first + a, b - a, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def split_words(text: str) -> list[bytes]:
    """Words between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split()


def numbered(words: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), "u8", len(words))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by blanks, each run cut to its first period."""
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period:start + length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words).decode("utf-8", "surrogatepass")


RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
_FIELDS = StructType([StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])
_TYPES = [pa.list_(pa.struct([(c, pa.int64()) for c in RUN.names])), pa.string()]


def find_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``docs`` without its text, with ``runs`` and ``collapsed``.

    A run is a stretch of words with smallest period q, of ``min_length`` words
    and ``min_exponent`` * q words at least, that no neighbouring word extends;
    ``runs`` has (start, length, period) of each, counted in words from 0, by
    start and period. Words stand between ASCII white space and must be equal
    byte for byte. ``collapsed``: the words joined by single blanks, without those
    that lie in a run behind its first period.

    Each text is searched whole, by itself: nothing is shuffled, and equal texts
    or frequent words are no group. Memory follows the longest text. A null,
    empty or blank text has no runs and is empty when collapsed. Repeated rows
    come back each; null keys and other columns pass through; columns named
    ``runs`` or ``collapsed`` are replaced. An empty table gives an empty table.
    """
    if min_length < 2 or min_exponent < 2:
        raise ValueError("a run has two words and two periods at least")

    def search(value: str) -> tuple:
        words = split_words(value)
        runs = runs_of(numbered(words), min_length, min_exponent)
        return [dict(zip(RUN.names, r)) for r in runs], collapse(words, runs)

    return derive(docs, text, _FIELDS, _TYPES, search)


def longest_run(runs: Column) -> Column:
    """The longest run; of equal ones the first, then that of the smaller period. Null without a run."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["l"].alias("length"), (-best["p"]).alias("period")))
