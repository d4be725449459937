"""Similarities of strings and token sets in [0, 1]; with an empty side they are 0.

Only the length of the longest common subsequence leaves the JVM, in Arrow batches; ratios are expressions on it.
"""

from __future__ import annotations

from operator import contains, eq

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import joined, sorted_tokens, words


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a column of bits at a time."""
    if a == b:
        return len(a)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = state = (1 << len(a)) - 1
    for c in b:
        if m := state & where.get(c, 0):
            state = (state + m | state - m) & full
    return len(a) - state.bit_count()


#: Longer strings go through ``lcs`` one by one.
_LONGEST = 256
#: Entries of a table of masks: what fits a processor's cache.
_TABLE = 1 << 17


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of code points for each string, zeros behind its end, and the lengths."""
    n = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    out = np.zeros((len(strings), int(n.max(initial=0)) or 1), dtype=np.uint32)
    out[np.arange(out.shape[1]) < n[:, None]] = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype="<u4") + 1
    return out, n


class _Masks:
    """For each row of ``a`` and each character a number with a bit for each place; words of 64 bits. ``b``: the other side as columns of the table."""

    def __init__(self, a: np.ndarray, n: np.ndarray, b: np.ndarray) -> None:
        rows, self.words = len(a), (int(n.max()) + 63) // 64
        column = np.zeros(int(max(a.max(), b.max())) + 1, dtype=np.int64)
        column[a] = 1
        column[0] = 0
        there = np.flatnonzero(column)
        column[there] = np.arange(1, len(there) + 1)
        self.wide = len(there) + 1  # column 0: what isn't in a
        self.base = np.arange(rows, dtype=np.int64) * self.wide
        self.bits = np.zeros((self.words, rows * self.wide), dtype=np.uint64)
        coded = column[a]
        for i in range(a.shape[1]):
            k = np.flatnonzero(n > i)
            self.bits[i // 64, self.base[k] + coded[k, i]] |= np.uint64(1 << i % 64)
        self.b = column[b]
        self.own = np.zeros((self.words, rows), dtype=np.uint64)
        for w in range(self.words):
            left = np.clip(n - 64 * w, 0, 64)
            self.own[w] = np.where(left == 64, ~np.uint64(0), (np.uint64(1) << (left % 64).astype(np.uint64)) - np.uint64(1))

    def start(self, rows: int) -> np.ndarray:
        return np.full((self.words, rows), ~np.uint64(0))

    def step(self, state: np.ndarray, at: np.ndarray) -> None:
        """One more character of the other side, at these places of the table; the first len(at) rows of ``state`` move."""
        k, carry = len(at), None
        for w in range(self.words):
            x = state[w, :k]
            m = self.bits[w].take(at)
            kept = x & ~m
            m &= x
            added = x + m
            if self.words > 1:
                over = added < x
                if carry is not None:
                    added += carry
                    over |= added < carry
                carry = over.astype(np.uint64)
            np.bitwise_or(added, kept, out=x)

    def length(self, state: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Of the common subsequences so far."""
        return np.bitwise_count(~state & self.own[:, rows]).sum(axis=0, dtype=np.int64)


def _chunks(x: list[str], y: list[str], order: np.ndarray, longest: np.ndarray):  # noqa: ANN202
    """Rows of similar lengths, so many at once that their table of masks stays small."""
    order = order[np.argsort(longest[order], kind="stable")]
    k = 0
    while k < len(order):
        size = 64
        symbols = len(set().union(*(x[i] for i in order[k : k + size]))) + 1
        size = max(size, min(4096, _TABLE // (symbols * ((int(longest[order[k]]) + 63) // 64))))
        rows = order[k : k + size]
        yield rows, [x[i] for i in rows], [y[i] for i in rows]
        k += size


def _distinct(a: pd.Series, b: pd.Series) -> tuple[list[str], list[str], np.ndarray]:
    """Distinct pairs, the shorter string first, and each row's."""
    seen: dict[tuple[str, str], int] = {}
    which = [seen.setdefault((x or "", y or ""), len(seen)) for x, y in zip(a, b, strict=True)]
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in seen]
    return [x for x, _ in pairs], [y for _, y in pairs], np.array(which, dtype=np.int64)


def lcs_lengths(x: list[str], y: list[str]) -> np.ndarray:
    """``lcs`` of many pairs, the shorter string first: all of a chunk take each step together."""
    n, m = (np.fromiter(map(len, s), dtype=np.int64, count=len(s)) for s in (x, y))
    equal = np.fromiter(map(eq, x, y), dtype=bool, count=len(x))
    out = np.where(equal, n, 0)
    short = (n > 0) & ~equal & (n <= _LONGEST) & (m <= 4 * _LONGEST)
    for i in np.flatnonzero(~short & ~equal & (n > 0)):
        out[i] = lcs(x[i], y[i])
    for rows, p, q in _chunks(x, y, np.flatnonzero(short), np.maximum(n, m)):
        by_end = np.argsort(-m[rows], kind="stable")
        rows, p, q = rows[by_end], [p[i] for i in by_end], [q[i] for i in by_end]
        (a, na), (b, nb) = _codes(p), _codes(q)
        masks = _Masks(a, na, b)
        state = masks.start(len(rows))
        active = np.searchsorted(-nb, -np.arange(b.shape[1]), side="left")  # rows that have a character there
        for j, k in enumerate(active):
            masks.step(state, masks.base[:k] + masks.b[:k, j])
        out[rows] = masks.length(state)
    return out


@F.pandas_udf(T.IntegerType())
def lcs_len(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y, which = _distinct(a, b)
    return pd.Series(lcs_lengths(x, y).astype("int32")[which])


def best_window(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer one, windows of its length and those cut off at either end."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    n, best = len(a), 0.0
    for i in range(1 - n, len(b)):
        w = b[max(0, i) : i + n]
        if 2 * min(n, len(w)) / (n + len(w)) > best:
            best = max(best, 2 * lcs(a, w) / (n + len(w)))
            if best == 1:
                break
    return best


def best_windows(x: list[str], y: list[str]) -> np.ndarray:
    """``best_window`` of many pairs, the shorter string first.

    Windows cut off at the left are what one pass has seen after each step, those at the right the same of the reversed strings;
    the whole ones between are rows of their own.
    """
    n, m = (np.fromiter(map(len, s), dtype=np.int64, count=len(s)) for s in (x, y))
    inside = np.fromiter(map(contains, y, x), dtype=bool, count=len(x)) & (n > 0)
    out = inside.astype(np.float64)
    short = (n > 0) & ~inside & (n <= _LONGEST) & (m <= _LONGEST)
    for i in np.flatnonzero(~short & ~inside & (n > 0)):
        out[i] = best_window(x[i], y[i])
    for rows, p, q in _chunks(x, y, np.flatnonzero(short), np.maximum(n, m)):
        by_length = np.argsort(-n[rows], kind="stable")
        rows, p, q = rows[by_length], [p[i] for i in by_length], [q[i] for i in by_length]
        best = np.zeros(len(rows))
        for back in (False, True):
            (a, na), (b, nb) = (_codes([s[::-1] for s in side] if back else side) for side in (p, q))
            masks = _Masks(a, na, b)
            state = masks.start(len(rows))
            active = np.searchsorted(-na, -np.arange(a.shape[1]), side="left")
            for j, k in enumerate(active):
                masks.step(state, masks.base[:k] + masks.b[:k, j])
                best[:k] = np.maximum(best[:k], 2 * masks.length(state[:, :k], slice(k)) / (na[:k] + (j + 1)))
            if not back:
                many = np.maximum(nb - na - 1, 0)  # whole windows but the first and the last
                pair = np.repeat(np.arange(len(rows)), many)
                start = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many) + 1
                for k in range(0, len(pair), 1 << 14):
                    own, at = pair[k : k + (1 << 14)], start[k : k + (1 << 14)]
                    state = masks.start(len(own))
                    flat, first = masks.b.ravel(), own * masks.b.shape[1] + at
                    for j in range(int(na[own[0]])):
                        on = int(np.searchsorted(-na[own], -j, side="left"))
                        masks.step(state, masks.base[own[:on]] + flat[first[:on] + j])
                    np.maximum.at(best, own, 2 * masks.length(state, own) / (2 * na[own]))
        out[rows] = best
    return out


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y, which = _distinct(a, b)
    return pd.Series(best_windows(x, y)[which])


def ratio(a: Column, b: Column) -> Column:
    """Normalised indel similarity: twice the common subsequence over both lengths."""
    return F.when((a != "") & (b != ""), 2.0 * lcs_len(a, b) / (F.length(a) + F.length(b))).otherwise(0.0)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(sorted_tokens(a), sorted_tokens(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best of the common tokens with each side, and of both sides' other tokens behind the common ones."""
    return token_set_ratio_of(F.array_distinct(words(a)), F.array_distinct(words(b)))


def token_set_ratio_of(x: Column, y: Column) -> Column:
    """The same of the strings' sets of tokens; without any it is 0."""
    both, left, right = F.array_intersect(x, y), F.array_except(x, y), F.array_except(y, x)
    s, l, r = (joined(F.array_sort(v)) for v in (both, left, right))
    ls, la, lb = F.length(s), F.length(l), F.length(r)
    sep = F.when(ls > 0, 1).otherwise(0)
    whole_a, whole_b = ls + sep + la, ls + sep + lb
    indel = la + lb - 2 * lcs_len(l, r)
    first = 1 - indel / (whole_a + whole_b)
    second = F.when(ls > 0, 1 - (sep + la) / (ls + whole_a)).otherwise(0.0)
    third = F.when(ls > 0, 1 - (sep + lb) / (ls + whole_b)).otherwise(0.0)
    contained = (F.size(both) > 0) & ((F.size(left) == 0) | (F.size(right) == 0))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when(contained, 1.0).otherwise(F.greatest(first, second, third))


def jaccard(x: Column, y: Column) -> Column:
    """Of token arrays as sets."""
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def overlap(x: Column, y: Column) -> Column:
    """Shared tokens over the smaller set."""
    least = F.least(F.size(F.array_distinct(x)), F.size(F.array_distinct(y)))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)


def jaccard_of(n: Column, x: Column, y: Column) -> Column:
    """``jaccard`` of two sets without repeated members that have n in common."""
    return F.when((F.size(x) > 0) & (F.size(y) > 0), n / (F.size(x) + F.size(y) - n)).otherwise(0.0)


def overlap_of(n: Column, x: Column, y: Column) -> Column:
    """``overlap`` of the same."""
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, n / least).otherwise(0.0)


def length_ratio(a: Column, b: Column) -> Column:
    return F.when((a != "") & (b != ""), F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))).otherwise(0.0)


def both_equal(a: Column, b: Column) -> Column:
    """1.0 where equal and not empty."""
    return ((a == b) & (a != "")).cast("double")
