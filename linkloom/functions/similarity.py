"""String similarities that Spark lacks, in one Arrow UDF per pair of records.

Conventions: two empty strings are alike (1) for ratio, partial ratio and token sort; a string
without tokens has token-set similarity 0; Jaro-Winkler of an empty string is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        if u:
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence by the sum of lengths."""
    return 1.0 if a == b else 2 * lcs(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a part of the longer one, no longer than it."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return float(not b)
    if a in b:
        return 1.0
    n = len(a)
    return max(ratio(a, b[max(i, 0) : i + n]) for i in range(1 - n, len(b)))


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 1.0
    left, right = (" ".join(filter(None, [both, " ".join(sorted(d))])) for d in (x - y, y - x))
    found = ratio(left, right)
    return max(found, ratio(both, left), ratio(both, right)) if both else found


def jaro_winkler(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(mine, (c for c, u in zip(b, used) if u))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


class _Texts:
    """Many texts as numbers of their letters, from 1."""

    def __init__(self, texts: list[str]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        letters, codes = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), return_inverse=True)
        self.codes, self.letters = (codes + 1).astype(np.int16 if len(letters) < 32_000 else np.int32), len(letters) + 1

    def grid(self, some: np.ndarray, fill: int) -> np.ndarray:
        """The texts as rows of one width."""
        size = self.size[some]
        out = np.full((len(some), int(size.max(initial=0))), fill, self.codes.dtype)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(np.arange(len(some)), size), place] = self.codes[np.repeat(self.start[some], size) + place]
        return out


def _sides(pairs: list[tuple[str, str]]) -> tuple[_Texts, _Texts]:
    """The first and the second texts, with one numbering of letters."""
    x = _Texts([a for a, _ in pairs] + [b for _, b in pairs])
    y, n = copy(x), len(pairs)
    x.size, y.size, x.start, y.start = x.size[:n], x.size[n:], x.start[:n], x.start[n:]
    return x, y


def _batches(a: _Texts, b: _Texts, todo: np.ndarray, cells: int = 1 << 22) -> Iterator[np.ndarray]:
    """Places of pairs of like lengths: what is compared side by side."""
    todo = todo[np.lexsort((b.size[todo], a.size[todo]))]
    first = 0
    while first < len(todo):
        cost = a.size[todo[first]] * max(1, int(b.size[todo[first:]][:2048].max())) + 1
        last = first + int(max(1, min(2048, cells // cost)))
        yield todo[first:last]
        first = last


def lcs_many(pairs: list[tuple[str, str]]) -> np.ndarray:
    """lcs() of many pairs, a letter of each a step."""
    x, y = _sides([(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs])
    out = np.zeros(len(pairs), np.int64)
    for some in _batches(x, y, np.flatnonzero(x.size > 0)):
        n, a, b = x.size[some], x.grid(some, 0), y.grid(some, 0)
        lane, place = np.nonzero(a)
        words = a.shape[1] + 63 >> 6
        table = np.zeros((len(some), x.letters, words), np.uint64)  # where a letter stands, as bits
        np.bitwise_or.at(table, (lane, a[lane, place], place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        rows = np.arange(len(some))
        v = [np.full(len(some), ~np.uint64(0)) for _ in range(words)]
        for t in range(b.shape[1]):
            found, carry = table[rows, b[:, t]], None
            for k in range(words):
                m = found[:, k]
                total = v[k] + (v[k] & m)
                over = total < v[k]
                if carry is not None:
                    total += carry
                    over |= total < carry
                v[k] = total | v[k] & ~m
                carry = over.astype(np.uint64)
        left = np.zeros(len(some), np.int64)
        for k in range(words):
            bits = np.clip(n - 64 * k, 0, 64).astype(np.uint64)
            mask = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits & np.uint64(63))) - np.uint64(1))
            left += np.bitwise_count(v[k] & mask)
        out[some] = n - left
    return out


def ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    out, todo = np.ones(len(pairs)), [i for i, (a, b) in enumerate(pairs) if a != b]
    if todo:
        part = [pairs[i] for i in todo]
        out[todo] = 2 * lcs_many(part) / np.array([len(a) + len(b) for a, b in part])
    return out


def token_sorts(pairs: list[tuple[str, str]]) -> np.ndarray:
    known = {t: " ".join(sorted(t.split())) for t in {t for p in pairs for t in p}}
    return ratios([(known[a], known[b]) for a, b in pairs])


def token_sets(pairs: list[tuple[str, str]]) -> np.ndarray:
    """token_set() of many pairs. The common words stand in front of both sides' own, so only those
    need comparing."""
    known = {t: set(t.split()) for t in {t for p in pairs for t in p}}
    out, own, todo = np.zeros(len(pairs)), [], []
    for i, (a, b) in enumerate(pairs):
        x, y = known[a], known[b]
        both = x & y
        if x and y and both and (len(both) == len(x) or len(both) == len(y)):
            out[i] = 1.0
        elif x and y:
            common = sum(map(len, both)) + len(both) - 1 if both else 0
            p, q = " ".join(sorted(x - both)), " ".join(sorted(y - both))
            own.append((p, q))
            todo.append((i, common, len(p), len(q)))
    if todo:
        i, common, p, q = np.array(todo).T
        front = np.where(common > 0, common + 1, 0)
        found = 2 * (front + lcs_many(own)) / (2 * front + p + q)
        for rest in (p, q):  # the common words alone against either side
            found = np.maximum(found, np.where(common > 0, 2 * common / (common + front + rest), 0))
        out[i] = found
    return out


def partial_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """partial_ratio() of many pairs, by combing (Tiskin, semi-local comparison): a strand runs down
    from each letter of the longer text; a window's letters without a partner are the strands that
    begin and end inside it, so one pass over the cells of a pair serves all windows."""
    out, todo, sides = np.zeros(len(pairs)), [], []
    for i, (a, b) in enumerate(pairs):
        a, b = (b, a) if len(a) > len(b) else (a, b)
        if a == b or a and a in b:
            out[i] = 1.0
        elif a:
            todo.append(i)
            sides.append((a, b))
    if not todo:
        return out
    x, y = _sides(sides)
    best = np.zeros(len(todo))
    for some in _batches(x, y, np.arange(len(todo)), 1 << 21):
        n, m = x.size[some], y.size[some]
        a, b = x.grid(some, -1)[:, ::-1], y.grid(some, -2)  # rows from the last to the first
        rows, columns = a.shape[1], b.shape[1]
        kind = np.int16 if rows + columns < 32_000 else np.int32
        h = np.tile(np.arange(rows, dtype=kind), (len(some), 1))
        v = np.tile(np.arange(rows, rows + columns, dtype=kind), (len(some), 1))
        for d in range(rows + columns - 1):
            low, high = max(0, d - rows + 1), min(columns, d + 1)  # columns of the diagonal
            first = rows - 1 - d + low
            at, down = slice(first, first + high - low), slice(low, high)
            p, q = h[:, at], v[:, down]
            turn = (a[:, at] == b[:, down]) | (p > q)
            h[:, at], v[:, down] = np.where(turn, q, p), np.where(turn, p, q)
        lane, end = np.nonzero(v >= rows)
        start = v[lane, end].astype(np.int64) - rows
        real = end < m[lane]
        lane, start, end = lane[real], start[real], end[real]
        # Window i holds letters max(i, 0) to min(i + n, m); strands inside are those of i from
        # end - n + 1 to start, and of all windows cut at an end of the text on that side.
        low = np.maximum(end - n[lane] + 1, 1 - n[lane]) + rows
        high = np.where(start >= 0, start, 0) + rows
        step = np.zeros((len(some), rows + columns + 1), np.int64)
        inside = low <= high
        np.add.at(step, (lane[inside], low[inside]), 1)
        np.add.at(step, (lane[inside], high[inside] + 1), -1)
        i = np.arange(rows + columns) - rows
        held = np.minimum(i + n[:, None], m[:, None]) - np.maximum(i, 0)
        found = held - np.cumsum(step, axis=1)[:, :-1]
        window = (i > -n[:, None]) & (i < m[:, None])
        best[some] = np.where(window, 2 * found / np.maximum(n[:, None] + held, 1), 0).max(axis=1)
    out[todo] = best
    return out


def jaro_winklers(pairs: list[tuple[str, str]]) -> np.ndarray:
    """jaro_winkler() of many pairs, a letter of each first text a step."""
    out = np.array([float(a == b and a != "") for a, b in pairs])
    todo = np.array([i for i, (a, b) in enumerate(pairs) if a and b and a != b], np.int64)
    if not len(todo):
        return out
    x, y = _sides([pairs[i] for i in todo])
    for some in _batches(x, y, np.arange(len(todo)), 1 << 21):
        n, m = x.size[some], y.size[some]
        a, b = x.grid(some, -1), y.grid(some, -2)
        reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)[:, None]
        used, mine = np.zeros(b.shape, bool), np.zeros(a.shape, bool)
        rows, wide = np.arange(len(some)), int(reach.max())
        for i in range(a.shape[1]):
            at = slice(max(0, i - wide), i + wide + 1)
            open_ = (b[:, at] == a[:, i : i + 1]) & ~used[:, at]
            if open_.shape[1]:
                open_ &= np.abs(np.arange(at.start, at.start + open_.shape[1]) - i) <= reach
                j = open_.argmax(axis=1)
                mine[:, i] = open_[rows, j]
                used[rows[mine[:, i]], at.start + j[mine[:, i]]] = True
        count = mine.sum(axis=1)
        p, q = (np.take_along_axis(t, np.argsort(~u, axis=1, kind="stable"), 1) for t, u in ((a, mine), (b, used)))
        shared = min(p.shape[1], q.shape[1])
        swaps = ((p[:, :shared] != q[:, :shared]) & (np.arange(shared) < count[:, None])).sum(axis=1) // 2
        k = np.maximum(count, 1)
        jaro = np.where(count > 0, (count / n + count / m + (count - swaps) / k) / 3, 0)
        front = np.logical_and.accumulate(a[:, : min(4, shared)] == b[:, : min(4, shared)], axis=1).sum(axis=1)
        out[todo[some]] = np.where(jaro > 0.7, jaro + 0.1 * front * (1 - jaro), jaro)
    return out


#: name: (function of a list of pairs, column)
MEASURES = {
    "name_sort": (token_sorts, "clean_name"), "name_set": (token_sets, "clean_name"),
    "root_sort": (token_sorts, "root_name"), "root_set": (token_sets, "root_name"),
    "root_partial": (partial_ratios, "root_name"), "root_ratio": (ratios, "root_name"), "name_jw": (jaro_winklers, "root_name"), "skeleton_jw": (jaro_winklers, "skeleton"),
    "addr_set": (token_sets, "clean_address"), "addr_sort": (token_sorts, "clean_address"), "addr_partial": (partial_ratios, "clean_address"),
}
FIELDS = ("clean_name", "root_name", "skeleton", "clean_address")


@F.pandas_udf(StructType([StructField(m, DoubleType()) for m in MEASURES]))
def similarities(n1: pd.Series, n2: pd.Series, r1: pd.Series, r2: pd.Series, s1: pd.Series, s2: pd.Series, a1: pd.Series, a2: pd.Series) -> pd.DataFrame:
    """All measures of pairs of records; a pair of strings that comes again is measured once."""
    out = {}
    places = {}
    for field, sides in zip(FIELDS, ((n1, n2), (r1, r2), (s1, s2), (a1, a2))):
        number: dict[tuple[str, str], int] = {}
        of = [number.setdefault(pair, len(number)) for pair in zip(*(s.fillna("") for s in sides))]
        places[field] = list(number), of
    for name, (f, field) in MEASURES.items():
        pairs, of = places[field]
        out[name] = np.asarray(f(pairs), float)[of] if of else np.zeros(0)
    return pd.DataFrame(out)


@F.pandas_udf(DoubleType())
def jaro_winkler_column(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = list(zip(a.fillna(""), b.fillna("")))
    distinct = {p: i for i, p in enumerate(dict.fromkeys(pairs))}
    found = jaro_winklers(list(distinct))
    return pd.Series([found[distinct[p]] for p in pairs], dtype=float)
