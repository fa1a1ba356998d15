"""Benchmark decontamination by SimHash over item-sized windows.

Each item has a 64-bit SimHash of its word shingles. A document's windows of as many words as
an item are fingerprinted from sums of shingle bits, and looked up in a multi-index of the
items' fingerprints: four blocks of 16 bits. By the pigeonhole principle fingerprints within
RADIUS bits have a block within RADIUS // 4; a window asks each block's table for all values that
near, so it meets an item once a block. Candidates are verified by the exact weighted (multiset)
Jaccard similarity of window and item.

A window whose similarity reaches the threshold shares that part of the item's shingles at
least; windows with fewer benchmark shingles than that are not fingerprinted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import runs, text_buffer
from .textnum import ALPHANUMERIC, U, mix, span_hashes, spans

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 19
#: Items and bytes of a benchmark that is broadcast; a larger one is worked off in parts.
MAX_ITEMS, MAX_BYTES = 10_000, 32 << 20
#: Pairs of windows and items that a lookup may hold at once.
SLICE = 1 << 20
_STEP = U(0xA0761D6478BD642F)


def shingles(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles that begin at each word, and whether they end in the document."""
    n = len(words)
    out, whole = np.zeros(n, U), np.zeros(n, bool)
    if n >= size:
        rolled = words[: n - size + 1].copy()
        for k in range(1, size):
            rolled = rolled * _STEP + words[k : n - size + 1 + k]
        out[: n - size + 1] = mix(rolled)
        whole[: n - size + 1] = doc[: n - size + 1] == doc[size - 1 :]
    return out, whole


def simhash(hashes: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of shingle hashes."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(*hashes.shape, 8), axis=-1, bitorder="little")
    ones = bits.sum(axis=1, dtype=np.int32)
    return np.packbits(2 * ones > hashes.shape[1], axis=-1, bitorder="little").view(np.uint64).ravel()


@lru_cache(maxsize=1)
def _ball() -> np.ndarray:
    """16-bit patterns of at most RADIUS // 4 bits."""
    return np.array([sum(1 << p for p in c) for w in range(RADIUS // 4 + 1) for c in combinations(range(16), w)], np.int64)


class Index:
    """What the executors need of the benchmark."""

    def __init__(self, items: list[tuple], shingle: int = SHINGLE):
        data, offsets = text_buffer(pc.utf8_lower(pa.array([t for _, t in items], pa.string())))
        start, end, doc = spans(data, offsets, ALPHANUMERIC)
        words = span_hashes(data, start, end)
        self.shingle, self.ids, bags, sizes, prints = shingle, [i for i, _ in items], [], [], []
        known: dict[int, set[int]] = {}
        bounds = np.searchsorted(doc, np.arange(len(items) + 1))
        for i in range(len(items)):
            own = words[bounds[i] : bounds[i + 1]]
            k = min(shingle, len(own))
            got = shingles(own, np.zeros(len(own), np.int64), k)[0][: len(own) - k + 1] if k else np.zeros(0, U)
            bags.append(np.unique(got, return_counts=True))
            sizes.append(len(own))
            prints.append(simhash(got[None])[0] if len(got) else U(0))
            if k:
                known.setdefault(len(own), set()).update(got.tolist())
        self.prints = np.array(prints, U)
        self.known = {n: np.sort(np.array(list(v), U)) for n, v in sorted(known.items())}
        self.sizes = list(self.known)
        self.filters = {}
        for k in {min(shingle, n) for n in self.sizes}:
            f = np.zeros(1 << 22, bool)
            for n in (n for n in self.sizes if min(shingle, n) == k):
                f[(self.known[n] & U((1 << 22) - 1)).astype(np.int64)] = True
            self.filters[k] = f
        self.item_sizes = np.array(sizes, np.int64)
        # Every item's distinct shingles, by their place among all, with counts.
        self.all = np.unique(np.concatenate([h for h, _ in bags] or [np.zeros(0, U)]))
        self.shingle_of = np.searchsorted(self.all, np.concatenate([h for h, _ in bags] or [np.zeros(0, U)])).astype(np.int32)
        self.count_of = np.concatenate([c for _, c in bags] or [np.zeros(0, np.int64)]).astype(np.int32)
        self.bounds = np.concatenate([[0], np.cumsum([len(h) for h, _ in bags])]).astype(np.int64)
        self.totals = np.array([int(c.sum()) for _, c in bags], np.int64)
        # Blocks of 16 bits: the items in order of the block's value, and where each value begins.
        self.blocks = []
        for s in range(0, 64, 16):
            value = (self.prints >> U(s) & U(0xFFFF)).astype(np.int64)
            order = np.argsort(value, kind="stable").astype(np.int32)
            self.blocks.append((np.searchsorted(value[order], np.arange((1 << 16) + 1)).astype(np.int32), order))

    def maybe(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Places of hashes that may be shingles of items; it misses none."""
        return np.flatnonzero(self.filters[k][(hashes & U((1 << 22) - 1)).astype(np.int64)])

    def lookup(self, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of items of n words within RADIUS bits of the fingerprints.

        Windows go through the blocks a few at a time, and what a block brings is cut to the radius
        before the next: held are the items of a slice's windows, each once a block.
        """
        pairs, step = [np.zeros(0, np.int64)], max(1, SLICE // max(1, len(self.prints)))
        for at in range(0, len(prints), step):
            part, found = prints[at : at + step], []
            for s, (begin, order) in zip(range(0, 64, 16), self.blocks):
                asked = ((part >> U(s) & U(0xFFFF)).astype(np.int64)[:, None] ^ _ball()).ravel()
                low, count = begin[asked], begin[asked + 1] - begin[asked]
                some = np.flatnonzero(count)
                low, count = low[some].astype(np.int64), count[some]
                item = order[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
                window = np.repeat(some // len(_ball()), count)
                close = (self.item_sizes[item] == n) & (np.bitwise_count(part[window] ^ self.prints[item]) <= RADIUS)
                found.append((window[close] + at).astype(np.int64) << 32 | item[close])
            pairs.append(np.unique(np.concatenate(found)))
        both = np.concatenate(pairs)
        return both >> 32, both & 0xFFFFFFFF

    def similarities(self, hashes: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Exact weighted Jaccard similarity of a window's shingles with each of the items."""
        own, count = np.unique(hashes, return_counts=True)
        at = np.minimum(np.searchsorted(self.all, own), len(self.all) - 1)
        there = self.all[at] == own
        weight = np.zeros(len(self.all), np.int32)
        weight[at[there]] = count[there]
        size = self.bounds[items + 1] - self.bounds[items]
        place = np.repeat(self.bounds[items] - np.cumsum(size) + size, size) + np.arange(size.sum())
        common = np.bincount(np.repeat(np.arange(len(items)), size), weights=np.minimum(weight[self.shingle_of[place]], self.count_of[place]), minlength=len(items))
        return common / (len(hashes) + self.totals[items] - common)


def leaks(index: Index, data: np.ndarray, offsets: np.ndarray, threshold: float) -> dict[tuple[int, int], float]:
    """(document, item) -> greatest similarity of a window, of those that reach the threshold."""
    start, end, doc = spans(data, offsets, ALPHANUMERIC)
    words = span_hashes(np.ascontiguousarray(data), start, end)
    found: dict[tuple[int, int], float] = {}

    def verify(docs: np.ndarray, windows: np.ndarray, n: int) -> None:
        window, item = index.lookup(simhash(windows), n)
        first = np.flatnonzero(np.diff(window, prepend=-1))
        for a, z in zip(first.tolist(), [*first[1:].tolist(), len(window)]):
            w, items = int(window[a]), item[a:z]
            got = index.similarities(windows[w], items)
            for i in np.flatnonzero(got >= threshold):
                pair = (int(docs[w]), int(items[i]))
                found[pair] = max(found.get(pair, 0.0), float(got[i]))

    for k in index.filters:
        hashes, whole = shingles(words, doc, k)
        hits = index.maybe(hashes, k)
        hits = hits[whole[hits]]
        for n in (n for n in index.sizes if min(index.shingle, n) == k and len(hits)):
            m = n - k + 1  # shingles of a window
            least = max(1, int(np.ceil(threshold * m - 1e-9)))
            known = index.known[n]
            own = hits[known[np.minimum(np.searchsorted(known, hashes[hits]), len(known) - 1)] == hashes[hits]]
            if len(own) < least:
                continue
            # Windows that hold `least` of these places begin after the last's less m, up to the first.
            first, last = own[: len(own) - least + 1], own[least - 1 :]
            tight = last - first < m
            low, high = np.maximum(last[tight] - m + 1, 0), first[tight]
            at = np.unique(np.repeat(high, high - low + 1) - np.concatenate([np.arange(c) for c in high - low + 1] or [np.zeros(0, np.int64)]))
            at = at[at + n <= len(words)]
            at = at[doc[at + n - 1] == doc[at]]
            step = max(1, min(2048, (1 << 19) // m))
            for i in range(0, len(at), step):
                part = at[i : i + step]
                verify(doc[part], hashes[part[:, None] + np.arange(m)], n)
        # A document shorter than an item is a window by itself.
        for d in np.unique(doc[hits]):
            a, z = np.searchsorted(doc, [d, d + 1])
            if min(index.shingle, z - a) == k:
                own = hashes[a : z - k + 1]
                for n in (n for n in index.sizes if z - a < n <= len(own) / threshold + k - 1):
                    if min(index.shingle, n) == k:
                        verify(np.array([d]), own[None], n)
    return found


def indexes(benchmark: DataFrame, text: str = "text", id: str = "item_id", shingle: int = SHINGLE) -> Iterator[Index]:
    """Indexes of the benchmark, each of at most MAX_ITEMS items and about MAX_BYTES of text.

    Items arrive one partition at a time; a benchmark of any size is worked off in parts.
    """
    part: list[tuple[int, str]] = []
    size = 0
    rows = benchmark.select(F.col(id).alias("item_id"), F.coalesce(text, F.lit("")).alias("text")).distinct().toLocalIterator()
    for r in rows:
        part.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if len(part) >= MAX_ITEMS or size > MAX_BYTES:
            yield Index(part, shingle)
            part, size = [], 0
    if part:
        yield Index(part, shingle)


def _searched(docs: DataFrame, index: Index, threshold: float, text: str, id: str, item_kind: DataType) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            data, offsets = text_buffer(pc.utf8_lower(b.column("text")))
            rows, items, sims = [], [], []
            for a, z in runs(offsets):
                for (d, item), s in leaks(index, data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], threshold).items():
                    rows.append(a + d)
                    items.append(index.ids[item])
                    sims.append(s)
            own = b.column("doc_id").take(pa.array(rows, pa.int64()))
            keys = b.column("text_hash").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([own, keys, pa.array(items, arrow_kind), pa.array(sims, pa.float64())], ["doc_id", "text_hash", "item_id", "similarity"])

    arrow_kind = to_arrow_type(item_kind)
    kind = docs.schema[id].dataType.simpleString()
    chosen = docs.select(F.col(id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {kind}, text_hash long, item_id {item_kind.simpleString()}, similarity double")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, shingle: int = SHINGLE, text: str = "text", id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, similarity) of each document row that has a window like an item.

    Words are runs of letters and digits of the lower-cased text; shingles have five words, or
    all of a shorter item. A document shorter than an item is compared whole. Null and wordless
    texts, and items without words, match nothing. Repeated document rows give repeated pairs;
    repeated items count once. An empty benchmark or table gives no pairs. Similarities are the
    greatest over a document's windows. Ids of either side may have any type; other columns are
    not carried. Texts are read whole.
    """
    out, item_kind = None, benchmark.schema[item_id].dataType
    for index in indexes(benchmark, item_text, item_id, shingle):
        found = _searched(docs, index, threshold, text, id, item_kind)
        out = found if out is None else out.union(found)
    if out is None:
        kind = docs.schema[id].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, text_hash long, item_id {item_kind.simpleString()}, similarity double")
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that have no window like an item, in one pass for each index; all columns
    are carried, whatever their names."""
    for index in indexes(benchmark, item_text, item_id):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for b in batches:
                data, offsets = text_buffer(pc.utf8_lower(b.column(text)))
                bad = {a + d for a, z in runs(offsets) for d, _ in leaks(shared.value, data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], threshold)}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_())) if bad else b

        docs = docs.mapInArrow(run, docs.schema)
    return docs
