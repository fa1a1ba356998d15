"""Byte-level BPE in two tiers.

A minimal perfect hash over the vocabulary resolves pre-tokens that are whole tokens. The
others are merged by a heap of pair ranks over linked bytes. Vocabularies are read, never
trained; the path is a parameter.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import partial
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, texts

#: A worker's memory of pre-tokens: so many in each of two
#: generations, none longer than so many characters. Others are
#: encoded each time; results don't depend on it.
CACHE_SIZE, CACHE_CHARS = 200_000, 48
#: Pre-tokens of a long text encoded at once; bytes from which a pre-token's links lie in arrays.
BLOCK, LONG, LOW = 1 << 16, 4096, (1 << 32) - 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys, n slots.

    A bucket of several keys has the seed under which its keys fall on free slots; a bucket of
    one key has its slot, as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        buckets: list[list[bytes]] = [[] for _ in range(max(1, self.n // 3))]
        for k in keys:
            buckets[xxhash.xxh64_intdigest(k) % len(buckets)].append(k)
        self.seeds = [0] * len(buckets)
        self.slots: list[bytes | None] = [None] * self.n
        order = sorted(range(len(buckets)), key=lambda i: -len(buckets[i]))
        singles = []
        for i in order:
            bucket = buckets[i]
            if len(bucket) < 2:
                singles += [i] * len(bucket)
                continue
            seed = 1
            while True:
                at = {xxhash.xxh64_intdigest(k, seed) % self.n for k in bucket}
                if len(at) == len(bucket) and all(self.slots[s] is None for s in at):
                    break
                seed += 1
            self.seeds[i] = seed
            for k in bucket:
                self.slots[xxhash.xxh64_intdigest(k, seed) % self.n] = k
        free = (s for s in range(self.n) if self.slots[s] is None)
        for i, s in zip(singles, free):
            self.seeds[i], self.slots[s] = -1 - s, buckets[i][0]

    def slot(self, key: bytes) -> int:
        """The slot of key if it is one of the keys, else -1."""
        seed = self.seeds[xxhash.xxh64_intdigest(key) % len(self.seeds)]
        at = -1 - seed if seed < 0 else xxhash.xxh64_intdigest(key, seed) % self.n
        return at if self.slots[at] == key else -1


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.iterate = regex.compile(pattern).finditer
        self.whole = PerfectHash(list(ranks))
        self.slot_ids = [ranks[k] for k in self.whole.slots]
        top = max(ranks.values(), default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * top
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.decimal = [str(i) for i in range(top)]
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def from_bytes(vocabulary: bytes, pattern: str) -> Tokenizer:
        return Tokenizer({base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}, pattern)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a pre-token that is no token: least rank first, leftmost first among equals."""
        n, get = len(piece), self.ranks.get
        numbers = list if n < LONG else partial(array, "q")
        after = numbers(range(1, n + 1))
        before = numbers(range(-1, n - 1))
        # Rank, place and end in one number: a third of a tuple's memory.
        heap = [r << 64 | i << 32 | i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            least = heappop(heap)
            i, end = least >> 32 & LOW, least & LOW
            j = after[i]  # n for a byte that was merged into an earlier one
            if j >= n or after[j] != end:
                continue
            after[i], after[j] = end, n
            if end < n:
                before[end] = i
                stop = after[end]
                if (r := get(piece[i:stop])) is not None:
                    heappush(heap, r << 64 | i << 32 | stop)
            p = before[i]
            if p >= 0 and (r := get(piece[p:end])) is not None:
                heappush(heap, r << 64 | p << 32 | end)
        ids, i, ranks = [], 0, self.ranks
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(ids)

    def piece(self, token: str) -> tuple[int, ...]:
        found = self.cache.get(token)
        if found is None:
            found = self.older.get(token)
            if found is None:
                raw = token.encode()
                at = self.whole.slot(raw)
                found = (self.slot_ids[at],) if at >= 0 else self.merge(raw)
            if len(token) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_SIZE:  # what isn't met again in a generation goes
                    self.cache, self.older = {}, self.cache
                self.cache[token] = found
        return found

    def pieces(self, text: str) -> list[tuple[int, ...]]:
        return self.pieces_of(self.find(text))

    def pieces_of(self, tokens: list[str]) -> list[tuple[int, ...]]:
        get, piece = self.cache.get, self.piece
        return [get(t) or piece(t) for t in tokens]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.pieces(text)))

    def blocks(self, text: str, size: int = BLOCK) -> Iterator[list[int]]:
        """The ids of a text in lists, of `size` pre-tokens each: a long text's aren't held at once."""
        if len(text) <= size:
            yield self.encode(text)
            return
        tokens = (m.group() for m in self.iterate(text))
        while part := list(islice(tokens, size)):
            yield list(chain.from_iterable(self.pieces_of(part)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_made: dict[bytes, Tokenizer] = {}


class SharedTokenizer:
    """A vocabulary file read once by the driver and broadcast; each Python worker builds its
    tokenizer once. Files over max_bytes are refused: a vocabulary doesn't grow with the data."""

    def __init__(self, spark: SparkSession, path: str | None = None, pattern: str | None = None, max_bytes: int = 64 << 20):
        path = path or default_vocabulary()
        with open(path, "rb") as f:
            raw = f.read(max_bytes + 1)
        if len(raw) > max_bytes:
            raise ValueError(f"{path} is larger than {max_bytes} bytes")
        self.raw = spark.sparkContext.broadcast(raw)
        self.pattern = pattern or default_pattern()
        self.name = hashlib.sha256(raw + self.pattern.encode()).digest()

    def __call__(self) -> Tokenizer:
        if self.name not in _made:
            _made[self.name] = Tokenizer.from_bytes(self.raw.value, self.pattern)
        return _made[self.name]


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", id: str = "doc_id", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row (and the ids, if asked for).

    Null counts as the empty text: no tokens, hashes of nothing. Special tokens' strings are
    ordinary text. Repeated rows each get their own row; texts are encoded whole.
    """
    tokenizer = SharedTokenizer(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer()
        for b in slices(batches):
            names, counts, digests, decoded, lists = b.column("doc_id"), [], [], [], []
            for s in texts(b.column("text")):
                n, own, back, held = 0, hashlib.sha256(), hashlib.sha256(), array("i")
                for got in t.blocks(s):
                    own.update(((" " if n else "") + " ".join(map(t.decimal.__getitem__, got))).encode())
                    back.update(t.decode(got))
                    n += len(got)
                    if ids:
                        held.extend(got)
                counts.append(n)
                digests.append(own.hexdigest())
                decoded.append(back.hexdigest())
                if ids:
                    lists.append(np.array(held, np.int32))
            more = [pa.array(lists, pa.list_(pa.int32()))] if ids else []
            yield pa.RecordBatch.from_arrays([names, pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), *more], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
