"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into A and B of 23 bits and C of 18. The binary Golay code is
perfect: a 23-bit word lies within 3 of one codeword, and a word at distance 3 lies within 4
of five more. With these one or six codeword indices as keys, words that differ in at most 2
bits share a key. Three errors fall on (A, B, C) in one of these ways, each met by a family:

1. none in A, at most 2 in B:   A itself and an index of B
2. none in B, at most 2 in A:   an index of A and B itself
3. none in A, 3 in B:           A and C themselves
4. none in B, 3 in A:           B and C themselves
5. one or more in A and in B, so at most one in C: an index each of A and B and one half of C
   (families 5 and 6, a half each)

So fingerprints within 3 bits share a key of 33 bits or more; those that do are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clusters import components
from ..operators.skew import spread_join
from .common import cut, slices, texts

RADIUS = 3
SEED = 42
#: Generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the binary Golay code (fixed value).
GENERATOR = 0xAE3
BLOCK = 16384
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_SHIFT = np.arange(8) * 256


def fingerprint(text: str, shingle: int = 3) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; 0 without words."""
    words = text.encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    xxh = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return xxh(b" ".join(words), SEED)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - shingle + 1].tolist()
    hashes = np.array([xxh(joined[a:b], SEED) for a, b in zip(start, end[shingle - 1 :].tolist())], np.uint64)
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _SHIFT).ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


@lru_cache(maxsize=1)
def _tables() -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Syndromes by byte; for each syndrome six error patterns, and which of them count."""

    def syndrome(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    by_bit = [syndrome(1 << b) for b in range(23)]
    parts = []
    for first in (0, 8, 16):
        t = np.zeros(256, np.int64)
        for b in range(8):
            if first + b < 23:
                t[(np.arange(256) >> b & 1) == 1] ^= by_bit[first + b]
        parts.append(t)
    errors: list[list[int]] = [[] for _ in range(2048)]
    weight = [0] * 2048
    for w in range(5):
        for places in combinations(range(23), w):
            s = 0
            for p in places:
                s ^= by_bit[p]
            if not errors[s] or w == 4 and weight[s] == 3:
                if not errors[s]:
                    weight[s] = w
                errors[s].append(sum(1 << p for p in places))
    return parts, np.array([(e * 6)[:6] for e in errors]), np.array([[i < len(e) for i in range(6)] for e in errors])


def codewords(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words the six slots of nearby codewords' 12-bit indices, and which are used."""
    parts, errors, used = _tables()
    s = parts[0][v & 255] ^ parts[1][v >> 8 & 255] ^ parts[2][v >> 16]
    return (v[:, None] ^ errors[s]) >> 11, used[s]


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the fingerprints (uint64), and the place of the fingerprint each is from."""
    v = fp.astype(np.uint64)
    a, b, c = ((v >> np.uint64(s) & np.uint64(m)).astype(np.int64) for s, m in ((0, 0x7FFFFF), (23, 0x7FFFFF), (46, 0x3FFFF)))
    (ka, ua), (kb, ub) = codewords(a), codewords(b)
    n = len(v)
    both = (ua[:, :, None] & ub[:, None, :]).reshape(n, 36)
    pair = (ka[:, :, None] << 12 | kb[:, None, :]).reshape(n, 36)
    every = np.ones((n, 1), bool)
    families = [
        (a[:, None] << 12 | kb, ub), (b[:, None] << 12 | ka, ua), ((a << 18 | c)[:, None], every), ((b << 18 | c)[:, None], every),
        (pair << 9 | (c & 511)[:, None], both), (pair << 9 | (c >> 9)[:, None], both),
    ]
    out, of = [], []
    for i, (k, u) in enumerate(families, 1):
        out.append((k | i << 60)[u])
        of.append(np.nonzero(u)[0])
    return np.concatenate(out), np.concatenate(of)


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(fp), 4096):
            part = fp[at : at + 4096]
            k, of = keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(part[of])], ["key", "fp"])


def near(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join all fingerprints connected by links within this group, none twice."""
    out, rest = [], fps
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            close = near(rest, x)
            if close.any():
                found = rest[close]
                out += [(int(x), int(y)) for y in found]
                todo += list(found)
                rest = rest[~close]
    return out


def _edge_batch(edges: list, blocks: list) -> pa.RecordBatch:
    cols = list(zip(*edges)) if edges else [(), ()]
    none = [None] * len(edges)
    return pa.RecordBatch.from_arrays(
        [pa.array([*cols[0], *[None] * len(blocks)], pa.int64()), pa.array([*cols[1], *[None] * len(blocks)], pa.int64()),
         pa.array([*none, *(b[0] for b in blocks)], pa.int64()), pa.array([*none, *(b[1] for b in blocks)], pa.int32()), pa.array([*none, *(b[2] for b in blocks)], pa.binary())],
        ["a", "b", "key", "block", "fps"],
    )


def _link_batches(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Edges within each key's group of rows sorted by key.

    A group of more than `block` fingerprints is passed on in blocks, each linked within itself
    here; pairs of blocks are compared later, so no task holds more than two blocks.
    """
    held_key, held, number = None, np.zeros(0, np.int64), 0

    def close(last: bool) -> tuple[list, list]:
        nonlocal held, number
        if len(held) < 2 and not number:
            return [], []
        edges = forest(held)
        blocks = [(held_key, number, held.tobytes())] if number or not last else []
        held, number = held[:0], number + 1
        return edges, blocks

    for batch in batches:
        key = batch.column("key").to_numpy(zero_copy_only=False)
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        if not len(key):
            continue
        edges, blocks = [], []
        start = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        size = np.diff(np.append(start, len(key)))
        inner = np.zeros(len(start), bool)
        inner[1:-1] = True  # the first and the last group may go on in another batch
        two = start[inner & (size == 2)]
        hit = two[near(fp[two], fp[two + 1])]
        edges += list(zip(fp[hit].tolist(), fp[hit + 1].tolist()))
        for g in np.flatnonzero(~inner | (size > 2)):
            if key[start[g]] != held_key:
                e, b = close(True)
                edges, blocks = edges + e, blocks + b
                held_key, held, number = key[start[g]], np.zeros(0, np.int64), 0
            part = fp[start[g] : start[g] + size[g]]
            while len(part):
                room = block - len(held)
                held, part = np.concatenate([held, part[:room]]), part[room:]
                if len(held) == block and len(part):
                    e, b = close(False)
                    edges, blocks = edges + e, blocks + b
        yield _edge_batch(edges, blocks)
    yield _edge_batch(*close(True))


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that join what is connected within two blocks: one less than their fingerprints at most."""
    for batch in batches:
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("fps", "other"))
            edges = forest(np.concatenate([x, y]))
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) within RADIUS bits: as many as join
    all that are connected, not all pairs."""
    keyed = fps.mapInArrow(_key_batches, "key long, fp long")
    # By the key's hash, not its range: a sample for ranges would compute the keys twice.
    dealt = keyed.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _link_batches(batches, block)

    found = cut(dealt.mapInArrow(run, "a long, b long, key long, block int, fps binary"))
    edges = found.where("block is null").select("a", "b")
    large = found.where("block is not null").select("key", "block", "fps")
    if not large.isEmpty():
        other = large.select("key", F.col("block").alias("to"), F.col("fps").alias("other"))
        pairs = large.join(other, "key").where("block < to").select("fps", "other")
        edges = edges.union(pairs.repartition(F.xxhash64("fps", "other")).mapInArrow(_block_pairs, "a long, b long"))
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, fp) of every row; a null text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in texts(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fp, pa.int64())], ["doc_id", "text_hash", "fp"])

    kind = docs.schema[id].dataType.simpleString()
    chosen = docs.select(F.col(id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def proposed(prints: DataFrame, node: str) -> DataFrame:
    """Edges (a, b) that join all nodes whose fingerprints are connected by links. prints: (fp, node),
    a row for each node; nodes of one fingerprint are tied to its least."""
    least = prints.groupBy("fp").agg(F.min(node).alias("least"))
    edges = links(least.select("fp"))
    a, b = (least.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}")) for c in ("a", "b"))
    apart = edges.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    same = spread_join(prints.select("fp", node), least, "fp", node).where(F.col("least") != F.col(node))
    return apart.union(same.select(F.col("least").alias("a"), F.col(node).alias("b")))


def _labelled(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fp, rep, label) of every fingerprint, its least doc_id and its component; and (node, label)
    of those that are linked."""
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    joined = components(links(reps.select("fp")))
    return reps.join(joined, reps["fp"] == joined["node"], "left").select("fp", "rep", F.coalesce("label", "fp").alias("label")), joined


def near_duplicates(docs: DataFrame, shingle: int = 3, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, fp and component_id of every row of docs.

    component_id is the least doc_id reachable over links of at most three differing bits. Null
    texts count as empty; empty texts share fingerprint 0, linked like any other. Rows with a null
    doc_id take part and name no component (null if a component has no other). Repeated rows stay.
    An empty table gives an empty one. Equal texts are one node, however many there are. Texts are
    read whole. Other columns are not carried.
    """
    prints = cut(fingerprints(docs, shingle, text, id))
    labelled, joined = _labelled(prints)
    names = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    return prints.join(spread_join(labelled, names, "label", "fp", joined).select("fp", "component_id"), "fp").select("doc_id", "text_hash", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row of docs for each component, with all its columns: that of the least (doc_id, text
    hash), null ids last. An id that stands on several texts is no link between them."""
    prints = cut(fingerprints(docs, shingle, text, id))
    return keep_first(docs, prints.withColumnRenamed("fp", "node"), _labelled(prints)[0].select(F.col("fp").alias("node"), "label"), text, id)


def keep_first(docs: DataFrame, rows: DataFrame, labels: DataFrame, text: str, id: str) -> DataFrame:
    """The rows of docs that stand for their component. rows: (doc_id, text_hash, node) of all
    rows; labels: (node, label). Rows are counted by node before nodes meet, so no join sees the
    copies of a text."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")
    by_row = rows.groupBy("node", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    by_node = by_row.groupBy("node").agg(F.min(order).alias("first"))
    chosen = cut(by_node.join(labels, "node").groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_nd_id"), F.col("first.text_hash").alias("_nd_hash"), F.col("first.n").alias("_nd_rows")))
    text_hash = F.xxhash64(text)
    own, theirs = docs[id], chosen["_nd_id"]
    # Built on: a row of three numbers for each component in the partition, less than its texts.
    kept = docs.join(chosen.hint("shuffle_hash"), own.eqNullSafe(theirs) & (text_hash == chosen["_nd_hash"]), "left_semi")
    if chosen.where("_nd_rows > 1").isEmpty():
        return kept
    # Repeated rows of one id and text: one of each stays, the others' columns go with them.
    several = chosen.where("_nd_rows > 1").hint("shuffle_hash")
    again = (own.eqNullSafe(several["_nd_id"])) & (text_hash == several["_nd_hash"])
    single, repeated = kept.join(several, again, "left_anti"), kept.join(several, again, "left_semi")
    names = docs.columns
    one = repeated.groupBy(F.col(id).alias("_nd_id"), text_hash.alias("_nd_hash")).agg(*(F.first(c).alias(c) for c in names))
    return single.unionByName(one.select(*names))
