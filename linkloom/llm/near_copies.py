"""Near copies by SimHash, Golay keys and shingle similarity: the corpus pipeline's stage.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more.
Candidates come from the operator simhash_golay: texts whose fingerprints are within three bits. At a
similarity of 0.8 some ten bits differ, so MinHash bands add what lies farther apart (BANDS keys of
ROWS minima each; at 0.8 a pair without a common key has a chance of 0.0004, less above). The sets
themselves decide on all candidates. Texts joined by candidates are a family; only families' texts
are read again, and each family is linked where its texts meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clusters import components
from ..operators.skew import share, spread_join
from . import simhash_golay
from .common import cut, slices, texts
from .simhash_golay import keep_first

SHINGLE = 5
BANDS, ROWS = 20, 5
#: Similarity as a fraction, compared in whole numbers.
NUM, DEN = 4, 5
SEED = 42
#: Shingles held for a family at once.
BLOCK = 1 << 20
#: Texts of a family that one task links, and most of the tasks that a family is dealt to (pairs of
#: them are compared: with more, a very large family would be read too often).
FAMILY, SPREAD = 400, 64
_RNG = np.random.default_rng(SEED)
_FLIP, _ODD, _MIX = (_RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1) for _ in range(3))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; of a shorter text its words are one."""
    words = text.encode().lower().split()
    xxh = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([xxh(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - SHINGLE + 1].tolist()
    return np.unique(np.array([xxh(joined[a:b], SEED) for a, b in zip(start, end[SHINGLE - 1 :].tolist())], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 4096):
        part = hashes[None, at : at + 4096] ^ _FLIP[:, None]
        part *= _ODD[:, None]
        least = np.minimum(least, part.min(axis=1))
    mixed = least ^ least >> np.uint64(31)
    mixed = (mixed * _MIX).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
    return mixed ^ np.arange(BANDS, dtype=np.uint64)


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        own = texts(b.column("text"))
        keys = np.concatenate([band_keys(shingles(t)) for t in own]) if own else np.zeros(0, np.uint64)
        fp = np.array([simhash_golay.fingerprint(t) for t in own], np.uint64).view(np.int64)
        offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * BANDS)
        bands = pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fp, pa.int64()), bands], ["doc_id", "text_hash", "fp", "bands"])


def _chain_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each row to the one before of the same key: rows come sorted by key."""
    last_key, last = None, None
    for b in batches:
        key, node = b.column("key").to_numpy(), b.column("node").to_numpy()
        if not len(key):
            continue
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        a, c = node[same - 1], node[same]
        if last_key is not None and key[0] == last_key:
            a, c = np.append(a, last), np.append(c, node[0])
        last_key, last = key[-1], node[-1]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])


def forest(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that join all texts connected by links among these, none twice."""
    if len(nodes) < 2:
        return []
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    bounds = np.concatenate([[0], np.cumsum(size)])
    parts = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
    mark = np.zeros(int(ids.max()) + 1, bool)
    rest = np.argsort(size, kind="stable")  # by size: only a range of sizes can be near
    flat = np.concatenate([parts[i] for i in rest])
    out: list[tuple[int, int]] = []
    todo: list[int] = []
    while len(rest):
        if not todo:
            todo, flat, rest = [int(rest[0])], flat[size[rest[0]] :], rest[1:]
            continue
        x = todo.pop()
        sizes = size[rest]
        low, high = np.searchsorted(sizes * DEN, size[x] * NUM), np.searchsorted(sizes * NUM, size[x] * DEN, "right")
        if low >= high:
            continue
        starts = np.concatenate([[0], np.cumsum(sizes)])
        mark[parts[x]] = True
        both = np.add.reduceat(mark[flat[starts[low] : starts[high]]], starts[low:high] - starts[low], dtype=np.int64)
        mark[parts[x]] = False
        close = np.zeros(len(rest), bool)
        close[low:high] = DEN * both >= NUM * (size[x] + sizes[low:high] - both)
        if close.any():
            found = rest[close].tolist()
            out += [(nodes[x], nodes[y]) for y in found]
            todo += found
            flat, rest = flat[np.repeat(~close, sizes)], rest[~close]
    return out


def _packed(nodes: list[int], sets: list[np.ndarray]) -> bytes:
    head = np.array([len(nodes), *nodes, *map(len, sets)], np.int64)
    return head.tobytes() + b"".join(s.tobytes() for s in sets)


def _unpacked(data: bytes) -> tuple[list[int], list[np.ndarray]]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 1 + 2 * n)
    flat = np.frombuffer(data, np.uint64, offset=8 * len(head))
    return head[1 : n + 1].tolist(), np.split(flat, np.cumsum(head[n + 1 :])[:-1])


def _edge_batch(edges: list[tuple[int, int]], family: int | None = None, number: int = 0, block: bytes | None = None) -> pa.RecordBatch:
    more = block is not None
    cols = list(zip(*edges)) if edges else [(), ()]
    none = [None] * len(edges)
    return pa.RecordBatch.from_arrays(
        [pa.array([*cols[0], *[None] * more], pa.int64()), pa.array([*cols[1], *[None] * more], pa.int64()), pa.array([*none, *[family] * more], pa.int64()),
         pa.array([*none, *[number] * more], pa.int32()), pa.array([*none, *[block] * more], pa.binary())],
        ["a", "b", "family", "block", "sets"],
    )


def _family_batches(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Edges within each family of rows sorted by family and salt.

    A family of several salts, or of more than `block` shingles, is passed on in blocks, each linked
    within itself here; pairs of blocks are compared later, so no task holds more than two blocks.
    """
    key, number, held, several = (None, 0), 0, 0, False
    nodes: list[int] = []
    sets: list[np.ndarray] = []

    def close(last: bool) -> pa.RecordBatch:
        nonlocal nodes, sets, number, held
        done, number_now = (nodes, sets), number
        nodes, sets, held, number = [], [], 0, 0 if last else number + 1
        return _edge_batch(forest(*done), key[0], key[1] << 20 | number_now, _packed(*done) if done[0] and (number_now or several or not last) else None)

    for b in slices(batches, 200):
        for f, salt, salts, node, text in zip(*(b.column(c).to_pylist() for c in ("family", "salt", "salts", "node")), texts(b.column("text"))):
            if (f, salt) != key:
                if nodes or number:
                    yield close(True)
                key, number, several = (f, salt), 0, salts > 1
            elif nodes and nodes[-1] == node:
                continue  # a repeated row
            own = shingles(text)
            if held and held + len(own) > block:
                yield close(False)
            nodes.append(node)
            sets.append(own)
            held += len(own)
    if nodes or number:
        yield close(True)


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that join what is connected within two blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            (a, x), (b, y) = _unpacked(batch.column("sets")[i].as_py()), _unpacked(batch.column("other")[i].as_py())
            edges = forest(a + b, x + y)
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])


def links(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between the texts of each family (family, salts, node, text): as many as join all
    that are connected by links, not all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _family_batches(batches, block)

    salt = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")
    dealt = members.withColumn("salt", salt).repartition("family", "salt").sortWithinPartitions("family", "salt", "node").select("family", "salt", "salts", "node", "text")
    found = cut(dealt.mapInArrow(run, "a long, b long, family long, block int, sets binary"))
    edges = found.where("block is null").select("a", "b")
    large = found.where("block is not null").select("family", "block", "sets")
    if not large.isEmpty():
        other = large.select("family", F.col("block").alias("to"), F.col("sets").alias("other"))
        pairs = large.join(other, "family").where("block < to").select("sets", "other")
        edges = edges.union(pairs.repartition(F.xxhash64("sets", "other")).mapInArrow(_block_pairs, "a long, b long"))
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _proposed(prints: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges that join all texts of a common band key, for links of more than three bits. A hot key's texts are tied to its least one,
    which is broadcast (skew.MOST keys at most); the others are sorted by key and chained."""
    keyed = reps.select(F.explode("bands").alias("key"), F.col("text_hash").alias("node"))
    every = prints.select(F.explode("bands").alias("key"), F.col("text_hash").alias("node"))
    hot = every.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where(F.col("n") > share(prints.count() * BANDS))
    hot = F.broadcast(hot.select("key", "least"))
    stars = keyed.join(hot, "key").select(F.col("least").alias("a"), F.col("node").alias("b"))
    rest = keyed.join(hot, "key", "left_anti")
    return stars.union(rest.repartition("key").sortWithinPartitions("key").mapInArrow(_chain_batches, "a long, b long"))


def _labelled(docs: DataFrame, text: str, id: str, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, text_hash) of all rows; (text_hash, rep, label) of every text; and (node, label) of
    the texts that are linked."""
    kind = docs.schema[id].dataType.simpleString()
    chosen = docs.select(F.col(id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    prints = cut(chosen.mapInArrow(_band_batches, f"doc_id {kind}, text_hash long, fp long, bands array<long>"))
    reps = prints.groupBy("text_hash").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    found = simhash_golay.proposed(reps.select("fp", "text_hash"), "text_hash").union(_proposed(prints, reps))
    families = components(found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    families = families.select("node", F.col("label").alias("family"))
    families = families.union(families.select(F.col("family").alias("node"), "family")).distinct()
    salts = families.groupBy("family").agg(F.least(F.ceil(F.count("*") / FAMILY), F.lit(SPREAD)).cast("int").alias("salts"))
    firsts = spread_join(families, salts, "family", "node").join(reps.select(F.col("text_hash").alias("node"), "rep"), "node")
    rows = chosen.join(firsts.hint("shuffle_hash"), (chosen["text_hash"] == firsts["node"]) & chosen["doc_id"].eqNullSafe(firsts["rep"]))
    joined = components(links(rows.select("family", "salts", "node", "text"), block))
    own = reps.select("text_hash", "rep")
    labelled = own.join(joined, own["text_hash"] == joined["node"], "left").select("text_hash", "rep", F.coalesce("label", "text_hash").alias("label"))
    return prints.select("doc_id", "text_hash"), labelled, joined


def near_copies(docs: DataFrame, text: str = "text", id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash and component_id of every row of docs.

    component_id is the least doc_id reachable over links. Null texts, null ids and repeated rows
    are taken as in simhash_golay.near_duplicates.
    """
    prints, labelled, joined = _labelled(docs, text, id, block)
    names = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    return prints.join(spread_join(labelled, names, "label", "text_hash", joined).select("text_hash", "component_id"), "text_hash").select("doc_id", "text_hash", "component_id")


def keep_one(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row of docs for each component, as in simhash_golay.keep_one."""
    rows, labelled, _ = _labelled(docs, text, id, BLOCK)
    return keep_first(docs, rows.withColumn("node", F.col("text_hash")), labelled.select(F.col("text_hash").alias("node"), "label"), text, id)
