"""Dense retrieval and rank fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import new_folder, stored
from . import validation

RRF_K = 60
#: Vectors of a block, and queries that are multiplied with a block at once.
BLOCK, ROWS = 16_384, 256


def normalized(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors of length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.withColumn(column, F.transform(column, lambda x: F.when(norm == 0, 0.0).otherwise(x.cast("double") / norm)))


def embedded(texts: DataFrame, encode: Callable[[list[str]], np.ndarray], model: str, cache: str | None = None, batch: int = 256) -> DataFrame:
    """texts (id, part, text) with embedding, by encode: a function from a list of texts to a matrix.

    cache: a folder of (model, key, embedding) Parquet, by the text's SHA-256: known texts are
    looked up, only new ones encoded, each distinct text once, and added. Null texts count as empty.
    """
    keyed = texts.withColumn("_key", F.sha2(F.coalesce("text", F.lit("")), 256))
    todo = keyed.select("_key", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["_key"])
    spark = texts.sparkSession
    shape = "model string, _key string, embedding array<double>"
    known = None
    if cache and validation.exists(spark, cache):
        known = spark.read.schema(shape).parquet(cache).where(F.col("model") == model)
        todo = todo.join(known.select("_key"), "_key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                rows = np.asarray(encode(part.column("text").to_pylist()), float)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([model] * len(rows), pa.string()), part.column("_key"), lists], ["model", "_key", "embedding"])

    made = todo.select("_key", "text").mapInArrow(run, shape)
    if cache:
        made = stored(made, new_folder(spark, "embedded"))  # before the cache that it is made from grows
        made.write.mode("append").parquet(cache)
    known = made if known is None else known.union(made) if not cache else spark.read.schema(shape).parquet(cache).where(F.col("model") == model)
    return keyed.join(known.dropDuplicates(["_key"]).select("_key", "embedding"), "_key").select("id", "part", "embedding")


def dense_topk(queries: DataFrame, targets: DataFrame, k: int = 35, least: float | None = None) -> DataFrame:
    """(s1_id, tid, dense_sim, rank) from (id, part, embedding): the most similar targets of the
    query's partition, ties by id.

    Comparing all of a partition is this operator's definition. Vectors are packed into blocks of
    about BLOCK, dealt by size; every pair of blocks of a partition is one matrix product, of which
    only the best k of each query leave the task. Products choose, with room for their rounding;
    what they choose is summed again in the vector's order, so equal vectors tie exactly.
    """
    pairs = _blocks(queries, "s1_").join(_blocks(targets, "t_"), "part")
    kinds = queries.schema["id"].dataType.simpleString(), targets.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = [b.column(c)[i].values for c in ("s1_ids", "t_ids")]
                q, t = (np.frombuffer(b.column(c)[i].as_py(), float).reshape(len(x), -1) for c, x in zip(("s1_vectors", "t_vectors"), ids))
                order = np.argsort(np.argsort(np.array(ids[1].to_pylist()), kind="stable"), kind="stable")
                for first in range(0, len(q), ROWS):
                    part = q[first : first + ROWS]
                    close = part @ t.T
                    floor = np.partition(close, -k, axis=1)[:, -k] if k < len(t) else np.full(len(part), -np.inf)
                    mine, its = np.nonzero(close >= floor[:, None] - 1e-9)
                    sim = np.zeros(len(mine))
                    for d in range(q.shape[1]):
                        sim += part[mine, d] * t[its, d]
                    by = np.lexsort((order[its], -sim, mine))
                    mine, its, sim = mine[by], its[by], sim[by]
                    place = np.arange(len(mine)) - np.searchsorted(mine, mine)
                    kept = (place < k) & (sim >= least if least is not None else True)
                    yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(mine[kept] + first)), ids[1].take(pa.array(its[kept])), pa.array(sim[kept])], ["s1_id", "tid", "dense_sim"])

    near = pairs.repartition(F.xxhash64("s1_block", "t_block", "part")).select("s1_ids", "s1_vectors", "t_ids", "t_vectors").mapInArrow(run, f"s1_id {kinds[0]}, tid {kinds[1]}, dense_sim double")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("dense_sim"), "tid"))).where(F.col("rank") <= k).select("s1_id", "tid", "dense_sim", "rank")


def _blocks(df: DataFrame, name: str) -> DataFrame:
    """Vectors of length one packed by partition: (part, block, ids, vectors)."""
    blocks = max(1, -(-df.count() // BLOCK))
    dealt = normalized(df).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition("part", "block").sortWithinPartitions("part", "block", "id")
    kinds = {c: df.schema[c].dataType.simpleString() for c in ("part", "id")}

    def pack(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        vectors = t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).tobytes()
        ids = pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t["id"].combine_chunks())
        return pa.RecordBatch.from_arrays([t["part"].combine_chunks()[:1], t["block"].combine_chunks()[:1], ids, pa.array([vectors], pa.binary())], ["part", f"{name}block", f"{name}ids", f"{name}vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, n = [], None, 0
        for b in batches:
            codes = list(zip(b.column("part").to_pylist(), b.column("block").to_pylist()))
            first = 0
            while first < len(codes):
                last = first
                while last < len(codes) and codes[last] == codes[first]:
                    last += 1
                if codes[first] != key or n >= BLOCK:
                    if held:
                        yield pack(held)
                    held, key, n = [], codes[first], 0
                held.append(b.slice(first, last - first))
                n += last - first
                first = last
        if held:
            yield pack(held)

    return dealt.select("part", "block", "id", "embedding").mapInArrow(run, f"part {kinds['part']}, {name}block int, {name}ids array<{kinds['id']}>, {name}vectors binary")


def rrf(lists: list[DataFrame], k: int = RRF_K, limit: int = 35) -> DataFrame:
    """(s1_id, tid, rrf_score, rank) from ranked lists (s1_id, tid, rank from 1): reciprocal rank
    fusion, with places counted from 0; ties by tid."""
    parts = None
    for df in lists:
        part = df.select("s1_id", "tid", (1.0 / (F.lit(k) + F.col("rank") - 1)).alias("s"))
        parts = part if parts is None else parts.unionByName(part)
    fused = parts.groupBy("s1_id", "tid").agg(F.sum("s").alias("rrf_score"))
    order = Window.partitionBy("s1_id").orderBy(F.desc("rrf_score"), "tid")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
