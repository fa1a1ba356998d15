"""Helpers the operators share: shared storage, Arrow columns, batched text mapping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources.storage import drop, new_folder, shared_folder, stored  # noqa: F401


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage."""
    return stored(df, new_folder(df.sparkSession, "cut"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[ends[0] : ends[-1]] if len(ends) else flat[:0], ends - ends[0] if len(ends) else np.zeros(1, np.int64)


def runs(offsets: np.ndarray, target: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about target bytes each; a longer document goes alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + target, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches: what a worker holds as Python objects at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def texts(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, step: int = 1 << 22) -> np.ndarray:
    """Whether the size[i] bytes from a[i] equal those from b[i], for all i."""
    out = np.ones(len(a), bool)
    ends = np.cumsum(size)
    first = 0
    while first < len(a):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + step, "right")))
        n = size[first:last]
        if last - first == 1:  # one that may be long: as slices
            out[first] = np.array_equal(data[a[first] : a[first] + n[0]], data[b[first] : b[first] + n[0]])
        else:
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            differ = data[np.repeat(a[first:last], n) + inside] != data[np.repeat(b[first:last], n) + inside]
            out[first:last] = np.bincount(np.repeat(np.arange(last - first), n)[differ], minlength=last - first) == 0
        first = last
    return out
