"""Joins whose left side may have a key that holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one task may take, and the most keys that may be hot: with n rows a key is hot
#: beyond n / MOST rows, so there are never more than MOST of them to broadcast.
HOT, MOST = 500, 100_000


def share(rows: int) -> int:
    """Rows beyond which a key is hot, of so many in all."""
    return max(HOT, rows // MOST)


def spread_join(rows: DataFrame, ones: DataFrame, key: str, by: str, sizes: DataFrame | None = None) -> DataFrame:
    """rows joined with ones (at most one row a key) on key, where no task takes a hot key alone.

    A hot key's rows are dealt to parts by the hash of the column `by`, its row of ones goes to each.
    sizes: a frame that is cheaper to read and has each hot key about as often as rows (rows itself).
    Rows with a null key meet nothing, as in any join. Neither side may have columns _parts, _part.
    """
    sizes = rows if sizes is None else sizes
    counts = sizes.groupBy(key).agg(F.count("*").alias("n"))
    total, largest = counts.agg(F.sum("n"), F.max("n")).first()
    limit = share(total or 0)
    if (largest or 0) <= limit:
        return rows.join(ones, key)
    hot = F.broadcast(counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    each = ones.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(each, [key, "_part"]).drop("_part")
