"""Reports on raw records and truth lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import script_group

FIELDS = ("business_name", "business_address", "country")


def countries(records: DataFrame) -> DataFrame:
    return records.groupBy("country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country")


def missing(records: DataFrame) -> DataFrame:
    """One row: blank values of each field."""
    return records.agg(*(F.count_if(F.coalesce(c, F.lit("")) == "").alias(c) for c in FIELDS))


def scripts(records: DataFrame, column: str = "business_name") -> DataFrame:
    return records.groupBy(script_group(column).alias("script_group")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "script_group")


def lengths(records: DataFrame, columns: tuple[str, ...] = FIELDS[:2]) -> DataFrame:
    """(field, mean, p50, p95, max): percentiles are the values at place floor(p (n - 1)).

    From counts by length, so nothing is sorted but the distinct lengths.
    """
    out = None
    for c in columns:
        counts = records.groupBy(F.length(F.coalesce(c, F.lit(""))).alias("len")).agg(F.count("*").alias("k"))
        # Distinct lengths are few: a window over them all is small.
        ranked = counts.selectExpr("len", "k", "sum(k) over (order by len) as upto", "sum(k) over () as n")
        at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("n") - 1)), F.col("len"))).cast("long")
        row = ranked.agg(F.lit(c).alias("field"), F.round(F.sum(F.col("len") * F.col("k")) / F.max("n"), 2).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("len").cast("long").alias("max"))
        out = row if out is None else out.union(row)
    return out


def truth_summary(s1: DataFrame, truth: DataFrame) -> DataFrame:
    """(n_links, entities, s2_links, s3_links): the histogram of links per record."""
    per = truth.groupBy("s1_id").agg(F.count("*").alias("n"), F.count_if(F.col("tid").startswith("S2-")).alias("s2"), F.count_if(F.col("tid").startswith("S3-")).alias("s3"))
    rows = s1.select("s1_id").join(per, "s1_id", "left").na.fill(0)
    return rows.groupBy(F.col("n").alias("n_links")).agg(F.count("*").alias("entities"), F.sum("s2").alias("s2_links"), F.sum("s3").alias("s3_links"))


def report(records: DataFrame, s1: DataFrame | None = None, truth: DataFrame | None = None) -> dict:
    """All of the above as a dictionary; every table in it is an aggregate."""
    rows = records.count()
    out = {"rows": rows, "countries": {r["country"]: r["n"] for r in countries(records).collect()}, "missing": missing(records).first().asDict()}
    for field, c in (("name_scripts", "business_name"), ("address_scripts", "business_address")):
        out[field] = {r["script_group"]: r["n"] for r in scripts(records, c).collect()}
    out["lengths"] = {r["field"]: {k: r[k] for k in ("mean", "p50", "p95", "max")} for r in lengths(records).collect()}
    if truth is not None:
        rows = [r.asDict() for r in truth_summary(s1, truth).collect()]
        n, links = sum(r["entities"] for r in rows), sum(r["s2_links"] + r["s3_links"] for r in rows)
        alone = sum(r["entities"] for r in rows if not r["n_links"])
        out["truth"] = {"source1_rows": n, "total_links": links, "links_per_source1": round(links / n, 5) if n else 0.0, "singletons": alone, "singleton_rate": round(alone / n, 5) if n else 0.0, "match_count_distribution": {r["n_links"]: r["entities"] for r in sorted(rows, key=lambda r: r["n_links"])}}
    return out
