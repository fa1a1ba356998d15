"""The driver's Parquet tables, and business records derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators.classes import Classes

#: Characters that are split first; most texts have their first words there.
BEGINNING = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity_view(documents: DataFrame) -> DataFrame:
    """Records of three sources (bucket 1 to 3) from documents: the first words as a name, the
    next as an address, the language as a country. seq is the order of arrival."""
    # 18 words are used, 19 pieces where the text begins with a space. Where the beginning has these
    # and more behind them, they are the text's; else the text itself is split.
    pieces = lambda c: F.split(c, r"\s+", 20)
    text = F.coalesce("text", F.lit(""))
    words = F.filter(let(pieces(F.substring(text, 1, BEGINNING)), lambda p: F.when(F.size(p) == 20, p).otherwise(pieces(text))), lambda x: x != "")
    n = F.col("n_chars").cast("string")
    postal = F.when(F.col("lang").isin("en", "fr"), F.lpad(n, 5, "0")).when(F.col("lang") == "es", (100000 + F.col("n_chars")).cast("string")).otherwise("")
    country = F.when(F.col("lang") == "en", "US").when(F.col("lang") == "fr", "France").when(F.col("lang") == "es", "India").otherwise("Germany")
    bucket = 1 + F.expr("int(substr(source, 4)) % 3")
    return documents.withColumn("_words", words).select(
        F.concat(F.lit("S"), bucket, F.lit("-"), F.col("doc_id")).alias("entity_id"),
        F.array_join(F.slice("_words", 1, 6), " ").alias("business_name"),
        F.trim(F.concat(n, F.lit(" "), F.array_join(F.slice("_words", 7, 12), " "), F.lit(" "), postal)).alias("business_address"),
        country.alias("country"),
        (bucket.cast("long") * 1_000_000_000 + F.col("doc_id")).alias("seq"),
        bucket.alias("bucket"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_view(table(spark, sf_dir, "documents"))


def truth_pairs(records: DataFrame) -> DataFrame:
    """(s1_id, tid): records of source 1 and others of the same name and country."""
    s1 = records.where("bucket = 1").select(F.col("entity_id").alias("s1_id"), "country", "business_name")
    other = records.where("bucket > 1").select(F.col("entity_id").alias("tid"), "country", "business_name")
    return s1.join(other, ["country", "business_name"]).select("s1_id", "tid")


def truth_classes(records: DataFrame) -> Classes:
    """The links of truth_pairs, unlisted: a class is a name in a country."""
    known = records.where("country is not null and business_name is not null").select("bucket", "entity_id", F.struct("country", "business_name").alias("class")).distinct()
    return Classes(known.where("bucket = 1").select(F.col("entity_id").alias("s1_id"), "class"), known.where("bucket > 1").select(F.col("entity_id").alias("tid"), "class").distinct())
