"""Pair features. All but the string similarities are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import FIELDS, MEASURES, similarities
from ..functions.text import tokens

# The names of the features, in the order that models take them.
BASE = (
    "name_sort", "name_set", "root_sort", "root_set", "root_partial", "root_ratio", "name_jw", "skeleton_jw", "len_diff", "len_ratio", "suf_match", "suf_conflict", "addr_set", "addr_sort", "addr_partial",
    "num_score", "first_num_match", "post_score", "shared_name_tokens", "shared_addr_tokens", "retrieval_score", "is_s2", "is_s3", "has_non_latin", "is_domiciliation_hub",
)
META = (
    "name_sort", "name_set", "root_sort", "root_set", "root_partial", "root_ratio", "name_jw", "len_diff", "len_ratio", "suf_match", "suf_conflict", "addr_set", "addr_sort", "addr_partial",
    "num_score", "post_score", "shared_name_tokens", "shared_addr_tokens", "retrieval_score", "is_s2", "has_non_latin", "dense_sim", "rrf_score", "dense_sim_cubed", "num_conflict_strict",
)
FIELDS_USED = (*FIELDS, "legal_suffix", "address_numbers", "postal_code", "is_non_latin")


def with_records(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs (s1_id, tid, ...) with the fields of both records, prefixed l_ and r_."""
    for df, side, key in ((s1, "l_", "s1_id"), (targets, "r_", "tid")):
        pairs = pairs.join(df.select(F.col("entity_id").alias(key), *(F.col(c).alias(side + c) for c in FIELDS_USED)), key)
    return pairs


def _sign(known: Column, agree: Column) -> Column:
    return F.when(known & agree, 1.0).when(known, -1.0).otherwise(0.0)


def lengths() -> dict[str, Column]:
    a, b = F.length("l_root_name"), F.length("r_root_name")
    return {"len_diff": F.abs(a - b).cast("double"), "len_ratio": F.least(a, b) / F.greatest(a, b, F.lit(1))}


def suffixes() -> dict[str, Column]:
    a, b = F.col("l_legal_suffix"), F.col("r_legal_suffix")
    return {"suf_match": ((a != "") & (a == b)).cast("double"), "suf_conflict": ((a != "") & (b != "") & (a != b)).cast("double")}


def numerics() -> dict[str, Column]:
    a, b = F.col("l_address_numbers"), F.col("r_address_numbers")
    both = (F.size(a) > 0) & (F.size(b) > 0)
    p, q = F.col("l_postal_code"), F.col("r_postal_code")
    return {
        "num_score": _sign(both, F.arrays_overlap(a, b)),
        "first_num_match": _sign(both, F.get(a, F.lit(0)) == F.get(b, F.lit(0))),
        "post_score": _sign(p.isNotNull() & q.isNotNull(), p == q),
    }


def overlaps() -> dict[str, Column]:
    shared = lambda c: F.size(F.array_intersect(tokens(F.col(f"l_{c}")), tokens(F.col(f"r_{c}")))).cast("double")
    return {"shared_name_tokens": shared("root_name"), "shared_addr_tokens": shared("clean_address")}


def native(hub: Column | None = None) -> dict[str, Column]:
    tid = F.col("tid")
    low = F.lower(tid)
    return {
        **lengths(), **suffixes(), **numerics(), **overlaps(),
        "is_s2": (tid.startswith("S2-") | low.contains("_s2_")).cast("double"), "is_s3": (tid.startswith("S3-") | low.contains("_s3_")).cast("double"),
        "has_non_latin": (F.col("l_is_non_latin") | F.col("r_is_non_latin")).cast("double"),
        "is_domiciliation_hub": F.lit(0.0) if hub is None else hub.cast("double"),
    }


def measured(pairs: DataFrame) -> DataFrame:
    """pairs with the string similarities of their records' fields."""
    # One UDF call for all measures; the struct is made once, not for each field. The measures are
    # far dearer than rows are large, so pairs are dealt to all tasks, not by size. (By a hash of
    # the keys: an exchange by the keys themselves may be taken for one that was merged by size.)
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = pairs.repartition(tasks, F.xxhash64("s1_id", "tid")).withColumn("_m", similarities(*(F.col(side + c) for c in FIELDS for side in ("l_", "r_"))))
    return got.withColumns({m: F.col(f"_m.{m}") for m in MEASURES}).drop("_m")


def base_features(pairs: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """Pairs with records (and score, if blocked) plus the 25 base features.

    hubs: (country, clean_address) that many records share; pairs then need r_country.
    """
    out = measured(pairs)
    out = out.withColumn("retrieval_score", F.col("score") if "score" in pairs.columns else F.lit(1.0))
    hub = None
    if hubs is not None:
        marked = hubs.select(F.col("country").alias("r_country"), F.col("clean_address").alias("r_clean_address"), F.lit(True).alias("_hub"))
        out = out.join(marked, ["r_country", "r_clean_address"], "left")
        hub = F.coalesce("_hub", F.lit(False))
    return out.withColumns(native(hub)).drop("_hub")


def meta_features(pairs: DataFrame) -> DataFrame:
    """Pairs with records, rrf_score and dense_sim, plus the 25 meta features (rrf comes twice)."""
    out = measured(pairs).withColumns(native())
    numbers = (F.size("l_address_numbers") > 0) & (F.size("r_address_numbers") > 0)
    strict = numbers & ~F.arrays_overlap("l_address_numbers", "r_address_numbers") & (F.col("addr_set") > 0.65)
    return out.withColumns({"retrieval_score": F.col("rrf_score"), "dense_sim_cubed": F.pow("dense_sim", F.lit(3.0)), "num_conflict_strict": strict.cast("double")})


def context_features(scored: DataFrame) -> DataFrame:
    """scored (s1_id, tid, tseq, prob) with rank, best, gap to the best and to the second."""
    by, whole = Window.partitionBy("s1_id"), None
    order = by.orderBy(F.desc("prob"), "tseq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(order)
    best = F.first("prob").over(whole)
    second = F.coalesce(F.nth_value("prob", 2).over(whole), best)
    out = scored.withColumns({"ctx_rank": rank, "ctx_max": best, "_second": second})
    return out.withColumns({"ctx_gap_max": F.col("ctx_max") - F.col("prob"), "ctx_gap_second": F.when(F.col("ctx_rank") == 1, F.col("prob") - F.col("_second")).otherwise(F.col("prob") - F.col("ctx_max"))}).drop("_second")
