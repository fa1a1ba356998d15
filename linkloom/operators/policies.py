"""Decisions on scored pairs (s1_id, tid, tseq, prob, country) as filters and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cutoffs by country, and by country and source.
SEGMENT = {"US": 0.70, "India": 0.65, "France": 0.70}
BY_SOURCE = {("US", "S2"): 0.70, ("US", "S3"): 0.75, ("India", "S2"): 0.68, ("India", "S3"): 0.72, ("France", "S2"): 0.65, ("France", "S3"): 0.70}
DEFAULT, ALWAYS, RATIO, GATE, HUB_FLOOR = 0.70, 0.85, 0.75, 0.10, 0.82
#: main() keeps no pair below this, and its best pair decides nothing there.
LEAST = min(DEFAULT, ALWAYS, *SEGMENT.values())


def segment_threshold(default: float = DEFAULT) -> Column:
    out = F.when(F.lit(False), 0.0)
    for country, t in SEGMENT.items():
        out = out.when(F.col("country") == country, t)
    return out.otherwise(default)


def flat(scored: DataFrame, threshold: float = DEFAULT) -> DataFrame:
    return scored.where(F.col("prob") >= threshold)


def segment(scored: DataFrame, default: float = DEFAULT) -> DataFrame:
    return scored.where(F.col("prob") >= segment_threshold(default))


def main(scored: DataFrame, default: float = DEFAULT, threshold: Column | None = None) -> DataFrame:
    """At the cutoff or above and near the record's best; or so good that it is kept anyhow.

    The gate on the best pair decides nothing at cutoffs up to 0.95 but is kept for others.
    """
    cut = segment_threshold(default) if threshold is None else threshold
    top = F.max("prob").over(Window.partitionBy("s1_id"))
    kept = scored.withColumns({"_top": top, "_cut": cut}).where((F.col("_top") >= F.col("_cut") - GATE) & ((F.col("prob") >= F.col("_cut")) & (F.col("prob") >= RATIO * F.col("_top")) | (F.col("prob") >= ALWAYS)))
    return kept.drop("_top", "_cut")


def rank_prefix(scored: DataFrame, least: float = 0.50, ratio: float = 0.70, keep: int = 8) -> DataFrame:
    """The first `keep` pairs while good enough; none if the best is weak. Both conditions fall
    with the rank, so stopping at the first failure is a filter."""
    by = Window.partitionBy("s1_id")
    rank = F.row_number().over(by.orderBy(F.desc("prob"), "tseq"))
    out = scored.withColumns({"_rank": rank, "_top": F.max("prob").over(by)})
    floor = F.when(F.col("country") == "US", 0.65).otherwise(0.55)
    return out.where((F.col("_top") >= floor) & (F.col("_rank") <= keep) & (F.col("prob") >= least) & (F.col("prob") >= ratio * F.col("_top"))).drop("_rank", "_top")


def hybrid(scored: DataFrame, default: float = DEFAULT) -> DataFrame:
    """The main policy with a lower cutoff for India, then consistency; needs record fields."""
    cut = F.when(F.col("country") == "India", F.greatest(F.lit(0.65), F.lit(default - 0.05))).otherwise(default)
    return consistent(main(scored, default, cut))


def consistent(matched: DataFrame) -> DataFrame:
    """Drops matches that contradict the record, then those that contradict its best match.

    matched has l_ and r_ address_numbers and postal_code. A record's only match stays unchecked.
    """
    by = Window.partitionBy("s1_id")
    us, p = F.col("country") == "US", F.col("prob")

    def apart(a: str, b: str) -> Column:
        x, y = F.col(f"{a}address_numbers"), F.col(f"{b}address_numbers")
        return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)

    def other_post(a: str, b: str) -> Column:
        return us & F.coalesce(F.col(f"{a}postal_code") != F.col(f"{b}postal_code"), F.lit(False))

    first = matched.withColumn("_n", F.count("*").over(by)).where((F.col("_n") <= 1) | ~(other_post("l_", "r_") & (p < 0.85)) & ~(apart("l_", "r_") & (p < 0.88)))
    order = by.orderBy(F.desc("prob"), "tseq")
    top = F.first(F.struct(F.col("r_address_numbers").alias("address_numbers"), F.col("r_postal_code").alias("postal_code"))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    both = first.withColumns({"_rank": F.row_number().over(order), "_top": top})
    return both.where((F.col("_n") <= 1) | (F.col("_rank") == 1) | ~((apart("_top.", "r_") | other_post("_top.", "r_")) & (p < 0.85))).drop("_n", "_rank", "_top")


def exclusive(scored: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """Each target goes to the record where its probability is greatest (ties: by sseq, the
    record's order), after cutoffs by country and source; hubs (tid) need HUB_FLOOR at least.

    Taking pairs by falling probability and using up targets only, as a greedy pass does, gives
    every target its best pair: one window, no global sort.
    """
    s3 = F.col("tid").startswith("S3-") | F.lower("tid").contains("_s3_")
    known = [c for c, s in BY_SOURCE if s == "S2"]
    country = F.when(F.col("country").isin(known), F.col("country")).otherwise("US")
    cut = F.lit(DEFAULT)
    for (c, source), t in BY_SOURCE.items():
        cut = F.when((country == c) & (s3 if source == "S3" else ~s3), t).otherwise(cut)
    if hubs is not None:
        scored = scored.join(hubs.select("tid", F.lit(True).alias("_hub")), "tid", "left")
        cut = F.when(F.col("_hub"), F.greatest(cut, F.lit(HUB_FLOOR))).otherwise(cut)
    rank = F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("prob"), "sseq"))
    return scored.where(F.col("prob") >= cut).drop("_hub").withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def arbitrated(scored: DataFrame, low: float = 0.5, high: float = 0.8, fallback: float = 0.65, judge=None) -> DataFrame:  # noqa: ANN001
    """Pairs in [low, high) are decided by judge (a function of the DataFrame that gives a boolean
    column), or by the fallback cutoff where there is none; others by high."""
    verdict = F.col("prob") >= fallback if judge is None else judge(scored)
    return scored.where((F.col("prob") >= high) | (F.col("prob") >= low) & verdict)
