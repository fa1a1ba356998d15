"""Inference and training end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators import blocking, evaluation, features, models, policies
from ..sources.storage import new_folder, stored


def normalized(records: DataFrame, other_scripts: bool = True) -> DataFrame:
    """Normalized records, written once to the shared folder: all that follows reads them several
    times, by the columns it needs."""
    return stored(normalize(records, other_scripts), new_folder(records.sparkSession, "normalized"))


def parted(n: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalized records of source 1, and of the others."""
    return n.where("bucket = 1"), n.where("bucket > 1")


def sides(records: DataFrame, other_scripts: bool = True) -> tuple[DataFrame, DataFrame]:
    return parted(normalized(records, other_scripts))


def blocked(records: DataFrame, other_scripts: bool = True, routes: tuple[str, ...] = tuple(blocking.ROUTES), max_candidates: int = blocking.MAX_CANDIDATES) -> DataFrame:
    s1, targets = sides(records, other_scripts)
    return blocking.candidates(s1, targets, routes, max_candidates)


def ruled(s1: DataFrame, targets: DataFrame, max_candidates: int = blocking.MAX_CANDIDATES, least: float = 0.0) -> DataFrame:
    """Candidates of normalized records with a probability that only depends on the retrieval
    score: for policies without a trained model. (s1_id, tid, tseq, sseq, country, prob)

    least: pairs below it are left out, for policies that keep none of them.
    """
    prob = lambda score: score / (score + 5.0)
    pairs = blocking.candidates(s1, targets, max_candidates=max_candidates, worth=(lambda score: prob(score) >= least) if least else None)
    own = s1.select(F.col("entity_id").alias("s1_id"), F.col("seq").alias("sseq"), "country")
    return pairs.join(own, "s1_id").select("s1_id", "tid", "tseq", "sseq", "country", prob(F.col("score")).alias("prob"))


def scored_by_rule(records: DataFrame, max_candidates: int = blocking.MAX_CANDIDATES) -> DataFrame:
    return ruled(*sides(records), max_candidates)


def featured(records: DataFrame, other_scripts: bool = True) -> DataFrame:
    """Candidate pairs with base features, hubs included, and both records' order and country."""
    return compared(*sides(records, other_scripts))


def compared(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """featured() of normalized records."""
    pairs = blocking.candidates(s1, targets)
    both = features.with_records(pairs, s1, targets)
    own = s1.select(F.col("entity_id").alias("s1_id"), F.col("seq").alias("sseq"), "country")
    both = both.join(own, "s1_id").withColumn("r_country", F.col("country"))
    return features.base_features(both, blocking.hubs(targets))


def train(pairs: DataFrame, truth: DataFrame, cut: int, rounds: int = 200, trees: int = 200) -> tuple[models.Ensemble, DataFrame]:
    """An ensemble fitted on records up to `cut` and calibrated on the rest; the rest, scored."""
    known = models.labelled(pairs, truth)
    fit, validation = models.split(known, cut)
    ensemble = models.Ensemble.fit(fit, rounds=rounds, trees=trees).calibrate(validation)
    return ensemble, ensemble.predict(validation)


def pick_threshold(s1: DataFrame, truth: DataFrame, scored: DataFrame) -> float:
    row = evaluation.best(evaluation.grid_scores(s1, truth, evaluation.threshold_grid(scored))).first()
    return evaluation.THRESHOLDS[row["idx"]] if row else policies.DEFAULT


def matches(records: DataFrame, ensemble: models.Ensemble | None = None) -> DataFrame:
    """Final pairs (s1_id, tid, prob): block, score, decide, check consistency, one record for
    each target."""
    if ensemble is None:
        s1, targets = sides(records)
        return decided(features.with_records(ruled(s1, targets), s1, targets))
    return decided(ensemble.predict(featured(records)))


def decided(pairs: DataFrame) -> DataFrame:
    """The final ones of scored pairs."""
    return policies.exclusive(policies.consistent(policies.main(pairs))).select("s1_id", "tid", "prob")
