"""Candidate generation: keyed routes, capped postings, weighted sums, the top of each record.

Every route is an equi-join on (country, route, key). Postings are capped before the join, so a
common key costs its cap for each record that has it, never a product of groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, prefix_keys, tokens
from ..sources.storage import new_folder, stored

#: route: (weight, postings read for a key)
ROUTES = {"name": (5.0, None), "prefix": (3.5, 40), "trigram": (2.5, 30), "token": (2.5, 35), "postal": (4.0, 30), "addrnum": (2.5, 25)}
LEXICAL = ("name", "prefix", "token", "postal", "addrnum")
POSTED = ["key", "route", "country"]
COMMON_TOKEN, COMMON_WEIGHT, MAX_TOKEN = 100, 1.5, 1500
MAX_CANDIDATES, HUB = 20, 20
#: The reference's caps a source (train.py, train_upgraded.py).
DISTRACTORS, COMPETITORS = 250_000, 150_000


def _keys(routes: tuple[str, ...]) -> Column:
    """All (route, key) of a normalized record, repeats included where they count."""
    first = F.substring(F.get(tokens(F.col("root_name")), F.lit(0)), 1, 4)
    none = F.expr("cast(array() as array<string>)")
    words = F.slice(tokens(F.col("clean_address"), 4), 1, 3)
    of = {
        "name": F.when(F.length("root_name") >= 3, F.array("root_name")).otherwise(none),
        "prefix": prefix_keys(F.col("root_name")),
        "trigram": F.col("skeleton_3grams"),
        "token": F.array_distinct(tokens(F.col("root_name"), 3)),
        "postal": F.when(F.col("postal_code").isNotNull() & (F.length(first) >= 3), F.array(F.concat_ws(" ", "postal_code", first))).otherwise(none),
        "addrnum": let(words, lambda ws: F.flatten(F.transform(F.slice("address_numbers", 1, 2), lambda n: F.transform(ws, lambda w: F.concat_ws(" ", n, w))))),
    }

    def named(route: str) -> Column:
        return F.transform(of[route], lambda k: F.struct(F.lit(route).alias("route"), k.alias("key")))

    return F.concat(*map(named, routes))


def route_keys(records: DataFrame, id: str, routes: tuple[str, ...] = tuple(ROUTES)) -> DataFrame:
    """(country, route, key, id, seq, root_name), one row for each key of each record."""
    return records.select("country", F.col("entity_id").alias(id), "seq", "root_name", F.explode(_keys(routes)).alias("k")).select("country", "k.route", "k.key", id, "seq", "root_name")


def token_counts(targets: DataFrame) -> DataFrame:
    """(country, key, df): records of a country that have a token of three letters or more."""
    own = targets.select("country", F.explode(F.array_distinct(tokens(F.col("root_name"), 3))).alias("key"))
    return own.groupBy("country", "key").agg(F.count("*").alias("df"))


def postings(targets: DataFrame, routes: tuple[str, ...] = tuple(ROUTES), max_candidates: int = MAX_CANDIDATES) -> DataFrame:
    """(country, route, key, tid, tseq, troot, weight): for each key its first postings.

    The name route has no cap of its own. Of targets that are reached by it alone, all have the
    same score, and only the first max_candidates by seq can be kept; those reached otherwise too
    get its weight when the roots are compared. So it is capped there, with equal results.
    """
    rows = route_keys(targets, "tid", routes).withColumnsRenamed({"seq": "tseq", "root_name": "troot"})
    # Routes with one row for a record go by seq; trigrams and addresses hold a place per repeat.
    # Sorts compare the first eight bytes of the first column at once: so the key comes first.
    order = Window.partitionBy(*POSTED).orderBy("tseq")
    cap = F.create_map(*(F.lit(x) for r in routes for x in (r, ROUTES[r][1] or max_candidates)))
    largest = max(ROUTES[r][1] or max_candidates for r in routes)
    rows = rows.withColumn("place", F.row_number().over(order)).where((F.col("place") <= largest) & (F.col("place") <= cap[F.col("route")]))
    weight = F.create_map(*(F.lit(x) for r in routes for x in (r, 0.0 if r == "name" else ROUTES[r][0])))
    rows = rows.withColumn("weight", weight[F.col("route")])
    if "token" in routes:
        df = token_counts(targets).withColumn("route", F.lit("token"))
        rows = rows.join(df, POSTED, "left").where(f"df is null or df <= {MAX_TOKEN}")
        rows = rows.withColumn("weight", F.when(F.col("df") >= COMMON_TOKEN, COMMON_WEIGHT).otherwise(F.col("weight")))
    return rows.select("country", "route", "key", "tid", "tseq", "troot", "weight")


def _summed(hits: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """hits (s1_id, tid, tseq, w, same) as one row a pair, and the number of each row's record: in the
    order that records come in."""
    s1, tid = (hits[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("s1_id", "tid"))
    n = len(tid.dictionary)
    hits = hits.select(["tseq", "w", "same"]).append_column("pair", pa.array(s1.indices.to_numpy().astype(np.int64) * n + tid.indices.to_numpy()))
    sums = hits.group_by("pair", use_threads=False).aggregate([("tseq", "min"), ("w", "sum"), ("same", "max")])
    who, what = np.divmod(sums["pair"].to_numpy(), n)
    ids = [s1.dictionary.take(pa.array(who)), tid.dictionary.take(pa.array(what))]
    return pa.table([*ids, sums["tseq_min"], sums["w_sum"], sums["same_max"]], ["s1_id", "tid", "tseq", "w", "same"]), who


def _best(named: float, max_candidates: int, worth: Callable | None) -> Callable:
    """For mapInArrow over lists that records met (s1_id, weight, tids, tseqs, same), sorted by s1_id:
    the best pairs of each record. named: the weight of an equal name.

    It holds the pairs of a batch, and of its last record, which may go on in the next batch.
    """

    def hits(batch: pa.RecordBatch) -> pa.Table:
        tids, same = batch.column("tids"), batch.column("same")
        row = pc.list_parent_indices(tids).to_numpy()
        equal = np.zeros(len(row), np.int8)
        equal[same.is_valid().to_numpy(zero_copy_only=False)[row]] = pc.fill_null(same.flatten(), False).to_numpy(zero_copy_only=False)
        return pa.table([batch.column("s1_id").take(pa.array(row)), tids.flatten(), batch.column("tseqs").flatten(), batch.column("weight").take(pa.array(row)), pa.array(equal)], ["s1_id", "tid", "tseq", "w", "same"])

    def ranked(pairs: pa.Table, who: np.ndarray) -> pa.RecordBatch:
        score = pairs["w"].to_numpy() + named * pairs["same"].to_numpy()
        order = pairs["tseq"].cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()  # null first
        rows = np.arange(len(who)) if worth is None else np.flatnonzero(worth(score))
        rows = rows[np.lexsort((order[rows], -score[rows], who[rows]))]
        first = np.flatnonzero(np.diff(who[rows], prepend=-1))
        rank = np.arange(len(rows)) - np.repeat(first, np.diff(first, append=len(rows))) + 1
        rows, rank = rows[rank <= max_candidates], rank[rank <= max_candidates]
        kept = [pairs[c].combine_chunks().take(pa.array(rows)) for c in ("s1_id", "tid", "tseq")]
        return pa.RecordBatch.from_arrays([*kept, pa.array(score[rows]), pa.array(rank, pa.int32())], ["s1_id", "tid", "tseq", "score", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                pairs, who = _summed(hits(batch) if held is None else pa.concat_tables([held, hits(batch)]))
                if len(who):
                    last = who == who.max()
                    yield ranked(pairs.filter(pa.array(~last)), who[~last])
                    held = pairs.filter(pa.array(last))
        if held is not None:
            yield ranked(held, np.zeros(held.num_rows, np.int64))

    return run


def candidates(s1: DataFrame, targets: DataFrame, routes: tuple[str, ...] = tuple(ROUTES), max_candidates: int = MAX_CANDIDATES, posted: DataFrame | None = None, worth: Callable | None = None) -> DataFrame:
    """(s1_id, tid, tseq, score, rank): the best targets of each record, ties by seq.

    s1 and targets are normalized records with seq. posted: postings made before. worth: a condition
    on an array of scores that, where it holds, holds for all greater ones; pairs that fail it are not
    ranked.

    A key's postings, no more than its cap, are one row. A record gets the lists of its keys, and
    pairs are made where all lists of the record are: they are not dealt out themselves. Pairs are many
    times the lists, so they are summed up and ranked in numpy: on 1 GB, an aggregate of pairs and a
    window took a third of score_buckets' CPU time.
    """
    posted = postings(targets, routes, max_candidates) if posted is None else posted
    lists = posted.groupBy(*POSTED, "weight").agg(F.collect_list(F.struct("tid", "tseq", "troot")).alias("l"))
    lists = lists.select(*POSTED, "weight", F.col("l.tid").alias("tids"), F.col("l.tseq").alias("tseqs"), F.col("l.troot").alias("troots"))
    asked = route_keys(s1, "s1_id", routes).drop("seq")
    own = F.col("root_name")
    same = F.when((F.length(own) >= 3) & F.array_contains("troots", own), F.transform("troots", lambda x: x == own))
    met = asked.join(lists, POSTED).select("s1_id", "weight", "tids", "tseqs", same.alias("same")).repartition("s1_id").sortWithinPartitions("s1_id")
    kind = {f.name: f.dataType for f in met.schema}
    shape = f"s1_id {kind['s1_id'].simpleString()}, tid {kind['tids'].elementType.simpleString()}, tseq {kind['tseqs'].elementType.simpleString()}, score double, rank int"
    return met.mapInArrow(_best(ROUTES["name"][0] if "name" in routes else 0.0, max_candidates, worth), shape)


def hubs(targets: DataFrame, column: str = "clean_address", least: int = HUB) -> DataFrame:
    """(country, column, n) of addresses that `least` targets or more share."""
    return targets.where(F.col(column) != "").groupBy("country", column).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def first_rows(df: DataFrame, group: str, order: str, n: int, bins: int = 4096) -> DataFrame:
    """The first n rows of each group by a whole number, without sorting a group in one task.

    A histogram of bins of equal width tells which are whole among the first n; rows are ranked in
    the one bin that the n-th row is in. Groups are few (sources): a row of counts for each and bin
    is broadcast. Ties at the n-th place are broken by all columns.
    """
    df = stored(df, new_folder(df.sparkSession, "first"))
    span = df.groupBy(group).agg(F.min(order).alias("_low"), F.max(order).alias("_high"))
    binned = df.join(F.broadcast(span), group).withColumn("_bin", F.floor((F.col(order) - F.col("_low")).cast("double") * bins / (F.col("_high") - F.col("_low") + 1)))
    counts = binned.groupBy(group, "_bin").agg(F.count("*").alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(group).orderBy("_bin"))).where(F.col("_upto") - F.col("_n") < n)
    marked = binned.join(F.broadcast(upto), [group, "_bin"])
    whole, edge = marked.where(F.col("_upto") <= n), marked.where(F.col("_upto") > n)
    place = F.row_number().over(Window.partitionBy(group).orderBy(order, *(c for c in df.columns if c != order)))
    edge = edge.withColumn("_place", place).where(F.col("_place") <= n - F.col("_upto") + F.col("_n"))
    return whole.select(*df.columns).union(edge.select(*df.columns))


def competitors(s1: DataFrame, targets: DataFrame, needed: DataFrame, cap: int) -> DataFrame:
    """Targets that aren't needed but share a postal code or a prefix key with a record, the first
    `cap` of each source by seq."""
    postal = s1.where("postal_code is not null").select("postal_code").distinct()
    keys = s1.select(F.explode(prefix_keys(F.col("root_name"))).alias("key")).distinct()
    by_postal = targets.join(postal, "postal_code", "left_semi").select("entity_id", "seq", "bucket")
    by_key = targets.select("entity_id", "seq", "bucket", F.explode(prefix_keys(F.col("root_name"))).alias("key")).join(keys, "key", "left_semi").select("entity_id", "seq", "bucket")
    found = by_postal.union(by_key).distinct().join(needed.select(F.col("tid").alias("entity_id")), "entity_id", "left_anti")
    return first_rows(found, "bucket", "seq", cap).select("entity_id", "seq", "bucket")


def training_targets(targets: DataFrame, needed: DataFrame, distractors: int) -> DataFrame:
    """Needed targets, and the first `distractors` others of each source by seq."""
    own = targets.join(needed.select(F.col("tid").alias("entity_id")).distinct(), "entity_id", "left_semi")
    rest = targets.join(needed.select(F.col("tid").alias("entity_id")), "entity_id", "left_anti")
    return own.unionByName(first_rows(rest, "bucket", "seq", distractors))
