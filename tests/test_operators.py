"""Record-linkage operators on small fixtures."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linkloom.functions.text import normalize
from linkloom.operators import audit, blocking, clusters, evaluation, features, models, numbering, policies, ranking, skew, validation
from linkloom.plans import matching, queries
from linkloom.sources import files
from linkloom.sources.tables import entities, truth_pairs

SCORED = "s1_id string, tid string, tseq long, sseq long, country string, prob double"


def ids(df):
    return sorted((r["s1_id"], r["tid"]) for r in df.collect())


def records(spark, rows):
    return normalize(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string, seq long, bucket int"), False)


def test_every_query_runs_and_has_a_stable_schema(spark, sf):
    for name, q in queries.QUERIES.items():
        if name not in ("train_ensemble", "stream_candidates", "features_meta"):
            assert q(spark, sf).columns, name


def test_postings_are_capped_in_order_of_arrival(spark):
    rows = [(f"S2-{i}", "alpha beta", "", "US", i, 2) for i in range(100, 150)]
    got = blocking.postings(records(spark, rows))
    sizes = {r["route"]: r["n"] for r in got.groupBy("route", "key").agg(F.count("*").alias("n")).collect()}
    assert (sizes["prefix"], sizes["trigram"], sizes["token"], sizes["name"]) == (40, 30, 35, 20)
    assert got.where("route = 'token'").agg(F.max("tseq")).first()[0] == 134


def test_repeated_trigrams_hold_places(spark):
    one = records(spark, [("S1-1", "bbbbb", "", "US", 1, 1)])
    two = records(spark, [("S2-1", "bbbbb", "", "US", 2, 2)])
    got = blocking.candidates(one, two, routes=("trigram",)).first()
    assert got["score"] == 9 * 2.5


def test_common_tokens_weigh_less_and_very_common_nothing(spark):
    s1 = records(spark, [("S1-1", "rare common vast", "", "US", 1, 1)])
    rows = [("S2-1", "rare", "", "US", 2, 2)] + [(f"S2-c{i}", "common", "", "US", 10 + i, 2) for i in range(100)] + [(f"S2-v{i}", "vast", "", "US", 1000 + i, 2) for i in range(1501)]
    got = {r["tid"]: r["score"] for r in blocking.candidates(s1, records(spark, rows), routes=("token",), max_candidates=100).collect()}
    assert got["S2-1"] == 2.5 and got["S2-c0"] == 1.5 and len(got) == 36


def test_name_cap_equals_no_cap(spark):
    rng = random.Random(1)
    names = ["alpha beta", "alpha beta gamma", "gamma", "delta beta"]
    rows = [(f"S2-{i}", rng.choice(names), f"{rng.randint(1, 3)} long street {rng.randint(10000, 10003)}", "US", 100 + i, 2) for i in range(300)]
    s1 = records(spark, [(f"S1-{i}", rng.choice(names), f"{rng.randint(1, 3)} long street {rng.randint(10000, 10003)}", "US", i, 1) for i in range(12)])
    targets = records(spark, rows)
    got = ids(blocking.candidates(s1, targets))
    whole = blocking.candidates(s1, targets, max_candidates=1000)  # a cap no name reaches
    want = ids(whole.where("rank <= 20"))
    assert got == want and len(got) == 240


def test_pairs_are_made_where_a_records_lists_are(spark):
    s1, targets = (records(spark, [(f"S{k}-1", "alpha beta", "", "US", k, k)]) for k in (1, 2))
    plan = blocking.candidates(s1, targets)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(s1_id") == 1, plan  # the lists; pairs are dealt neither by target nor for the rank


def test_singleton_stats_deals_out_no_pairs(spark, sf):
    plan = queries.singleton_stats(spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(s1_id#\d+, tid#", plan)
    assert len(dealt) == 1, plan  # links of ids in several classes; candidates aren't


def test_pairs_are_no_rows_of_an_aggregate(spark):
    s1, targets = (records(spark, [(f"S{k}-1", "alpha beta", "", "US", k, k)]) for k in (1, 2))
    plan = blocking.candidates(s1, targets)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "MapInArrow" in plan


def test_records_go_on_in_the_next_batch(spark, sf):
    s1, targets = matching.sides(entities(spark, sf))
    more = s1.withColumn("root_name", F.concat("root_name", F.lit(" amber"))).union(s1)  # ids that stand in two rows, and none
    more = more.union(s1.limit(9).withColumn("entity_id", F.lit(None).cast("string")))
    want = sorted(map(tuple, blocking.candidates(more, targets).collect()), key=str)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(map(tuple, blocking.candidates(more, targets).collect()), key=str) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_best_pairs_equal_a_plain_count(spark, sf):
    s1, targets = matching.sides(entities(spark, sf))
    lists, roots = defaultdict(list), {r["entity_id"]: r["root_name"] for r in s1.collect()}
    for r in blocking.postings(targets).collect():
        lists[r["country"], r["route"], r["key"]].append(r)
    found = defaultdict(lambda: [0.0, 0, 0.0])
    for a in blocking.route_keys(s1, "s1_id").collect():
        for r in lists[a["country"], a["route"], a["key"]]:
            pair = found[a["s1_id"], r["tid"]]
            pair[0], pair[1] = pair[0] + r["weight"], r["tseq"]
            pair[2] = blocking.ROUTES["name"][0] if r["troot"] == roots[a["s1_id"]] and len(r["troot"]) >= 3 else 0.0
    want, by = set(), defaultdict(list)
    for (a, b), (w, tseq, named) in found.items():
        by[a].append((-w - named, tseq, b))
    for a, pairs in by.items():
        want |= {(a, b, tseq, -score, i + 1) for i, (score, tseq, b) in enumerate(sorted(pairs)[: blocking.MAX_CANDIDATES])}
    assert {tuple(r) for r in blocking.candidates(s1, targets).collect()} == want and want


def test_pairs_that_no_policy_keeps_are_not_ranked(spark, sf):
    s1, targets = matching.sides(entities(spark, sf))
    whole, worth = matching.ruled(s1, targets), matching.ruled(s1, targets, least=policies.LEAST)
    assert 0 < worth.count() < whole.count() and worth.where(F.col("prob") < policies.LEAST).isEmpty()
    want = policies.main(whole)
    got = policies.main(worth).select(*want.columns)
    assert got.count() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_countries_dont_meet(spark):
    s1, targets = records(spark, [("S1-1", "alpha beta", "", "US", 1, 1)]), records(spark, [("S2-1", "alpha beta", "", "India", 2, 2)])
    assert blocking.candidates(s1, targets).count() == 0


def test_features(spark):
    s1 = records(spark, [("S1-1", "Alpha Beta Ltd", "12 Long Street 75001", "France", 1, 1), ("S1-2", "", "", "US", 2, 1)])
    t = records(spark, [("S3-1", "Beta Alpha Inc", "14 Long Street 75002", "France", 3, 3), ("S2-2", "Alpha Beta Ltd", "12 Long Street 75001", "France", 4, 2)])
    pairs = spark.createDataFrame([("S1-1", "S3-1"), ("S1-1", "S2-2"), ("S1-2", "S3-1")], "s1_id string, tid string")
    got = {(r["s1_id"], r["tid"]): r for r in features.base_features(features.with_records(pairs, s1, t)).collect()}
    a, b, c = got["S1-1", "S3-1"], got["S1-1", "S2-2"], got["S1-2", "S3-1"]
    assert (a["root_sort"], a["suf_match"], a["suf_conflict"], a["num_score"], a["first_num_match"], a["post_score"], a["shared_name_tokens"], a["is_s3"], a["retrieval_score"]) == (1, 0, 1, -1, -1, -1, 2, 1, 1)
    assert all(b[f] == 1 for f in ("name_sort", "addr_set", "addr_partial", "name_jw", "suf_match", "num_score", "post_score", "is_s2", "len_ratio"))
    assert (c["num_score"], c["post_score"], c["name_jw"], c["len_ratio"]) == (0, 0, 0, 0)


def random_scored(spark, n=60, seed=0):
    rng = random.Random(seed)
    rows = {(f"S1-{rng.randint(0, n // 4)}", f"S{rng.randint(2, 3)}-{rng.randint(0, n // 3)}") for _ in range(n)}
    rows = [(s, t, int(t[3:]) + 1000 * int(t[1]), int(s[3:]), ["US", "India", "France", "Peru"][int(s[3:]) % 4], rng.randint(8, 20) / 20) for s, t in sorted(rows)]
    return rows, spark.createDataFrame(rows, SCORED)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_exclusive_equals_a_greedy_pass(spark, seed):
    rows, df = random_scored(spark, 120, seed)
    taken, want = set(), []
    for s, t, _, sseq, country, p in sorted(rows, key=lambda r: (-r[5], r[3])):
        key = (country if (country, "S2") in policies.BY_SOURCE else "US", t[:2])
        if p >= policies.BY_SOURCE[key] and t not in taken:
            taken.add(t)
            want.append((s, t))
    assert ids(policies.exclusive(df)) == sorted(want)


def test_exclusive_hubs(spark):
    df = spark.createDataFrame([("S1-1", "S2-1", 1, 1, "US", 0.81), ("S1-1", "S2-2", 2, 1, "US", 0.82), ("S1-1", "S2-3", 3, 1, "US", 0.71)], SCORED)
    assert ids(policies.exclusive(df, spark.createDataFrame([("S2-1",), ("S2-2",)], "tid string"))) == [("S1-1", "S2-2"), ("S1-1", "S2-3")]


@pytest.mark.parametrize("seed", [3, 4])
def test_policies_equal_loops(spark, seed):
    rows, df = random_scored(spark, 150, seed)
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    main, prefix = [], []
    for s, own in by.items():
        own.sort(key=lambda r: (-r[5], r[2]))
        top, country = own[0][5], own[0][4]
        th = policies.SEGMENT.get(country, 0.7)
        if top >= th - 0.1:
            main += [(s, r[1]) for r in own if r[5] >= th and r[5] >= 0.75 * top or r[5] >= 0.85]
        if top >= (0.65 if country == "US" else 0.55):
            for r in own[:8]:
                if not (r[5] >= 0.5 and r[5] >= 0.7 * top):
                    break
                prefix.append((s, r[1]))
    assert ids(policies.main(df)) == sorted(main)
    assert ids(policies.rank_prefix(df)) == sorted(prefix)


def test_consistency(spark):
    rows = [("S1-1", "S2-1", 1, 1, "US", 0.90, ["1"], ["1"], "10000", "10000"), ("S1-1", "S2-2", 2, 1, "US", 0.84, ["1"], ["1"], "10000", "20000"), ("S1-1", "S2-3", 3, 1, "US", 0.85, ["1"], ["1"], "10000", "20000"), ("S1-1", "S2-4", 4, 1, "US", 0.87, ["1"], ["2"], None, None), ("S1-1", "S2-5", 5, 1, "US", 0.88, ["1"], ["2"], None, None), ("S1-2", "S2-6", 6, 2, "US", 0.5, ["1"], ["2"], "1", "2"), ("S1-3", "S2-7", 7, 3, "India", 0.7, [], [], "1", "2"), ("S1-3", "S2-8", 8, 3, "India", 0.71, [], [], "1", "3")]
    df = spark.createDataFrame(rows, SCORED + ", l_address_numbers array<string>, r_address_numbers array<string>, l_postal_code string, r_postal_code string")
    assert ids(policies.consistent(df)) == [("S1-1", "S2-1"), ("S1-1", "S2-3"), ("S1-1", "S2-5"), ("S1-2", "S2-6"), ("S1-3", "S2-7"), ("S1-3", "S2-8")]


def test_arbiter(spark):
    df = spark.createDataFrame([("S1-1", f"S2-{i}", i, 1, "US", p) for i, p in enumerate((0.4, 0.5, 0.65, 0.8))], SCORED)
    assert [t for _, t in ids(policies.arbitrated(df))] == ["S2-2", "S2-3"]
    assert [t for _, t in ids(policies.arbitrated(df, judge=lambda d: d["tid"] == "S2-1"))] == ["S2-1", "S2-3"]


def test_metric(spark):
    s1 = spark.createDataFrame([(f"S1-{i}",) for i in range(6)], "s1_id string")
    truth = spark.createDataFrame([("S1-1", "a"), ("S1-2", "a"), ("S1-3", "a"), ("S1-3", "b"), ("S1-4", "a")], "s1_id string, tid string")
    pred = spark.createDataFrame([("S1-1", "a"), ("S1-1", "a"), ("S1-2", "b"), ("S1-3", "a"), ("S1-5", "q")], "s1_id string, tid string")
    got = {r["s1_id"]: round(r["f05"], 6) for r in evaluation.per_record(s1, truth, pred).collect()}
    assert got == {"S1-0": 1.0, "S1-1": 1.0, "S1-2": 0.0, "S1-3": round(1.25 * 0.5 / 0.75, 6), "S1-4": 0.0, "S1-5": 0.0}
    row = evaluation.summary(evaluation.per_record(s1, truth, pred)).first()
    assert (row["entities"], row["exact_lists"], row["true_singletons"], row["correct_singletons"], row["false_merges"]) == (6, 2, 2, 1, 1)
    with pytest.raises(ValueError):
        evaluation.checked(s1, pred)


def test_rank_fusion(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "s1_id string, tid string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("r", "z", 1)], "s1_id string, tid string, rank int")
    got = {(r["s1_id"], r["tid"]): (r["rrf_score"], r["rank"]) for r in ranking.rrf([a, b]).collect()}
    assert got["q", "y"] == (pytest.approx(1 / 61 + 1 / 60), 1) and got["q", "x"] == (pytest.approx(1 / 60), 2) and got["r", "z"][1] == 1


def test_context(spark):
    df = spark.createDataFrame([("a", "x", 1, 1, "US", 0.9), ("a", "y", 2, 1, "US", 0.6), ("b", "z", 3, 2, "US", 0.5)], SCORED)
    got = {r["tid"]: (r["ctx_rank"], round(r["ctx_gap_max"], 6), round(r["ctx_gap_second"], 6)) for r in features.context_features(df).collect()}
    assert got == {"x": (1, 0.0, 0.3), "y": (2, 0.3, -0.3), "z": (1, 0.0, 0.0)}


def test_files(spark, tmp_path):
    p = tmp_path / "s.tsv"
    p.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t Ünï \t\tUS\nS1-2\t\"a\"\"b\"\tx\t\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_tsv(spark, str(p)).orderBy("entity_id").collect()] == [("S1-1", "Ünï", "", "US"), ("S1-2", 'a"b', "x", "")]
    (tmp_path / "bad.tsv").write_text("a,b\n")
    with pytest.raises(ValueError):
        files.read_tsv(spark, str(tmp_path / "bad.tsv"))
    s1 = spark.createDataFrame([("S1-2", 1), ("S1-1", 2)], "s1_id string, seq long")
    pairs = spark.createDataFrame([("S1-1", "S3-1"), ("S1-1", "S2-9")], "s1_id string, tid string")
    files.write_id_lists(s1, pairs, str(tmp_path / "out"))
    assert {r["s1_id"]: r["ids"] for r in files.read_id_lists(spark, str(tmp_path / "out")).collect()} == {"S1-1": ["S2-9", "S3-1"], "S1-2": []}
    assert sorted(r[0] for r in files.read_ids(spark, str(tmp_path / "out")).collect()) == ["S1-1", "S1-2"]
    twice = spark.createDataFrame([("a, a",)], "v string").select(files.parse_ids("v"))
    with pytest.raises(Exception, match="duplicate id"):
        twice.collect()


def test_validation(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1\nS1-1\t\nbroken\n\nS1-9\tS1-1,Q-1,S3-7\n")
    rows = validation.parse(validation.read_lines(spark, str(tmp_path / "m.tsv")))
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string")
    found = validation.findings(rows, required, spark.createDataFrame([("S2-1",)], "tid string"), spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, tid string"))
    got = {r["rule"]: (r["n"], r["examples"]) for r in found.collect()}
    assert got == {"duplicate_row": (1, "S1-1"), "duplicate_in_list": (1, "S1-1"), "malformed_row": (1, "line 4"), "self_match": (1, "S1-1"), "wrong_prefix": (1, "Q-1"), "unknown_id": (1, "S3-7"), "missing_row": (1, "S1-2"), "unexpected_row": (1, "S1-9"), "match_not_candidate": (1, "S1-9")}
    assert not validation.passed(found)
    assert validation.check_header("a,b", files.TRUTH) and validation.check_header(None, files.TRUTH) and not validation.check_header("Source1_Entity_Id\tmatched_entity_ids", files.TRUTH)


def test_numbering(spark):
    df = spark.range(100, numPartitions=7).where("id % 3 <> 0")
    assert [r["n"] for r in numbering.numbered(df, "n").orderBy("id").collect()] == list(range(1, df.count() + 1))


def test_spread_join_equals_a_join(spark, monkeypatch):
    rows = spark.createDataFrame([*((7, i) for i in range(50)), (1, 3), (2, 4), (None, 5), (9, 6)], "k int, v int")
    ones = spark.createDataFrame([(7, "a"), (1, "b"), (8, "c"), (None, "d")], "k int, w string")
    want = sorted(map(tuple, rows.join(ones, "k").collect()))
    assert sorted(map(tuple, skew.spread_join(rows, ones, "k", "v").collect())) == want
    monkeypatch.setattr(skew, "HOT", 4)
    split = skew.spread_join(rows, ones, "k", "v")
    assert split.columns == ["k", "v", "w"] and sorted(map(tuple, split.collect())) == want
    assert skew.spread_join(rows.limit(0), ones, "k", "v").isEmpty()
    assert [skew.share(n) for n in (0, 10**6, 10**10)] == [4, 10, 100_000]


def test_components_split_a_star(spark, monkeypatch):
    """Stars around the least and around the greatest node, one joined with a chain."""
    star = [(0, i) for i in range(1, 60)] + [(i, 5000) for i in range(1000, 1060)] + [(i, i + 1) for i in range(59, 90)]
    df = spark.createDataFrame(star, "a long, b long")
    want = {(n, 0) for n in range(1, 91)} | {(n, 1000) for n in [*range(1001, 1060), 5000]}
    for hot in (500, 3):
        monkeypatch.setattr(skew, "HOT", hot)
        assert {(r["node"], r["label"]) for r in clusters.components(df).collect()} == want


def test_clusters(spark):
    links = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("x", "y")], "a string, b string")
    got = {r["node"]: r["cluster"] for r in clusters.clusters(links).collect()}
    assert all(got[f"{i:03}"] == "000" for i in range(41)) and got["y"] == "x"


def test_audit_report(spark, sf):
    e = entities(spark, sf)
    out = audit.report(e, e.where("bucket = 1").select(F.col("entity_id").alias("s1_id")), truth_pairs(e))
    assert out["rows"] == 200 and out["truth"]["source1_rows"] == 70 and out["truth"]["singletons"] == 48
    lengths = sorted(len(r["business_name"]) for r in e.collect())
    assert out["lengths"]["business_name"]["p95"] == lengths[int(0.95 * 199)] and out["lengths"]["business_name"]["max"] == lengths[-1]


def test_hub_feature_and_training(spark, sf, tmp_path):
    e = entities(spark, sf)
    pairs = matching.featured(e).persist()
    ensemble, scored = matching.train(pairs, truth_pairs(e), 1_000_000_100, rounds=2, trees=2)
    assert scored.where("prob < 0 or prob > 1 or prob is null").count() == 0
    ensemble.save(str(tmp_path / "m"), spark)
    again = models.Ensemble.load(str(tmp_path / "m"), spark).predict(pairs).select("s1_id", "tid", "prob")
    first = ensemble.predict(pairs).select("s1_id", "tid", "prob")
    assert again.exceptAll(first).count() == 0
    final = matching.matches(e, ensemble)
    assert final.groupBy("tid").count().where("count > 1").count() == 0
    assert matching.pick_threshold(e.where("bucket = 1").select(F.col("entity_id").alias("s1_id")), truth_pairs(e), scored) in evaluation.THRESHOLDS
    pairs.unpersist()


def test_trees_learn_and_score_alike():
    """Held-out accuracy on a rule of two features; a slow walk through the trees scores the same."""
    import numpy as np

    from linkloom.operators import boosting

    rng = np.random.default_rng(1)
    x = rng.random((4, 4000))
    y = ((x[0] > 0.5) ^ (x[2] > 0.3)).astype(float)
    edges = boosting.edges_of(x[:, :3000])
    bins = boosting.binned(x, edges)
    base, boosted = boosting.boost(bins[:, :3000], y[:3000], 60, 4)
    bagged = boosting.forest(bins[:, :3000], y[:3000], 60, 6, 1)
    for p in (base + boosted.total(bins[:, 3000:]) > 0, bagged.total(bins[:, 3000:]) > 0.5):
        assert (p == y[3000:]).mean() > 0.95
    for i in (3000, 3999):
        total = 0.0
        for f, a, v in zip(boosted.feature, boosted.above, boosted.value):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if (np.sum(edges[f[node]] < x[f[node], i]) > a[node]) else 1)
            total += v[node - len(f)]
        assert total == pytest.approx(boosted.total(bins[:, i : i + 1])[0])
    assert boosted.total(bins[:, :0]).shape == (0,)


def test_blend(spark):
    df = spark.createDataFrame([("a", 0.4, 3.0), ("b", 0.4, -3.0)], "tid string, prob double, rerank_score double")
    got = {r["tid"]: r["prob"] for r in models.blend(df).collect()}
    assert got["a"] == pytest.approx(0.2 + 0.5 / (1 + 2.718281828**-3)) and got["a"] > got["b"]


def test_stream_equals_batch(spark, sf):
    a = queries.stream_candidates(spark, sf)
    assert a.exceptAll(queries.block_candidates(spark, sf)).count() == 0 and a.count() == queries.block_candidates(spark, sf).count()


def test_full_queries_drop_no_target(spark):
    big = "/root/testdata/sf0.01"
    e = entities(spark, big)
    assert queries.QUERIES["needed_targets_full"](spark, big).count() == e.where("bucket > 1").count() > queries.needed_targets(spark, big).count()
    big = "/root/testdata/sf0.1"  # the smaller tables have under 100 competitors a source
    full, capped = queries.QUERIES["hard_negatives_full"](spark, big), queries.hard_negatives(spark, big)
    assert capped.exceptAll(full).count() == 0 and full.count() > capped.count()


def test_predictions_come_from_the_classifiers(spark, sf, monkeypatch):
    monkeypatch.setattr(queries, "ROUNDS", 2)
    monkeypatch.setattr(queries, "TREES", 2)
    asked = []
    predict = models.Ensemble.predict
    monkeypatch.setattr(models.Ensemble, "predict", lambda self, pairs: asked.append(pairs.columns) or predict(self, pairs))
    final = queries.predict_matches(spark, sf)
    assert set(features.BASE) <= set(asked[-1])
    assert final.columns == ["s1_id", "tid", "prob"] and final.groupBy("tid").count().where("count > 1").count() == 0


def test_the_registered_ensemble_has_the_references_size():
    assert queries.ROUNDS >= 200 and queries.TREES >= 200


def test_a_record_in_another_script_meets_its_latin_one(spark):
    rows = [("S1-1", "राम मोहन", "", "India", 1, 1), ("S2-1", "ram mohan", "", "India", 2, 2)]
    e = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string, seq long, bucket int")
    assert ids(matching.blocked(e)) == [("S1-1", "S2-1")]


def test_transliteration_leaves_the_tables_as_they_are(spark):
    e = entities(spark, "/root/testdata/sf0.01").select("entity_id", "business_name", "business_address", "country")
    a, b = (normalize(e, x).select("entity_id", "clean_name", "clean_address") for x in (True, False))
    assert a.exceptAll(b).count() == 0


def test_dense_topk_equals_brute_force(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    vectors = rng.integers(-2, 3, (150, 6)).astype(float)  # many equal and opposite ones, and zeros
    parts = rng.integers(0, 3, 150).tolist()
    df = spark.createDataFrame([(i, parts[i], vectors[i].tolist()) for i in range(150)], "id long, part int, embedding array<double>")
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    for block, rows in ((16_384, 256), (20, 7)):
        monkeypatch.setattr(ranking, "BLOCK", block)
        monkeypatch.setattr(ranking, "ROWS", rows)
        got = ranking.dense_topk(df.where("id % 5 = 0"), df, 4, least=0.1).collect()
        want = set()
        for i in range(0, 150, 5):
            sims = sorted((-round(float(unit[i] @ unit[j]), 9), j) for j in range(150) if parts[j] == parts[i])
            want |= {(i, j, r + 1) for r, (s, j) in enumerate(sims[:4]) if -s >= 0.1}
        assert {(r["s1_id"], r["tid"], r["rank"]) for r in got} == want
    assert ranking.dense_topk(df.limit(0), df).count() == 0


def test_embeddings_are_cached_by_text(spark, tmp_path):
    import numpy as np

    log = str(tmp_path / "log")

    def encode(texts):
        with open(log, "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        return np.array([[len(t), t.count("a")] for t in texts])

    df = spark.createDataFrame([(1, 0, "aa"), (2, 0, "aa"), (3, 1, "b"), (4, 1, None)], "id long, part int, text string")
    for rows in (df.where("id < 3"), df, df):
        got = {r["id"]: r["embedding"] for r in ranking.embedded(rows, encode, "m", str(tmp_path / "cache")).collect()}
    assert got == {1: [2, 2], 2: [2, 2], 3: [1, 0], 4: [0, 0]}
    assert sorted(open(log).read().split("\n")) == ["", "", "aa", "b"]
    assert {r["embedding"][0] for r in ranking.embedded(df, encode, "m").collect()} == {0, 1, 2}


def test_encoder_texts(spark):
    from linkloom.functions import text

    df = spark.createDataFrame([(" Acme ", None, "US")], "business_name string, business_address string, country string")
    assert df.select(text.entity_text()).first()[0] == "business: Acme | address:  | country: US"
    assert records(spark, [("S1-1", "Ácme", "1 Rd", "US", 1, 1)]).select(text.pipe_text()).first()[0] == "acme | 1 rd | US"


def test_compatibility_forms_and_unnamed_letters(spark):
    from linkloom.functions import text

    df = spark.createDataFrame([("ﬁne ＡＢ x² ①",), ("鿿\U0003134a",)], "v string")
    assert df.select(text.clean(F.col("v"))).first()[0] == "fine ab x2 1"
    assert df.select(text.script_group("v")).collect()[1][0] == "CJK"


def test_first_rows(spark):
    rows = [(b, s) for b in (2, 3) for s in [1, 5, 5, 5, 9, 1000, 10**9, 10**9 + 1] * (b - 1)]
    df = spark.createDataFrame([(b, s, i) for i, (b, s) in enumerate(rows)], "bucket int, seq long, x int")
    for n in (1, 3, 7, 100):
        got = sorted((r["bucket"], r["seq"]) for r in blocking.first_rows(df, "bucket", "seq", n, 8).collect())
        assert got == sorted((b, s) for b in (2, 3) for s in sorted(s for c, s in rows if c == b)[:n])


def test_validate_command(spark, tmp_path, capsys):
    from linkloom import validate

    for i, ids in ((1, ["S1-1", "S1-2"]), (2, ["S2-1"]), (3, ["S3-1"])):
        (tmp_path / f"{i}.tsv").write_text("entity_id\tbusiness_name\n" + "".join(f"{x}\tn\n" for x in ids))
    sources = [str(tmp_path / f"{i}.tsv") for i in (1, 2, 3)]
    good, bad, cands = (str(tmp_path / n) for n in ("good.tsv", "bad.tsv", "cands.tsv"))
    open(good, "w").write("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\n")
    open(bad, "w").write("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-7\n")
    open(cands, "w").write("source1_entity_id\tcandidate_entity_ids\nS1-1\tS3-1\nS1-2\t\n")
    assert validate.run(spark, good, sources) == 0
    assert validate.run(spark, good, sources, cands) == 0 and "WARNING: match_not_candidate" in capsys.readouterr().out
    assert validate.run(spark, bad, sources) == 1
    assert validate.run(spark, str(tmp_path / "none.tsv"), sources) == 1 and "file not found" in capsys.readouterr().out


def test_emission_and_json(spark, tmp_path):
    import json

    s1 = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1_id string")
    pairs = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "s1_id string, tid string")
    row = evaluation.emission(s1, pairs, pairs.limit(1)).first().asDict()
    assert row == {"entities": 4, "candidates": 3, "matches": 1, "avg_candidates": 0.75, "avg_matches": 0.25}
    assert evaluation.emission(s1.limit(0), pairs.limit(0), pairs.limit(0)).first()["avg_matches"] == 0.0
    files.write_json(spark, {"é": [1]}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"é": [1]}
