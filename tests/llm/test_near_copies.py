"""The pipeline's near-duplicate stage against brute force."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from linkloom.llm import near_copies, simhash_golay
from linkloom.operators import skew


def grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) > n else {tuple(w)}


def brute(rows):
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {d: grams(t) for d, t in rows}
    for a, b in itertools.combinations(parent, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in parent}


def corpus():
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([4, 60, 200, 400]))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(6):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(w)))
    return [*rows, (900, None), (901, ""), (902, "  "), (903, rows[0][1].upper())]


def test_the_stage_equals_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    # What three bits leave: the stage before this setting.
    assert simhash_golay.keep_one(df).count() > len(set(want.values()))


def test_blocks_find_what_one_family_does(spark, monkeypatch):
    rows = corpus()
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block, family in ((300, 400), (near_copies.BLOCK, 400), (near_copies.BLOCK, 2), (300, 3)):
        monkeypatch.setattr(near_copies, "FAMILY", family)
        got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(df, block=block).collect()}
        assert got == want


def test_hot_keys_are_split_and_nothing_changes(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT", 1)
    rows = corpus()
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(df).collect()} == want
    plain = [tuple(r) for r in simhash_golay.near_duplicates(df).orderBy("doc_id").collect()]
    monkeypatch.undo()
    assert plain == [tuple(r) for r in simhash_golay.near_duplicates(df).orderBy("doc_id").collect()]


def test_nulls_and_repeats(spark):
    nulls = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "q r s t"), (1, "z"), (1, "z")], "doc_id long, text string")
    assert sorted(r["text"] for r in near_copies.keep_one(nulls).collect()) == ["a b c", "q r s t", "z"]
    assert near_copies.keep_one(nulls.limit(0)).count() == 0


def test_an_id_on_several_texts_loses_none(spark):
    """Rows (5, A), (5, B), (9, B): A is unique and stays, B stays once; other columns are carried."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(5, a, 1, "p"), (5, b, 2, "p"), (9, b, 3, "p"), (5, b, 2, "p")], "doc_id long, text string, _nd_text int, label string")
    for keep in (near_copies.keep_one, simhash_golay.keep_one):
        got = keep(df)
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect())) == [(5, a, 1, "p"), (5, b, 2, "p")]


def test_blocks_are_joined_by_a_forest():
    import pyarrow as pa

    x = np.arange(200, dtype=np.int64)  # all within eight bits, most within three
    batch = pa.RecordBatch.from_arrays([pa.array([x[:100].tobytes()]), pa.array([x[100:].tobytes()])], ["fps", "other"])
    out = pa.Table.from_batches(simhash_golay._block_pairs(iter([batch])))
    assert out.num_rows == 199


def test_sets_are_packed_and_unpacked():
    sets = [np.array([1, 2], np.uint64), np.array([7], np.uint64)]
    nodes, got = near_copies._unpacked(near_copies._packed([-5, 9], sets))
    assert nodes == [-5, 9] and [s.tolist() for s in got] == [[1, 2], [7]]


def test_golay_keys_propose_candidates(spark, monkeypatch):
    """Without a band key in common, texts within three bits are found by fingerprints; similarity decides."""
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    close = {r["doc_id"]: r["component_id"] for r in simhash_golay.near_duplicates(df).collect()}
    want = brute(rows)
    monkeypatch.setattr(near_copies, "_proposed", lambda prints, reps: reps.select(F.col("text_hash").alias("a"), F.col("text_hash").alias("b")))
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(df).collect()}
    by = {}
    for d, c in close.items():
        by.setdefault(c, []).append(rows[[i for i, _ in rows].index(d)])
    assert got == {d: c for group in by.values() for d, c in brute(group).items()}
    assert len(set(want.values())) < len(set(got.values())) < len({(t or "").upper() for _, t in rows})
