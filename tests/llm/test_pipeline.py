"""The corpus pipeline: what each stage keeps, against plain versions."""

import hashlib

import pytest
import tiktoken
from test_corpus_operators import slow_dedup, words
from test_near_copies import brute
from test_text_operators import slow_leaks

import corpus_pipeline
from linkloom.llm import bpe, toxicity

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus(spark, sf):
    """Documents with nulls, repeats, an id on two texts, copies and a leak planted."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs]
    own = "\n".join(words(f"own{i}z", 12) for i in range(6))
    rows += [(900, own, "en", "src1", 1), (901, f"{words('other', 30)}\n{own}", "en", "src1", 1), (902, None, "en", "src1", 0), (903, "", None, None, 0), (None, words("none", 40), "en", "src1", 1)]
    rows += [(904, f"{words('front', 20)} {leak} {words('back', 20)}", "en", "src1", 1), (900, words("second", 80), "en", "src1", 1), (905, words("second", 80), "en", "src1", 1), rows[3], rows[3]]
    return rows


def test_toxicity_keeps_what_the_chain_lets_pass(spark, sf, corpus):
    df = spark.createDataFrame(corpus, COLUMNS)
    p = toxicity.predict(df, toxicity.train(df, spark.read.parquet(f"{sf}/labels.parquet")), carry=["doc_id", "text", "source"])
    want = sorted(((r["doc_id"], r["text"], r["source"]) for r in p.collect() if r["p_toxic"] < 0.5), key=str)
    assert rows_of(STAGES["toxicity"](spark, df, sf)) == want


def test_line_dedup_equals_the_slow_reference(spark, sf, corpus):
    own = [r for r in corpus if r[0] is not None]  # the slow one has no nulls
    clean = slow_dedup([(d, t or "") for d, t, *_ in own])
    want = sorted(((d, None if t is None else clean[d, t], s) for d, t, _, s, _ in own if t is None or clean[d, t] == t or clean[d, t].split()), key=str)
    assert rows_of(STAGES["line dedup"](spark, spark.createDataFrame(own, COLUMNS), sf)) == want


def test_near_duplicates_keep_one_of_each_group(spark, sf, corpus):
    texts = list(dict.fromkeys((d, t) for d, t, *_ in corpus))
    group = brute(list(enumerate(t for _, t in texts)))
    got = [(d, t) for d, t, _ in rows_of(STAGES["near duplicates"](spark, spark.createDataFrame(corpus, COLUMNS), sf))]
    assert sorted(group[texts.index(x)] for x in got) == sorted(set(group.values()))
    for g in set(group.values()):  # and of the least id
        ids = [texts[i][0] for i in group if group[i] == g]
        least = min((d for d in ids if d is not None), default=None)
        assert [d for d, t in got if group[texts.index((d, t))] == g] == [least]


def test_decontamination_equals_the_slow_reference(spark, sf, corpus):
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {i for i, _ in slow_leaks([t or "" for _, t, *_ in corpus], items, 0.8)}
    assert leaks
    want = sorted(((d, t, s) for i, (d, t, _, s, _) in enumerate(corpus) if i not in leaks), key=str)
    assert rows_of(STAGES["decontamination"](spark, spark.createDataFrame(corpus, COLUMNS), sf)) == want


def test_encoding_equals_the_library(spark, sf, corpus):
    import base64

    import public_tokenizers

    with open(bpe.default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = STAGES["byte-level BPE"](spark, spark.createDataFrame(corpus, COLUMNS), sf).collect()
    got = sorted(((r["doc_id"], list(r["ids"]), r["decoded_sha256"]) for r in out), key=str)
    assert got == sorted(((d, library.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in corpus), key=str)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_their_own_output(spark, sf, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.STAGES[stage][1](spark, docs, sf)
    if stage < 4:
        assert out.columns == docs.columns
    assert 0 < out.count() <= docs.count()
    assert corpus_pipeline.STAGES[stage][1](spark, docs.limit(0), sf).count() == 0


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near duplicates", "decontamination", "byte-level BPE"]
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    assert out.count() == out.select("doc_id").distinct().count() > 50
