"""Operators on single documents against brute force."""

import base64
import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken

from pyspark.sql import functions as F

from linkloom.llm import bpe, chat, decontaminate, language_id, quality_rules, textnum, token_counts, toxicity
from linkloom.llm.common import runs, text_buffer

ODD = ["", " ", "\n\n", "a", "a b", "é œ 日本語 ß", "x\x1cy\x85z\xa0w", "it's we'll 'S ''re  12ab!!  \n\n  end ", "퟿😀" * 40, "a " * 500, "w" * 5000, "###</turn>\\ " * 3]


@pytest.fixture(scope="module")
def ranks():
    with open(bpe.default_vocabulary(), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def tokenizer(ranks):
    return bpe.Tokenizer(ranks, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def some(spark, sf):
    return [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()] + ODD


def test_perfect_hash_is_minimal_and_exact(ranks):
    keys = list(ranks)[:5000]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(len(keys)))
    assert all(h.slot(k + b"\x00no") == -1 for k in keys)


def test_bpe_equals_tiktoken(tokenizer, reference, some):
    for t in some:
        ids = tokenizer.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert tokenizer.decode(ids) == t.encode()


def test_bpe_of_a_long_word_and_of_blocks(spark, tokenizer, reference, some):
    rng = random.Random(2)
    word = "".join(rng.choice("abcdeinrst") for _ in range(200_000))
    assert tokenizer.encode(word) == reference.encode_ordinary(word)
    for t in some:
        assert list(itertools.chain.from_iterable(tokenizer.blocks(t, 7))) == tokenizer.encode(t)
    text = "two words, " * 60_000
    df = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    one, two = bpe.round_trip(df, ids=True).orderBy("doc_id").collect()
    want = reference.encode_ordinary(text)
    assert (one["ids"], one["n_tokens"], two["ids"]) == (want, len(want), [])
    assert one["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert one["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_token_counts_of_no_rows_and_clashing_names(spark, tokenizer):
    text = "it's a word " * 100_000
    df = spark.createDataFrame([("a", text, 7)], "doc_id string, text string, n_tokens int")
    (row,) = token_counts.token_counts(df).collect()
    assert (row["n_tokens"], row["edited_chars"]) == (len(tokenizer.encode(text)), len(text))
    assert token_counts.token_counts(df.limit(0)).count() == 0


def test_bpe_rows(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "<|endoftext|>")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids_sha256 string")
    got = bpe.round_trip(df).collect()
    assert len(got) == 5
    by = {(r["doc_id"], r["n_tokens"]): r for r in got}
    assert by[1, 0]["ids_sha256"] == hashlib.sha256(b"").hexdigest() == by[2, 0]["decoded_sha256"]
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_edits_equal_a_full_count(tokenizer, some):
    rng = random.Random(5)
    for t in some:
        tree, text = token_counts.build(tokenizer, t), t
        assert tree.n_tokens == len(tokenizer.encode(t))
        for _ in range(6):
            a = rng.randint(0, len(text) + 2)
            z = a + rng.choice([0, 0, 1, 5, 300])
            new = rng.choice(["", "s", "'", " ", "  \n", "it's", "99", "x y " * 50, "é"])
            tree, text, again = token_counts.edit(tokenizer, tree, text, a, z, new)
            assert tree.n_tokens == len(tokenizer.encode(text)), (a, z, new)
            assert tree.n_chars == len(text)


def test_edits_reencode_little(tokenizer, some):
    text = max(some[:60], key=len)
    _, _, again = token_counts.edit(tokenizer, token_counts.build(tokenizer, text), text, len(text) // 2, len(text) // 2, "word")
    assert again < len(text) / 3


def test_token_counts_rows(spark, tokenizer):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (2, None), (None, "")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 0, 0, "zz "), (1, 1, 2, 3, None), (1, 3, 99, 3, "!"), (7, 1, 0, 0, "x")], "doc_id long, seq int, start int, stop int, text string")
    got = token_counts.token_counts(token_counts.with_edits(df, edits), edits="edits").collect()
    assert len(got) == 4
    one = next(r for r in got if r["doc_id"] == 1)
    assert (one["n_edits"], one["edited_chars"], one["n_tokens_edited"]) == (3, 8, len(tokenizer.encode("zz a  c!")))


def slow_quality(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    total = sum(map(len, words))
    seen, dup_lines, line_chars = set(), 0, 0
    for line in text.split("\n"):
        own = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", line) if w]
        if own:
            dup_lines += line in seen
            line_chars += (line in seen) * sum(map(len, own))
            seen.add(line)
    grams = {}
    for n in quality_rules.NGRAM_LIMITS:
        seen, covered = set(), set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            if g in seen:
                covered.update(range(i, i + n))
            seen.add(g)
        grams[n] = sum(len(words[i]) for i in covered)
    count = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeat = set()
    for i in range(len(words) - 7):
        if count[tuple(words[i : i + 8])] > 1:
            repeat.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(repeat) > 30 * len(words)
    kept = not (failed or line_chars > 0.3 * total or any(c > quality_rules.NGRAM_LIMITS[n] * total for n, c in grams.items()))
    return len(words), total, sum(text.count(c) for c in "#*$%&|<>"), dup_lines, len(repeat), failed, kept


def test_quality_equals_brute_force(spark, some):
    extra = ["one two three four five six seven eight nine ten " * 3, "a b\nc d\na b\na b ", "\n".join(["the same line of some words here"] * 9), "z " * 40]
    all_texts = some + extra
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(all_texts)] + [(-1, None, 0)], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")) for r in quality_rules.quality(df).collect()}
    assert got[-1] == (0, 0, 0, 0, 0, True, False)
    for i, t in enumerate(all_texts):
        assert got[i] == slow_quality(t), (i, t[:80])
    assert quality_rules.quality(df.limit(0)).count() == 0


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() & 1] for i in range(n))


def measured(texts):
    got = quality_rules.measure(*text_buffer(pa.array(texts, pa.string())))
    return [tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for i in range(len(texts))]


def test_texts_that_polynomial_hashes_confuse(monkeypatch):
    a, b = thue_morse(1024), thue_morse(1024, "ba")
    fill = " one two three four five six seven "
    texts = [f"{a}\n{b}", a + fill + b + fill, f"{a}{fill}\n{b}{fill}", "\n".join([a, b, a])]
    assert measured(texts) == [slow_quality(t)[:5] for t in texts]
    # Even where all short words have one hash.
    monkeypatch.setattr(quality_rules, "span_hashes", lambda data, start, end: (end - start).astype(np.uint64))
    texts = ["p q r s t u v w x y " * 2 + "y x w v u t s r q p", " ".join("abcdefghij"[(i * i) % 10] for i in range(300))]
    assert measured(texts) == [slow_quality(t)[:5] for t in texts]


def test_long_texts_in_blocks(monkeypatch, some):
    """Blocks that cut a text anywhere, and parts in sorting, change nothing."""
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "be", "#", "é" * 30, "x" * 400, "the of\nand"]) for _ in range(900))
    texts = [long, "w" * 700, "w" * 64 + " " + "v" * 200, " " * 300, *some[:10]]
    want = [slow_quality(t)[:5] for t in texts]
    monkeypatch.setattr(quality_rules, "BLOCK", 64)
    monkeypatch.setattr(quality_rules, "PASS", 10)
    assert [measured([t])[0] for t in texts] == want


def test_word_spans_and_lines(some):
    data, offsets = text_buffer(pa.array([*some, None]))
    start, end, doc = textnum.spans(data, offsets, textnum.NOT_SPACE)
    raw = data.tobytes()
    got = [[] for _ in range(len(offsets) - 1)]
    for a, z, d in zip(start, end, doc):
        got[d].append(raw[a:z])
    assert got == [(t or "").encode().split() for t in [*some, None]]
    a, z, d = textnum.lines(data, offsets)
    assert [raw[x:y] for x, y in zip(a, z)] == [x for t in [*some, None] for x in (t or "").encode().split(b"\n")]
    assert [x for a, z in runs(offsets, 3000) for x in range(a, z)] == list(range(len(some) + 1))


def slow_leaks(texts, items, threshold):
    def words(t):
        return __import__("regex").findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", t.lower())

    def bag(w, k):
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    out = {}
    for d, t in enumerate(texts):
        w = words(t)
        for i, item in enumerate(items):
            own = words(item)
            if not own or not w:
                continue
            n, k = len(own), min(5, len(own))
            spans = [w] if len(w) < n else [w[a : a + n] for a in range(len(w) - n + 1)]
            if len(w) < n and min(5, len(w)) != k:
                continue
            best = 0.0
            for s in spans:
                a, b = bag(s, k), bag(own, k)
                common = (a & b).total()
                best = max(best, common / (a.total() + b.total() - common))
            if best >= threshold:
                out[d, i] = best
    return out


def test_leaks_equal_brute_force(spark, sf):
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()][:25] + ["", "one two", "Alpha beta gamma delta epsilon", items_long(200)]
    docs = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rng = random.Random(1)
    for i in range(len(items)):
        w = items[i].split()
        for edits in (0, 1, 2):
            v = list(w)
            for _ in range(edits if len(v) > 6 else 0):
                v[rng.randrange(len(v))] = "changed"
            docs.append(rng.choice(docs[:40])[:400] + " " + " ".join(v).upper() + ", " + rng.choice(docs[:40])[:300])
    docs += [items[3], " ".join(items[4].split()[:-1]), "", items[5] * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)] + [(None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(0, items[0]), (99, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(df, bench).collect()}
    want = slow_leaks(docs, items, 0.8)
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    left = {r["doc_id"] for r in decontaminate.clean(df.selectExpr("doc_id as item_id", "text", "doc_id"), bench).collect()}
    assert left == (set(range(len(docs))) | {None}) - {d for d, _ in want}
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0


def items_long(n):
    return " ".join(f"w{i * i % 97}" for i in range(n))


def test_multi_index_finds_all_in_radius():
    items = [(i, items_long(30 + i % 2).replace("w", f"w{i}")) for i in range(60)]
    index = decontaminate.Index(items)
    rng = np.random.default_rng(2)
    for _ in range(100):
        item = int(rng.integers(60))
        fp = int(index.prints[item])
        for bit in rng.choice(64, decontaminate.RADIUS, replace=False):
            fp ^= 1 << int(bit)
        assert item in index.lookup(np.array([fp], np.uint64), 30 + item % 2)[1]


def test_lookups_of_alike_items_hold_little():
    """Templated items, whose fingerprints are near each other, against as many windows."""
    import tracemalloc

    base = "fill in the blank of this sentence with one of the words that were given above and say why".split()
    items = [(i, " ".join([*base, f"n{i}", *base[::-1]])) for i in range(4000)]
    index = decontaminate.Index(items)
    n = len(items[0][1].split())
    asked = index.prints[:512]
    tracemalloc.start()
    window, item = index.lookup(asked, n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.bitwise_count(asked[:, None] ^ index.prints[None]) <= decontaminate.RADIUS
    assert set(zip(window.tolist(), item.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(want))))
    assert peak < 64 * 2**20 + 40 * len(window)


def test_leaks_of_string_ids_and_a_very_long_text(spark):
    item = items_long(60)
    long = " ".join(f"q{i}" for i in range(300_000)) + " " + item
    docs = spark.createDataFrame([("a", long, 1.0), ("b", "no leak here at all", 2.0)], "item_id string, text string, similarity double")
    bench = spark.createDataFrame([("x-1", item), ("x-2", "z " * 30)], "item_id string, text string")
    got = decontaminate.contaminated(docs, bench, id="item_id").collect()
    assert [(r["doc_id"], r["item_id"], r["similarity"]) for r in got] == [("a", "x-1", 1.0)]
    assert [tuple(r) for r in decontaminate.clean(docs, bench).collect()] == [("b", "no leak here at all", 2.0)]


def test_chat_round_trip(spark, sf):
    said = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, "system", "be"), (1, None, "assistant", None), (1, 2, None, "a \\"), (1, 2, None, "a \\"), (2, 0, "as:sis\ntant ### ", " </turn>\n"), (2, 1, "assistant", "x </turn>\n### user: y"), (None, 1, "assistant", "q")]
    rows += [(3, i, ["system", "user", "assistant"][0 if not i else 1 + i % 2], f"turn {i} " + "word " * (i * 37 % 400)) for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    windows = chat.format_conversations(df, budget=500, history=120)
    got = {r["conv_id"]: r for r in chat.read_windows(windows).collect()}
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda z: (z[0] is not None, z[0] or 0, z[1] is not None, z[1] or 0, z[2] or "", z[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        learned = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    mine = [r for r in windows.where("conv_id = 3").orderBy("window").collect()]
    assert len(mine) > 5 and all(r["text"].startswith("### system: turn 0") for r in mine)
    assert any(r["n_repeated"] > 1 for r in mine)
    assert got[3]["formatted_chars"] == sum(len(r["text"]) for r in mine)
    assert chat.read_windows(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_budget(spark, tokenizer):
    rows = [(3, i, "user" if i % 2 else "assistant", "word " * (i * 37 % 300)) for i in range(60)]
    rows += [(4, i, "user", "ok") for i in range(3000)] + [(5, i, "assistant", None) for i in range(300)]
    rows += [(6, i, "system" if not i else "user", "\\ ### </turn> " * (5 + i % 60)) for i in range(80)]
    rows += [(7, 0, "system", "s " * 350), (7, 1, "user", "u " * 30), (7, 2, "user", "v " * 100), (7, 3, "assistant", "w " * 900), (8, 0, "system", "t " * 500), (8, 1, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(df, budget=400, history=100)
    for r in windows.collect():
        assert sum(1 for _ in chat._turn.finditer(r["text"])) == 1 or len(tokenizer.encode(r["text"])) <= 400
    by = {c: [r for r in windows.where(f"conv_id = {c}").orderBy("window").collect()] for c in (4, 7)}
    assert all(len(tokenizer.encode(r["text"])) > 300 for r in by[4][:-1])  # and they are well filled
    # The system turn stands before what fits beside it only.
    assert [r["n_repeated"] for r in by[7]] == [0, 0, 0]
    got = {r["conv_id"]: r["n_turns"] for r in chat.read_windows(windows).collect()}
    assert got == {3: 60, 4: 3000, 5: 300, 6: 80, 7: 4, 8: 2}


def test_chat_very_long_turn(spark):
    text = "longer and longer </turn> \\ " * 200_000
    df = spark.createDataFrame([(1, 0, "system", "be"), (1, 1, "assistant", text), (1, 2, "assistant", text)], "conv_id long, turn long, role string, text string")
    r = chat.read_windows(chat.format_conversations(df)).first()
    assert (r["n_turns"], r["loss_chars"]) == (3, 2 * len(text))
    assert r["loss_sha256"] == hashlib.sha256((text * 2).encode()).hexdigest()


def test_language_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.train(df)
    got = {r["doc_id"]: r for r in language_id.predict(df, net).collect()}
    truth = {r["doc_id"]: r["lang"] for r in df.select("doc_id", "lang").collect()}
    held = [d for d in truth if language_id.remainder(d) == 2]
    assert np.mean([got[d]["lang_pred"] == truth[d] for d in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_edges(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "12 34", "en"), (3, "the word is here", "en"), (5, "das wort ist hier", "de"), (None, "x", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.predict(df, language_id.train(df)).collect()}
    assert (got[1]["lang_pred"], got[2]["lang_pred"], got[2]["score"]) == ("und", "und", 0.0)
    assert got[3]["lang_pred"] in ("en", "de")
    assert language_id.train(df.limit(0)) is None
    assert {r["lang_pred"] for r in language_id.predict(df, None).collect()} == {"und"}


def slow_scores(net, data):
    """The network byte by byte: the mean over a text's windows, by their bytes."""
    p, total = net.p, np.zeros(len(net.languages))
    for at in range(0, len(data), language_id.WINDOW):
        window = data[at : at + language_id.WINDOW]
        padded = window.ljust(language_id.WINDOW + max(language_id.WIDTHS), b"\0")
        h = []
        for f in range(p["c"].shape[1]):
            width = language_id.WIDTHS[f // language_id.FILTERS]
            filt = p["c"][: width * language_id.EMBEDDING, f].reshape(width, -1)
            z = max(float(sum(p["e"][padded[i + j]] @ filt[j] for j in range(width))) for i in range(language_id.WINDOW))
            h.append(max(z + float(p["d"][f]), 0.0))
        z = np.array(h) @ p["w"] + p["b"]
        e = np.exp(z - z.max())
        total += len(window) * e / e.sum()
    return total / max(len(data), 1)


def test_language_scores_equal_a_slow_network(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.train(df)
    some = ["x", "straße", "é" * 300, *(r["text"][:700] for r in df.where("text is not null").orderBy("doc_id").limit(3).collect())]
    rows = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.predict(rows, net).collect()}
    for i, text in enumerate(some):
        want = slow_scores(net, text.encode())
        assert got[i]["lang_pred"] == net.languages[want.argmax()] and abs(got[i]["score"] - want.max()) < 1e-4
    data, offsets = text_buffer(pa.array([*some, "", "ab " * 5000, some[-1]]))
    whole = language_id.document_means(net, data, offsets)
    assert np.allclose(whole, language_id.document_means(net, data, offsets, piece=512))
    assert not whole[len(some)].any() and np.allclose(whole[-1], whole[-3 - 1])


def test_language_rows_of_any_kind(spark):
    """Clashing names, repeated rows, string ids, an empty table, a very long text."""
    net = language_id.Network(["de", "en"])
    rows = [("a", "das ist", 1, "p"), ("a", "das ist", 1, "p"), (None, "x", 2, "q"), ("b", "the word " * 1_000_000, 3, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, score int, lang_pred string")
    got = language_id.predict(df, net)
    assert got.columns == ["doc_id", "lang_pred", "score"]
    found = got.collect()
    assert len(found) == 4 and len({tuple(r) for r in found}) == 3
    assert language_id.predict(df.limit(0), net).count() == 0


def test_language_sample_of_a_repeated_id_is_bounded(spark, monkeypatch):
    held = []
    monkeypatch.setattr(language_id.Network, "fit", lambda self, windows, y: held.append(len(y)))
    df = spark.range(3000).selectExpr("4L as doc_id", "concat('text ', id) as text", "'en' as lang").union(spark.range(3000).selectExpr("4L", "'same'", "'de'"))
    assert language_id.remainder(4) != 2
    language_id.train(df, sample=50)
    # Classes are evened to the larger, of some 50 rows.
    assert held and held[0] < 400


def test_network_gradient():
    net = language_id.Network(["a", "b", "c"])
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, 256, (5, 20)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    g = net.gradients(x, y)

    def loss():
        return float(-np.log(net.predict(x)[np.arange(5), y]).mean())

    for k, at in (("w", (3, 1)), ("c", (2, 5)), ("d", (7,)), ("b", (1,)), ("e", (int(x[0, 0]), 2))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-2
        up = loss()
        net.p[k][at] = old - 1e-2
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / 2e-2 - g[k][at]) < 2e-2


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    held = toxicity.predict(docs, chain).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    caught = [r["p_toxic"] >= toxicity.REJECT for r in held if r["toxic"]]
    wrong = [r["p_toxic"] >= toxicity.REJECT for r in held if not r["toxic"]]
    # Some rows are labelled toxic for no word they hold.
    assert np.mean(caught) > 0.85 and np.mean(wrong) < 0.01


def test_the_chain_equals_a_slow_forward_pass(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    chain = toxicity.train(docs, labels)
    assert chain.categories == ["quality", "toxic"]
    assert [len(m.weights) for m in chain.models] == [len(chain.features), len(chain.features) + 1]
    where = {int(f): i for i, f in enumerate(chain.features)}
    got = {r["doc_id"]: r for r in toxicity.predict(docs, chain).collect()}
    for r in docs.collect():
        words = set(__import__("regex").findall(r"\p{L}+", (r["text"] or "").lower()))
        own = {where[f] for w in words for f in toxicity.word_features(w) if f in where}
        earlier = []
        for m, c in zip(chain.models, chain.categories):
            z = m.bias + sum(m.weights[i] for i in own) + sum(m.weights[len(where) + j] * p for j, p in enumerate(earlier))
            earlier.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            assert abs(got[r["doc_id"]][f"p_{c}"] - earlier[-1]) < 1e-9


def test_fold_probabilities_ignore_their_rows():
    """A feature that only one fold's rows have, and their labels, don't reach that fold's earlier
    probability: with it removed the later model is the same."""
    rng = np.random.default_rng(3)
    n = 400
    y = rng.integers(0, 2, (n, 2)).astype(float)
    folds = np.arange(n) % 4
    seen = []
    sets = [[int(f) for f in rng.choice(60, 8, replace=False)] + ([100] if y[i, 1] else []) for i in range(n)]
    real = toxicity.select
    toxicity.select = lambda rows, raw, y: seen.append(len(y)) or real(rows, raw, y)
    try:
        toxicity.fit(sets, y, folds, ["a", "b"])
    finally:
        toxicity.select = real
    assert seen == ([300] * 4 + [400]) * 2
    own = [s + ([200] if folds[i] == 1 and y[i, 1] else []) for i, s in enumerate(sets)]
    rows, raw = toxicity._flat([s for i, s in enumerate(own) if folds[i] != 1])
    assert 200 not in toxicity.select(rows, raw, y[folds != 1, 1]) and 200 in toxicity.select(*toxicity._flat(own), y[:, 1])


def test_repeated_ids_are_one_row(spark):
    """3,000 rows of one id send one to the driver, always the same."""
    rows = [(1, f"text number {i} is fine") for i in range(3000)] + [(2, "you scum")] * 5 + [(3, "tie"), (4, "tie")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 1, 0), (3, 1, 0), (4, 0, 0)], "doc_id long, toxic int, quality int")
    a, b = (toxicity.train(d, labels) for d in (docs, docs.orderBy(F.desc("text"))))
    assert all(x.bias == y.bias and (x.weights == y.weights).all() for x, y in zip(a.models, b.models))
    assert toxicity.clean(docs.limit(0), a).count() == 0 and toxicity.predict(docs.limit(0), a).count() == 0


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, "you idiot there" if i % 3 == 0 else "a fine day", i) for i in range(60)] + [(None, None, 0), (3, "", 1)], "doc_id long, text string, p_insult int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    chain = toxicity.train(docs, labels)
    left = toxicity.clean(docs, chain)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in left.collect() if r["text"]) == [i for i in range(60) if i % 3]
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.predict(docs, none).count() == 62
