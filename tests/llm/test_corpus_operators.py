"""Operators over whole tables against brute force."""

import gzip
import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linkloom.llm import line_dedup, simhash_golay, warc


def slow_fingerprint(text, n=3):
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [words[i : i + n] for i in range(len(words) - n + 1)] or [words]
    h = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    """prints: {doc_id: fingerprint}."""
    parent = {d: d for d in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in prints}


def test_fingerprint():
    for t in ["", " \n", "A b", "a B c", "É b c d e É b c", "x " * 50, "one two three four five six"]:
        assert simhash_golay.fingerprint(t) == slow_fingerprint(t)
        assert simhash_golay.fingerprint(t, 5) == slow_fingerprint(t, 5)


def test_golay_keys_meet_within_three_bits():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    for bits in (0, 1, 2, 3):
        b = a.copy()
        for i in range(len(b)):
            for p in rng.choice(64, bits, replace=False):
                b[i] ^= np.uint64(1 << int(p))
        (ka, oa), (kb, ob) = simhash_golay.keys(a), simhash_golay.keys(b)
        met = {int(x) for x in set(zip(ka.tolist(), oa.tolist())) & set(zip(kb.tolist(), ob.tolist())) for x in [x[1]]}
        assert met == set(range(len(a)))


def test_golay_code_is_perfect():
    _, errors, used = simhash_golay._tables()
    assert sorted(used.sum(axis=1).tolist()) == [1] * (1 + 23 + 253) + [6] * 1771
    index, ok = simhash_golay.codewords(np.arange(1 << 12, dtype=np.int64) << 11)
    assert index.max() < 4096


def test_every_triple_of_places_is_covered():
    """All ways three errors can fall, for a few fingerprints."""
    rng = np.random.default_rng(1)
    triples = np.array(list(itertools.combinations(range(64), 3)), np.uint64)
    masks = (np.uint64(1) << triples).sum(axis=1, dtype=np.uint64)
    for a in rng.integers(0, 1 << 63, 3, dtype=np.uint64):
        own = set(simhash_golay.keys(np.array([a]))[0].tolist())
        k, of = simhash_golay.keys(a ^ masks)
        met = np.zeros(len(masks), bool)
        met[of[np.isin(k, list(own))]] = True
        assert met.all()


def test_near_duplicates_equal_brute_force(spark, sf):
    rng = random.Random(3)
    base = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows = [(i, t) for i, t in enumerate(base)]
    for t in base[:20]:
        for _ in range(4):
            w = t.split(" ")
            for _ in range(rng.choice([0, 1, 2, 5])):
                w[rng.randrange(len(w))] = "other"
            rows.append((100 + len(rows), " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, "  "), (None, base[0]), (7, base[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x")).withColumn("fp", F.lit(1))
    prints = {d: slow_fingerprint(t or "") for d, t in rows if d is not None}
    want = slow_components(prints)
    got = simhash_golay.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["fp"] % (1 << 64) == prints[r["doc_id"]]
            assert r["component_id"] == want[r["doc_id"]]
        else:
            assert r["component_id"] == want[0]
    kept = simhash_golay.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c in want.values()})
    assert simhash_golay.near_duplicates(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "q r s t")], "doc_id long, text string")  # a component each
    assert simhash_golay.keep_one(nulls).count() == 2


def test_blocks_find_what_one_group_does(spark):
    rng = np.random.default_rng(4)
    center = rng.integers(0, 1 << 62, 4)
    prints = {int(c) ^ sum(1 << int(p) for p in rng.choice(64, int(rng.integers(0, 4)), replace=False)) for c in center for _ in range(120)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    labels = []
    for block in (8, 16384):
        got = simhash_golay.components(simhash_golay.links(df, block)).collect()
        labels.append({r["node"]: r["label"] for r in got})
    assert labels[0] == labels[1]
    brute = slow_components({s: s % (1 << 64) for s in signed})
    for s in signed:
        assert labels[0].get(s, s) == brute[s]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["label"] for r in simhash_golay.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[1001] == 1000


def test_warc_round_trip(spark, tmp_path):
    big, evil = "x" * 1200, "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 60
    rows = [(1, "http://a\r\nX: y", big), (5, None, big), (3, "u", big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", evil), (9, "u", evil), (10, "u", "é" * 500), (12, "u", "é" * 500), (None, "u", big), (5, None, big), (11, "u", "é" * 499)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, refers_to string")
    got = sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.round_trip(df, folder=str(tmp_path / "w")).collect()), key=str)
    last = {big: 5, evil: 9, "é" * 500: 12}
    want = []
    for p, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 1000 and p != last[html]
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[html] if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_holds_payloads_once(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "y" * 2000) for i in range(20)], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").rglob("*.gz"))
    assert data.count(b"y" * 2000) == 1
    kinds = [f[b"WARC-Type"] for f, _ in warc.parse(data)]
    assert sorted(kinds) == [b"response"] + [b"revisit"] * 19


def test_warc_files_names_and_digests(spark, tmp_path, monkeypatch):
    """Files hold few bytes, repeated pages have records of their own, a changed payload is found."""
    monkeypatch.setattr(warc, "CLASSES", (2000, 8000))
    monkeypatch.setattr(warc, "FILE_BYTES", 16_000)
    rows = [(i, "u", chr(97 + i % 20) * size) for i, size in enumerate([10] * 30 + [1500] * 30 + [5000] * 9 + [50_000] * 3)] + [(40, "u", "k" * 1500)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    out = warc.round_trip(df, folder=str(tmp_path / "w"))
    assert sorted(r["page_id"] for r in out.collect()) == sorted(r[0] for r in rows)
    files = [gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").rglob("*.gz")]
    assert max(len(list(warc.parse(f))) for f in files) <= 8
    assert all(sum(len(b) for _, b in warc.parse(f)) < 20_000 or len(list(warc.parse(f))) == 1 for f in files)
    heads = [f for data in files for f, _ in warc.parse(data)]
    names = [f[b"WARC-Record-ID"] for f in heads]
    assert len(set(names)) == len(rows)
    assert {f[b"WARC-Refers-To"] for f in heads if b"WARC-Refers-To" in f} <= set(names)
    some = next(p for p in (tmp_path / "w").rglob("*.gz") if b"a" * 50_000 in gzip.decompress(p.read_bytes()) or b"j" * 50_000 in gzip.decompress(p.read_bytes()))
    broken = tmp_path / "broken"
    broken.mkdir()
    raw = gzip.decompress(some.read_bytes())
    (broken / "x.txt.gz").write_bytes(gzip.compress(raw[:-10] + b"#" + raw[-9:]))
    with pytest.raises(Exception, match="another digest"):
        warc.read_archives(spark, str(broken)).collect()


def words(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


def slow_bits(lines, window=2):
    """The boundary bits from the sum over each window, without rolling."""
    h = [xxhash.xxh64_intdigest(x.strip()) for x in lines]
    base, odd = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
    return [sum(h[j] * base ** (i - j) for j in range(max(0, i - window + 1), i + 1)) * odd % 2**64 >> 63 for i in range(len(h))]


def slow_chunks(lines):
    end = slow_bits(lines)
    long = [len(x.split()) >= 17 for x in lines]
    out = set()
    for kind in (0, 1):
        cuts = [0, *(i + 1 for i in range(len(lines) - 1) if end[i] == kind or long[i] or long[i + 1]), len(lines)]
        out |= {(kind, a, z - a) for a, z in zip(cuts, cuts[1:])}
    return out


def test_the_rolling_hash_equals_the_sum_over_its_window():
    rng = random.Random(3)
    for n in (1, 2, 3, 50):
        lines = [f"{rng.randrange(4)} x".encode() for _ in range(n)]
        assert line_dedup.bits(lines) == slow_bits(lines)
        assert line_dedup.bits(lines, 3) == slow_bits(lines, 3)
        assert set(line_dedup.chunks(lines)) == slow_chunks(lines)


def test_places_of_a_passage_share_a_whole_chunk():
    """Passages of 50 words or more in any number of lines, whatever stands around them."""
    rng = random.Random(2)
    for _ in range(600):
        n = rng.choice([1, 2, 3, 4, 5, 8, 12])
        size = [1 + rng.randrange(2 * 50 // n) for _ in range(n)]
        size[rng.randrange(n)] += max(0, 50 - sum(size))
        shared = [" ".join(f"s{rng.random()}" for _ in range(k)).encode() for k in size]
        around = lambda: [" ".join(f"o{rng.random()}" for _ in range(rng.choice([1, 3, 30]))).encode() for _ in range(rng.randint(0, 4))]
        sets = []
        for _ in range(2):
            before = around()
            x = before + shared + around()
            inside = range(len(before), len(before) + n)
            sets.append({b"\n".join(x[s : s + k]) for _, s, k in line_dedup.chunks(x) if s in inside and s + k - 1 in inside})
        assert sets[0] & sets[1], size


def slow_dedup(rows):
    """The cleaned text of each (doc, text): every place of a repeated chunk against every earlier one."""
    places = {}
    for doc, text in set(rows):
        lines = text.split("\n")
        parts = slow_chunks([x.encode() for x in lines])
        for _, a, n in parts:
            if any(x.split() for x in lines[a : a + n]):
                low = min(max(0, p - 1) for k, p, m in parts if p + m == a and (k, a, n) in parts) if a else a
                high = max(p + m for k, p, m in parts if p == a + n and (k, a, n) in parts) if a + n < len(lines) else a + n
                places.setdefault("\n".join(lines[a : a + n]), {})[doc, text, a] = (lines[low:a][::-1], lines[a + n : high], n)
    later = {}
    for group in places.values():
        order = sorted(group)
        for i, (doc, text, a) in enumerate(order[1:], 1):
            later.setdefault((doc, text), set()).update(range(a, a + group[doc, text, a][2]))
    out = {}
    for doc, text in rows:
        lines, gone = text.split("\n"), set()
        covered = later.get((doc, text), set())
        for group in places.values():
            order = sorted(group)
            for i, (d, t, a) in enumerate(order):
                if (d, t) != (doc, text) or not i:
                    continue

                def shown(p, j):
                    """What place p shows beside the chunk; j: its rank, the first shows all."""
                    low, high, n = group[p]
                    own = later.get(p[:2], set())
                    return (low if not j or p[2] - 1 not in own else []), (high if not j or p[2] + n not in own else [])

                def same(x, y):
                    return next((k for k, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))

                low, high = shown((d, t, a), i)
                x = max(same(low, shown(p, j)[0]) for j, p in enumerate(order[:i]))
                y = max(same(high, shown(p, j)[1]) for j, p in enumerate(order[:i]))
                gone.update(range(a - x, a + group[d, t, a][2] + y))
        keep = []
        for inside, run in itertools.groupby(range(len(lines)), key=lambda k: k in gone):
            run = list(run)
            if not inside or sum(len(lines[k].encode().split()) for k in run) < 50:
                keep += run
        out[doc, text] = "\n".join(lines[k] for k in keep)
    return out


def test_line_dedup_equals_the_slow_reference(spark):
    rng = random.Random(11)
    pool = [words(f"p{i}", rng.choice([1, 2, 6, 12, 20, 30])) for i in range(14)] + ["", " "]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randint(0, 6)):
            a = rng.randrange(len(pool))
            text += pool[a : a + rng.randint(1, 5)] if rng.random() < 0.6 else [words(f"d{d}x{len(text)}", rng.randint(1, 30))]
        rows.append((d, "\n".join(text)))
    rows += [(70, rows[5][1]), (5, rows[5][1]), (5, rows[6][1])]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = sorted(r["text"] for r in out.collect())
    assert got == sorted(slow_dedup(rows)[r] for r in rows)


def passages():
    rng = random.Random(7)
    out = {}
    one, three, many, short = words("one", 60), "\n".join(words(f"three{i}", 20) for i in range(3)), "\n".join(words(f"many{i}", 6) for i in range(12)), words("short", 8)
    for d in range(40):
        own = [words(f"d{d}l{i}x", rng.randint(1, 40)) for i in range(rng.randint(2, 8))]
        for p in (one, three, many):
            if rng.random() < 0.5:
                own.insert(rng.randint(0, len(own)), p)
        if rng.random() < 0.5:  # beside a passage it would be a part of the repeated run
            own += [words(f"d{d}end", 9), short]
        out[d] = "\n".join(own)
    return out, (one, three, many, short)


def test_passages_go_and_clean_lines_stay(spark):
    docs, (one, three, many, short) = passages()
    docs[100], docs[101] = docs[3], None
    rows = [(d, t, d) for d, t in docs.items()] + [(None, docs[5], 1), (102, "", 2), (103, "\n\n", 3), (103, "\n\n", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "start", "_ld_lines", "_ld_gone"]
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(got) == len(rows)
    by = dict(got)
    for p in (one, three, many):
        assert sum(p in (t or "") for _, t in got) == 1
        first = min(d for d, t in docs.items() if t and p in t)
        assert p in by[first]
    assert sum(short in t for d, t in got if t and d is not None and d < 100) == sum(short in t for d, t in docs.items() if t and d < 100)
    for d in range(40):
        left = docs[d]
        for p in (one, three, many):
            if d != min(x for x, t in docs.items() if t and p in t):
                left = "\n".join(x for x in left.split("\n") if x not in p.split("\n"))
        assert by[d] == left, d
    assert by[101] is None and by[102] == "" and by[103] == "\n\n"
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def places_of_runs(rows):
    """Documents that hold each shortest run of whole lines with MIN_WORDS words or more."""
    found = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        size = [len(x.encode().split()) for x in lines]
        for i in range(len(lines)):
            n = 0
            for j in range(i, len(lines) if size[i] else i):
                n += size[j]
                if n >= line_dedup.MIN_WORDS:
                    found.setdefault("\n".join(lines[i : j + 1]), []).append(doc)
                    break
    return found


def test_no_repeated_run_is_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    old = [tuple(r) for r in docs.collect()]
    new = [tuple(r) for r in line_dedup.dedup_lines(docs).select("doc_id", "text").collect()]
    before, after = places_of_runs(old), places_of_runs(new)
    repeated = {r for r, at in before.items() if len(at) > 1}
    assert repeated and not [r for r, at in after.items() if len(at) > 1 and r in repeated]
    touched = {d for r in repeated for d in before[r]}
    texts = dict(old)
    assert all(t == texts[d] for d, t in new if d not in touched)


def test_repeats_in_one_document(spark):
    p = words("p", 30)
    df = spark.createDataFrame([(1, "\n".join([p, "a", words("q", 30), "b", p, words("z", 30), p, p]))], "doc_id long, text string")
    # The copy between other lines, of 30 words, is too short to go; the two at the end are a run of 60.
    assert line_dedup.dedup_lines(df).first()["text"].split("\n") == [p, "a", words("q", 30), "b", p, words("z", 30)]


def test_line_dedup_of_any_ids_and_a_very_long_text(spark):
    p = words("p", 60)
    long = "\n".join(words(f"x{i}y", 12) for i in range(40_000)) + "\n" + p
    rows = [("b", long), ("a", p), (None, long), ("a", p), ("c", "a\n" + p)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = [(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(df).collect()]
    # Places go by id: "a" is the first of p, "b" of the long text; null comes last.
    assert sorted(got, key=str) == sorted([("b", long[: -len(p) - 1]), ("a", p), (None, ""), ("a", p), ("c", "a")], key=str)


def test_salted_groups_compare_alike(spark, monkeypatch):
    docs, _ = passages()
    copies = {d: docs[3] + "\nown " + words(f"c{d}", 20) for d in range(200, 260)}
    df = spark.createDataFrame(list({**docs, **copies}.items()), "doc_id long, text string")
    want = sorted(map(tuple, line_dedup.dedup_lines(df).collect()))
    for size in (3, 20):  # several rounds, and one
        monkeypatch.setattr(line_dedup, "GROUP", size)
        assert sorted(map(tuple, line_dedup.dedup_lines(df).collect())) == want


def test_salts_split_exact_copies(spark):
    rows = [(d, 7, 0, 50) for d in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text_hash long, start int, salts int")
    salt = F.pmod(F.xxhash64("doc_id", "text_hash", "start", F.lit(0)), F.col("salts"))
    sizes = [r["count"] for r in df.groupBy(salt).count().collect()]
    assert len(sizes) == 50 and max(sizes) < 200


def test_a_hash_collision_removes_nothing():
    import pyarrow as pa

    names = ["doc_id", "text_hash", "start", "n_lines", "hash_a", "hash_b", "salts", "salt", "chunk", "before", "after"]
    rows = [(1, 1, 0, 1, 5, 5, 1, 0, b"same", None, b"x"), (2, 2, 4, 1, 5, 5, 1, 0, b"other", None, None), (3, 3, 4, 1, 5, 5, 1, 0, b"same", b"y", b"x"), (4, 4, 4, 1, 5, 5, 1, 0, b"other", b"y", b"x")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
    out = pa.Table.from_batches(line_dedup._match_batches(iter([batch]))).to_pylist()
    assert [(r["doc_id"], r["start"], r["stop"]) for r in out] == [(3, 4, 6), (4, 4, 5)]
