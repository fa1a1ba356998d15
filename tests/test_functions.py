"""Column functions against plain Python."""

import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.functions import similarity, text
from linkloom.sources.tables import entity_view


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def plain(s):
    s = "".join({"œ": "oe", "Œ": "OE", "ß": "ss", "æ": "ae"}.get(c, c) for c in s or "")
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", s)).strip()


NAMES = [None, "", "  ", "École d'Été, S.A.R.L.", "Ça va-bien_ok  Œuvre", "Straße 12b 7", "É", "Ltd", "ACME Private Limited", "foo pvt ltd inc", "l l c bar", "sasu s a s", "Zürich & Co", "x"]


def test_clean(spark):
    assert column(spark, NAMES, text.clean) == [plain(s) for s in NAMES]


def test_transliterated_suffixes(spark):
    got = column(spark, ["प्राइवेट लिमिटेड", "பிரைவேட் லிமிடெட்", "महाराष्ट्र मुंबई १२", "Привет", "日本"], lambda c: text.clean(c, True))
    assert got[0] == "praivet limited" and got[1] == "piraivet limitet" and got[2].startswith("maharashtra ") and got[2].endswith("12")
    assert all(s.isascii() for s in got) and got[3] == "privet"
    assert column(spark, ["Ωμέγα Αθήνα", "Йод щёлочь", "Київ"], lambda c: text.clean(c, True)) == ["omega athina", "iod shcheloch", "kiiv"]


def test_legal_suffix(spark):
    def want(s):
        for p in text.ORDERED_SUFFIXES:
            if re.search(rf"\b{p}\b", s):
                left = " ".join(re.sub(rf"\b{p}\b", " ", s).split())
                return left or s, text.SUFFIXES[p]
        return s, ""

    clean = [plain(s) for s in NAMES]
    roots = column(spark, clean, lambda c: text.root(c, text.suffix_pattern(c)))
    kinds = column(spark, clean, lambda c: text.suffix_category(text.suffix_pattern(c)))
    assert list(zip(roots, kinds)) == [want(s) for s in clean]
    assert want("acme private limited") == ("acme", "PVT_LTD") and want("ltd") == ("ltd", "LTD")


def test_numbers_and_postal(spark):
    assert column(spark, ["12 b 12 3b b4 007", ""], text.numbers) == [["12", "12", "007"], []]
    rows = [("at 400001 x", "India", "400001"), ("at 012345", "India", None), ("x 12345-6789 y", "US", "12345"), ("x 12345", "Australia", "12345"), ("x 75001", "France", "75001"), ("x 12345", "United States", None), (None, "US", None), ("5", None, None)]
    df = spark.createDataFrame(rows, "a string, c string, want string")
    assert df.where(~text.postal_code(F.col("a"), F.col("c")).eqNullSafe(F.col("want"))).count() == 0


def test_skeleton_and_trigrams(spark):
    assert column(spark, ["surya om", "aeiou", "a_b c"], text.skeleton) == ["sr m", "", "b c"]
    assert column(spark, ["", "ab", "abc", "a bcd", "aaaa"], text.trigrams) == [[], ["ab"], ["abc"], ["abc", "bcd"], ["aaa", "aaa"]]


@pytest.mark.parametrize("root, keys", [("", []), ("ab", []), ("alphabet", ["alpha"]), ("beta alphabet", ["beta_alphabet", "alphabet_beta", "beta_alph", "alph_beta"]), ("ab ab", ["ab_ab"]), ("one two three", ["one_two", "one_thre"]), ("a bc", [])])
def test_prefix_keys(spark, root, keys):
    assert sorted(column(spark, [root], text.prefix_keys)[0]) == sorted(keys)


def test_what_is_used_often_is_worked_out_once():
    assert str(text.prefix_keys(F.col("v"))).count("split(") == 1
    assert str(text.trigrams(F.col("v"))).count("regexp_replace(") == 1


def test_cleaning_of_ascii_and_others_is_the_same(spark):
    values = [*NAMES, "A_b-C\td\x0b9", "a\x1cb\x00c", " \u00a0x\u2003y ", "x\u0301 Y", "...", "İ I"]
    assert column(spark, values, text.clean) == column(spark, values, lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(text.fold(text.states(F.coalesce(c, F.lit(""))))), r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")))


def test_first_words_of_any_text(spark):
    many = " ".join(f"w{i}" for i in range(40))
    texts = [None, "", " ", "a", many, " " + many, "\n" * 500 + many, "x" * 500 + " " + many, "a" + " " * 450 + many, " ".join(["y" * 30] * 30), "é" * 390 + " b  c", " ".join("abcdefghijklmnopqr"), " ".join("abcdefghijklmnopqrs") + " " * 400 + "end"]
    rows = [(i, t, "en", "src3", len(t or "")) for i, t in enumerate(texts)]
    got = entity_view(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")).orderBy("seq").collect()
    for r, (_, t, *_, n) in zip(got, rows, strict=True):
        words = re.findall(r"[^ \t\n\x0b\f\r]+", t or "")
        assert (r["business_name"], r["business_address"]) == (" ".join(words[:6]), f"{n} {' '.join(words[6:18])} {n:05}"), t


def test_flags(spark):
    assert column(spark, ["abc 1", "é", "", None, "अ"], text.has_other_letters) == [False, True, False, False, True]
    assert column(spark, ["abc é", "அ", None], text.has_indic) == [False, True, False]
    assert column(spark, ["aé", "अa", "1"], text.script_group) == ["LATIN", "DEVANAGARI+LATIN", "None"]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


MANY = [(similarity.ratios, similarity.ratio), (similarity.partial_ratios, similarity.partial_ratio), (similarity.token_sorts, similarity.token_sort), (similarity.token_sets, similarity.token_set), (similarity.jaro_winklers, similarity.jaro_winkler)]
words = st.text("ab é1", max_size=14)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_similarity_measures(a, b):
    assert similarity.lcs(a, b) == slow_lcs(a, b)
    assert similarity.ratio(a, b) == similarity.ratio(b, a)
    for many, one in MANY:
        assert abs(many([(a, b)])[0] - one(a, b)) < 1e-12, many
    for f in (similarity.ratio, similarity.partial_ratio, similarity.token_sort, similarity.token_set, similarity.jaro_winkler):
        assert 0 <= f(a, b) <= 1
    assert (similarity.ratio(a, b) == 1) == (a == b)


def test_long_windows():
    rng = random.Random(0)
    pairs = [("".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 150))), "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 150)))) for _ in range(60)]
    pairs += [(a[:40], b) for a, b in pairs] + [("", ""), ("", "a"), ("a" * 70, "b" + "a" * 69)]
    for many, one in MANY:
        assert [round(x, 9) for x in many(pairs)] == [round(one(*p), 9) for p in pairs], many
        assert not len(many([]))


def test_conventions():
    assert similarity.ratio("", "") == similarity.partial_ratio("", "") == similarity.token_sort("", "") == 1
    assert similarity.token_set("", "") == similarity.jaro_winkler("", "") == similarity.partial_ratio("", "a") == 0
    assert similarity.token_set("a b", "b a c") == 1
    assert abs(similarity.jaro_winkler("martha", "marhta") - 0.961111) < 1e-5
    assert abs(similarity.jaro_winkler("abcd", "abxy") - 2 / 3) < 1e-9
