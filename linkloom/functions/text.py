"""Normalization of names and addresses in Catalyst expressions.

Only scripts other than Latin need Python: transliterate(), an Arrow UDF.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Indian state names in their scripts.
STATES = {
    "महाराष्ट्र": "maharashtra", "ગુજરાત": "gujarat", "दिल्ली": "delhi", "मध्य प्रदेश": "madhya pradesh", "उत्तर प्रदेश": "uttar pradesh", "தமிழ்நாடு": "tamil nadu",
    "कर्नाटक": "karnataka", "ఆంధ్రప్రదేశ్": "andhra pradesh", "తెలంగాణ": "telangana", "पश्चिम बंगाल": "west bengal", "ਪੰਜਾਬ": "punjab", "राजस्थान": "rajasthan",
    "बिहार": "bihar", "हरियाणा": "haryana", "केरल": "kerala", "ଓଡ଼ିଶା": "odisha", "অসম": "assam",
}

# Legal suffixes and their categories.
SUFFIXES = {
    "private limited": "PVT_LTD", "pvt ltd": "PVT_LTD", "pvt limited": "PVT_LTD", "private ltd": "PVT_LTD", "praivet limited": "PVT_LTD",
    "piraivet limitet": "PVT_LTD", "praivet limitet": "PVT_LTD", "pra li": "PVT_LTD", "pte ltd": "PVT_LTD", "prvt ltd": "PVT_LTD",
    "limited": "LTD", "limitet": "LTD", "ltd": "LTD", "corporation": "CORP", "corp": "CORP", "incorporated": "INC", "inc": "INC",
    "llc": "LLC", "l l c": "LLC", "llp": "LLP", "sarl": "SARL", "s a r l": "SARL", "sas": "SAS", "s a s": "SAS", "sasu": "SASU", "s a s u": "SASU",
    "sci": "SCI", "s c i": "SCI", "sa": "SA", "s a": "SA", "eurl": "EURL", "snc": "SNC",
}
#: Longest first; among equals as listed. The first one found anywhere decides.
ORDERED_SUFFIXES = sorted(SUFFIXES, key=len, reverse=True)

_LONG = {"œ": "oe", "Œ": "OE", "ß": "ss", "æ": "ae", "Æ": "AE", "þ": "th", "Þ": "TH"}
_SINGLE = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ı": "i", "ħ": "h", "Ħ": "H"}


# Sounds of Cyrillic and Greek letters by their Unicode names, where these differ.
_SOUNDS = {
    "BE": "b", "VE": "v", "GHE": "g", "DE": "d", "IE": "e", "IO": "e", "ZHE": "zh", "ZE": "z", "SHORT I": "i", "KA": "k", "EL": "l", "EM": "m", "EN": "n", "PE": "p", "ER": "r", "ES": "s", "TE": "t",
    "EF": "f", "HA": "kh", "TSE": "ts", "CHE": "ch", "SHA": "sh", "SHCHA": "shch", "HARD SIGN": "", "YERU": "y", "SOFT SIGN": "", "BYELORUSSIAN-UKRAINIAN I": "i", "UKRAINIAN IE": "e",
    "ALPHA": "a", "BETA": "v", "GAMMA": "g", "DELTA": "d", "EPSILON": "e", "ZETA": "z", "ETA": "i", "THETA": "th", "IOTA": "i", "KAPPA": "k", "LAMDA": "l", "MU": "m", "NU": "n", "XI": "x",
    "OMICRON": "o", "PI": "p", "RHO": "r", "SIGMA": "s", "FINAL SIGMA": "s", "TAU": "t", "UPSILON": "y", "PHI": "f", "CHI": "kh", "PSI": "ps", "OMEGA": "o",
}


def _latin() -> dict[str, str]:
    """Latin letters with marks, and the letter that is left without them."""
    out = dict(_SINGLE)
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c not in _LONG and c not in out and len(plain) == 1 and plain.isascii() and plain.isalpha():
            out[c] = plain
    return out


def _compatible() -> tuple[dict[str, str], dict[str, str]]:
    """Forms that compatibility decomposition turns into ASCII: of one character, and of several."""
    one, several = {}, {}
    for c in map(chr, [0xA0, 0xAA, 0xB2, 0xB3, 0xB9, 0xBA, *range(0x2000, 0x2150), *range(0x2150, 0x218A), *range(0x2460, 0x24EB), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]):
        plain = unicodedata.normalize("NFKD", c)
        if plain != c and plain.isascii():
            (one if len(plain) == 1 else several)[c] = plain
    return one, several


_LATIN = _latin()
_ONE, _SEVERAL = _compatible()
_LATIN |= _ONE
#: Ligatures of the alphabetic forms; rarer forms of several characters are left to transliterate().
_COMPATIBLE = {c: x for c, x in _SEVERAL.items() if 0xFB00 <= ord(c) <= 0xFB06}


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is worked out once a row however often f names it: in lambdas and
    branches Spark works out an expression anew wherever it stands."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fold(c: Column) -> Column:
    """Latin letters without accents; ligatures and compatibility forms spelled out."""
    for a, b in (_LONG | _COMPATIBLE).items():
        c = F.replace(c, F.lit(a), F.lit(b))
    # Combining marks that stand by themselves go too.
    return F.regexp_replace(F.translate(c, "".join(_LATIN), "".join(_LATIN.values())), r"[\x{0300}-\x{036F}]+", "")


def states(c: Column) -> Column:
    for a, b in STATES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def has_other_letters(c: Column) -> Column:
    """Any letter outside A-Z and a-z; accented Latin letters are such."""
    return F.coalesce(c, F.lit("")).rlike(r"[\p{L}&&[^A-Za-z]]")


def has_indic(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"[\x{0900}-\x{0D7F}]")


def _romanize(text: str) -> str:
    """ASCII for any text, from the characters' Unicode names; Cyrillic and Greek by sound.

    In Indic scripts a consonant has an inherent a, which a vowel sign replaces and a virama or
    the word's end removes; doubled letters of the names (long vowels, retroflexes) count once.
    """
    out: list[str] = []
    inherent = False
    for ch in unicodedata.normalize("NFKC", text):
        name = unicodedata.name(ch, "")
        if ch.isascii():
            if inherent and ch.isalnum():
                out.append("a")
            inherent = False
            out.append(ch)
            continue
        kind, _, last = name.rpartition(" ")
        sound = "".join(x for i, x in enumerate(last.lower()) if i == 0 or x != last.lower()[i - 1])
        if "VOWEL SIGN" in name:
            out.append(sound)
            inherent = False
        elif "VIRAMA" in name or "NUKTA" in name:
            inherent = inherent and "NUKTA" in name
        elif any(x in name for x in ("ANUSVARA", "CANDRABINDU", "BINDI", "TIPPI")):
            out.append("an" if inherent else "n")
            inherent = False
        elif "VISARGA" in name:
            out.append("ah" if inherent else "h")
            inherent = False
        elif unicodedata.category(ch)[0] == "L" and 0x0900 <= ord(ch) <= 0x0D7F:
            out.append("a" if inherent else "")
            inherent = len(sound) > 1 and sound.endswith("a")
            out.append(sound[:-1] if inherent else sound)
        elif (digit := unicodedata.digit(ch, None)) is not None:
            inherent = False
            out.append(str(digit))
        else:
            inherent = False
            base = unicodedata.normalize("NFKD", ch)
            plain = "".join(x for x in base if x.isascii())
            script, _, letter = unicodedata.name(base[0], "").partition(" LETTER ")
            if script.startswith(("CYRILLIC", "GREEK")) and letter in _SOUNDS:
                out.append(_SOUNDS[letter])
                continue
            plain = plain or _LONG.get(ch) or _SINGLE.get(ch) or (last.lower() if unicodedata.category(ch)[0] == "L" and last.isascii() and last.isalpha() else " " if unicodedata.category(ch)[0] in "PZ" else "")
            out.append(plain)
    return "".join(out)


@F.pandas_udf(StringType())
def transliterate(c: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return c.map(lambda s: s if s is None or s.isascii() else known.get(s) or known.setdefault(s, _romanize(s)))


def _script(text: str | None) -> str:
    found = {unicodedata.name(c, f"UNNAMED_U+{ord(c):04X}").split(" ")[0] for c in text or "" if c.isalpha()}
    return "+".join(sorted(found)) or "None"


@F.pandas_udf(StringType())
def script_group(c: pd.Series) -> pd.Series:
    """First words of the letters' Unicode names, sorted and joined; a letter without a name is
    UNNAMED_ and its number."""
    return c.map(_script)


def clean(c: Column, other_scripts: bool = False) -> Column:
    """Lower-case words of letters, digits and underscores, one space between."""
    # ASCII has no letters to fold, and one pattern finds all that is between its words.
    other = lambda x: x.rlike(r"[^\x00-\x7F]")
    c = let(F.coalesce(c, F.lit("")), lambda x: F.when(other(x), fold(states(x))).otherwise(x))
    c = let(transliterate(c), lambda x: F.when(other(x), fold(x)).otherwise(x)) if other_scripts else c
    spaced = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")
    return F.trim(let(c, lambda x: F.when(other(x), spaced(x)).otherwise(F.regexp_replace(F.lower(x), r"\W+", " "))))


def suffix_pattern(name: Column) -> Column:
    """The legal suffix that decides for a clean name, or null."""
    some = name.rlike(r"\b(" + "|".join(ORDERED_SUFFIXES) + r")\b")
    ladder = F.when(~some, F.lit(None).cast("string"))
    for s in ORDERED_SUFFIXES:
        ladder = ladder.when(name.rlike(rf"\b{s}\b"), s)
    return ladder


def suffix_category(pattern: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))
    return F.coalesce(F.try_element_at(kinds, pattern), F.lit(""))


def root(name: Column, pattern: Column) -> Column:
    left = F.trim(F.regexp_replace(F.regexp_replace(name, F.concat(F.lit(r"\b"), pattern, F.lit(r"\b")), F.lit(" ")), r"\s+", " "))
    return F.when(pattern.isNull() | (left == ""), name).otherwise(left)


def numbers(address: Column) -> Column:
    return F.regexp_extract_all(address, F.lit(r"(?U)\b\d+\b"), F.lit(0))


def postal_code(address: Column, country: Column) -> Column:
    """By the country's name: India six digits, anything with "us" five (of five and four),
    France five; others none."""
    lower, address = F.lower(F.coalesce(country, F.lit(""))), F.coalesce(address, F.lit(""))
    found = (
        F.when(lower.contains("india"), F.regexp_extract(address, r"(?U)\b[1-9][0-9]{5}\b", 0))
        .when(lower.contains("us"), F.substring(F.regexp_extract(address, r"(?U)\b[0-9]{5}(?:-[0-9]{4})?\b", 0), 1, 5))
        .when(lower.contains("france"), F.regexp_extract(address, r"(?U)\b[0-9]{5}\b", 0))
    )
    return F.nullif(found, F.lit(""))


def skeleton(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"[^a-z0-9\s]", ""), "[aeiouy]", ""))


def trigrams(skeleton: Column) -> Column:
    def of(s: Column) -> Column:
        n = F.length(s)
        several = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(s, i, F.lit(3)))
        return F.when(n == 0, F.expr("cast(array() as array<string>)")).when(n < 3, F.array(s)).otherwise(several)

    return let(F.regexp_replace(skeleton, r"\s+", ""), of)


def tokens(c: Column, least: int = 1) -> Column:
    return F.filter(F.split(c, " "), lambda x: F.length(x) >= least)


def prefix_keys(root: Column) -> Column:
    """Keys of the first tokens and their beginnings, each once."""

    def of(t: Column) -> Column:
        n, part = F.size(t), lambda i: F.substring(F.get(t, F.lit(i)), 1, 4)
        pair = lambda a, b: F.concat_ws("_", F.least(a, b), F.greatest(a, b))
        two = F.array(F.concat_ws("_", F.get(t, F.lit(0)), F.get(t, F.lit(1))), pair(F.get(t, F.lit(0)), F.get(t, F.lit(1))), F.concat_ws("_", part(0), part(1)), pair(part(0), part(1)))
        three = F.array(F.concat_ws("_", part(0), part(2)))
        one = F.when(F.length(F.get(t, F.lit(0))) >= 5, F.array(F.substring(F.get(t, F.lit(0)), 1, 5)))
        none = F.expr("cast(array() as array<string>)")
        return F.array_distinct(F.when(n >= 3, F.concat(two, three)).when(n == 2, two).when(n == 1, F.coalesce(one, none)).otherwise(none))

    return let(tokens(root, 2), of)


def entity_text() -> Column:
    """A raw record as a text for an encoder."""
    part = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.concat(F.lit("business: "), part("business_name"), F.lit(" | address: "), part("business_address"), F.lit(" | country: "), part("country"))


def pipe_text() -> Column:
    """A normalized record as a text for an encoder."""
    return F.concat_ws(" | ", "clean_name", "clean_address", "country")


def normalize(records: DataFrame, other_scripts: bool = True) -> DataFrame:
    """records (entity_id, business_name, business_address, country, ...) with the normalized
    columns. other_scripts=False spares the UDF where all letters are Latin."""
    out = records.withColumns({"clean_name": clean(F.col("business_name"), other_scripts), "clean_address": clean(F.col("business_address"), other_scripts), "country": F.trim("country")})
    out = out.withColumn("_suffix", suffix_pattern(F.col("clean_name")))
    out = out.withColumns({"root_name": root(F.col("clean_name"), F.col("_suffix")), "legal_suffix": suffix_category(F.col("_suffix"))}).drop("_suffix")
    return out.withColumns(
        {
            "address_numbers": numbers(F.col("clean_address")),
            "postal_code": postal_code(F.col("business_address"), F.col("country")),
            "is_non_latin": has_other_letters(F.col("business_name")) | has_other_letters(F.col("business_address")),
            "skeleton": skeleton(F.col("root_name")),
        }
    ).withColumn("skeleton_3grams", trigrams(F.col("skeleton")))
