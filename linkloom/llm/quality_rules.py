"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Rolling hashes of every n-gram length run over whole batches of word hashes in numpy. A
duplicated n-gram holds duplicated shorter ones, so each length looks only at the places
where the shorter one was found twice. What has equal hashes is compared itself before it counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, same_bytes, text_buffer
from .textnum import NOT_SPACE, U, lines, mix, span_hashes, spans

#: n-gram length: most of the characters that may lie in later copies of an n-gram.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.30
WINDOW = 8
#: Bytes of a text that are looked at together, and hashes above which sorting goes by parts.
BLOCK, PASS = 4 << 20, 1 << 22
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_STEP = U(0xA0761D6478BD642F)

COLUMNS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(), "dup_line_chars": pa.int64(),
    **{f"dup_chars_{n}": pa.int64() for n in NGRAM_LIMITS},
}
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, " + ", ".join(f"dup_chars_{n} long" for n in NGRAM_LIMITS)


def _later(key: np.ndarray, equal: Callable, exact: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Which members occur twice or more, and which have an equal one before them.

    Equal keys make candidates; equal(a, b) compares places in pairs, and where it finds a
    difference exact(i) tells the members of that key apart.
    """
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    parts = 1 if len(key) < PASS else 16
    for part in range(parts):  # so that a long text's keys are not sorted all at once
        some = np.arange(len(key)) if parts == 1 else np.flatnonzero(key >> U(60) == U(part))
        own = key[some]
        ordered = np.sort(own)
        repeated = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(repeated):
            continue
        at = some[np.flatnonzero(np.isin(own, repeated))]
        by = at[np.argsort(key[at], kind="stable")]
        same = key[by[1:]] == key[by[:-1]]
        found, before = by[1:][same], by[:-1][same]
        wrong = ~equal(before, found)
        later[found] = True
        twice[at] = True
        if wrong.any():
            mixed = at[np.isin(key[at], key[found[wrong]])]
            twice[mixed] = later[mixed] = False
            first: dict = {}
            for i in mixed.tolist():
                j = first.setdefault((key[i], exact(i)), i)
                if j != i:
                    twice[i] = twice[j] = later[i] = True
    return twice, later


def _covered(places: np.ndarray, n: int, size: int) -> np.ndarray:
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, places, 1)
    np.add.at(step, places + n, -1)
    return np.cumsum(step[:-1], dtype=np.int32) > 0


def _blocks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of a buffer that cut no word: of BLOCK bytes or less, or one longer word."""
    at = 0
    while len(data) - at > BLOCK:
        gaps = np.flatnonzero(~NOT_SPACE[data[at : at + BLOCK]])
        if len(gaps):
            stop = at + int(gaps[-1]) + 1
        else:
            stop = at + BLOCK
            while stop < len(data) and NOT_SPACE[data[stop : stop + BLOCK]].all():
                stop += BLOCK
            stop = min(len(data), stop)
            if stop < len(data):
                stop += int(np.argmin(NOT_SPACE[data[stop : stop + BLOCK]]))
        yield at, stop
        at = stop
    yield at, len(data)


def _scanned(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, document, hash and code points of each word, and each document's symbols; what
    is held for each byte is held for a block at a time."""
    place = np.int32 if len(data) < 1 << 31 else np.int64
    parts = []
    symbols = np.zeros(len(offsets) - 1, np.int64)
    for a, z in _blocks(data):
        part, own = data[a:z], np.clip(offsets, a, z) - a
        if z - a > BLOCK:  # one word
            points = sum(int(np.count_nonzero((part[i : i + BLOCK] & 0xC0) != 0x80)) for i in range(0, z - a, BLOCK))
            symbols[-1] += sum(int(np.count_nonzero(SYMBOLS[part[i : i + BLOCK]])) for i in range(0, z - a, BLOCK))
            doc = np.searchsorted(offsets, [a], "right") - 1
            parts.append((np.array([a], place), np.array([z], place), doc.astype(np.int32), np.array([xxhash.xxh64_intdigest(memoryview(part), 7)], U), np.array([points], place)))
            continue
        start, end, doc = spans(part, own, NOT_SPACE)
        points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        marks = np.flatnonzero(SYMBOLS[part])
        symbols += np.diff(np.searchsorted(marks, own))
        parts.append(((start + a).astype(place), (end + a).astype(place), doc.astype(np.int32), span_hashes(part, start, end), (points[end] - points[start]).astype(place)))
    return *(np.concatenate(x) for x in zip(*parts)), symbols


def _grown(words: np.ndarray, doc: np.ndarray, places: np.ndarray, rolled: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of length words with a word more, where their document has one."""
    keep = places + length < len(words)
    keep[keep] = doc[places[keep] + length] == doc[places[keep]]
    places, rolled = places[keep], rolled[keep]
    rolled *= _STEP
    rolled += words[places + length]
    return places, rolled


def _told_apart(data: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray, some: np.ndarray) -> bool:
    """Gives words of one hash but different bytes, among the places `some`, hashes of their own;
    whether there were any."""
    by = some[np.argsort(words[some], kind="stable")]
    same = words[by[1:]] == words[by[:-1]]
    a, b = by[:-1][same], by[1:][same]
    size = end[a] - start[a]
    alike = size == end[b] - start[b]
    alike[alike] = same_bytes(data, start[a[alike]], start[b[alike]], size[alike].astype(np.int64))
    if alike.all():
        return False
    number: dict[bytes, int] = {}
    for i in by[np.isin(words[by], words[b[~alike]])].tolist():
        raw = data[start[i] : end[i]].tobytes()
        words[i] = (int(words[i]) + (number.setdefault(raw, len(number)) << 1) * int(_STEP)) & 0xFFFFFFFFFFFFFFFF
    return True


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each document of a buffer. Hashes find what may be equal; lines, words and
    n-grams are then compared themselves."""
    n_docs = len(offsets) - 1
    data = np.ascontiguousarray(data)
    start, end, doc, words, chars, symbols = _scanned(data, offsets)

    def total(weights: np.ndarray, of: np.ndarray = doc) -> np.ndarray:
        return np.bincount(of, weights=weights, minlength=n_docs).astype(np.int64)

    out = {"n_words": np.bincount(doc, minlength=n_docs).astype(np.int64), "word_chars": total(chars), "n_symbols": symbols}

    l_start, l_end, l_doc = lines(data, offsets)
    first_word, next_word = np.searchsorted(start, l_start), np.searchsorted(start, l_end)
    has_word = next_word > first_word
    l_start, l_end, l_doc, first_word, next_word = l_start[has_word], l_end[has_word], l_doc[has_word], first_word[has_word], next_word[has_word]
    view = memoryview(data)
    hashed = np.array([xxhash.xxh3_64_intdigest(view[a:z]) for a, z in zip(l_start.tolist(), l_end.tolist())], U)

    def equal_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        alike = (l_end[a] - l_start[a] == l_end[b] - l_start[b]) & (l_doc[a] == l_doc[b])
        alike[alike] = same_bytes(data, l_start[a[alike]], l_start[b[alike]], (l_end - l_start)[a[alike]])
        return alike

    _, again = _later(mix(hashed ^ mix(l_doc.astype(U) + U(1))), equal_lines, lambda i: (l_doc[i], bytes(view[l_start[i] : l_end[i]])))
    before = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
    line_chars = before[next_word] - before[first_word]
    del before, first_word, next_word
    out["n_dup_lines"] = np.bincount(l_doc[again], minlength=n_docs).astype(np.int64)
    out["dup_line_chars"] = total(line_chars[again], l_doc[again])

    out["n_repeat_words"] = np.zeros(n_docs, np.int64)
    shortest = min(NGRAM_LIMITS)
    while True:
        places, rolled, length = np.arange(len(words)), words.copy(), 1
        while length < shortest:
            places, rolled = _grown(words, doc, places, rolled, length)
            length += 1
        key = mix(rolled ^ mix(doc[places].astype(U) + U(7)))
        always = lambda a, b: np.ones(len(a), bool)
        twice, _ = _later(key, always, int)
        # All words of n-grams that may be repeated are now told apart by their bytes.
        if not _told_apart(data, start, end, words, np.flatnonzero(_covered(places[twice], shortest, len(words)))):
            break
    places, rolled = places[twice], rolled[twice]
    for n in NGRAM_LIMITS:
        while length < n:  # the window grows by a word
            places, rolled = _grown(words, doc, places, rolled, length)
            length += 1

        def equal_grams(a: np.ndarray, b: np.ndarray, n: int = n) -> np.ndarray:
            alike = doc[places[a]] == doc[places[b]]
            for k in range(n):
                alike &= words[places[a] + k] == words[places[b] + k]
            return alike

        twice, later = _later(mix(rolled ^ mix(doc[places].astype(U) + U(7))), equal_grams, lambda i, n=n: (doc[places[i]], words[places[i] : places[i] + n].tobytes()))
        inside = _covered(places[later], n, len(words))
        out[f"dup_chars_{n}"] = total(chars * inside)
        if n == WINDOW:
            out["n_repeat_words"] = total(_covered(places[twice], n, len(words)))
        places, rolled = places[twice], rolled[twice]
    return out


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        parts = [measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in runs(offsets)]
        found = [pa.array(np.concatenate([p[c] for p in parts]) if parts else [], t) for c, t in COLUMNS.items()]
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *found], [*rest, *COLUMNS])


def quality(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Measures and verdict of each row of docs; other columns are not carried.

    A null or wordless text has zeros everywhere and base_failed; an empty table gives an empty
    one. Repeated rows each get their own row; ties do not arise. Texts are read whole, a very long
    one in a pass of its own that holds some 75 bytes a word beside the text.
    kept is false if base_failed, if over 30 % of the word characters lie in lines equal to an
    earlier one, or if for some n from 5 to 10 more than NGRAM_LIMITS[n] of them lie in n-grams
    that occurred before.
    """
    kind = docs.schema[id].dataType.simpleString()
    out = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_mapped, f"doc_id {kind}, {SCHEMA}")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    bad = F.col("dup_line_chars") > LINE_LIMIT * F.col("word_chars")
    for n, limit in NGRAM_LIMITS.items():
        bad = bad | (F.col(f"dup_chars_{n}") > limit * F.col("word_chars"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~(F.col("base_failed") | bad))
