"""Line deduplication by content-defined chunks of lines.

A hash rolls over the hashes of WINDOW lines; its top bit says whether a line ends a chunk. A
boundary so depends on no line outside its window, and chunks fall alike wherever a passage stands.
Two chunkings with complementary boundaries are taken, and a line of LONG_LINE words or more is a
chunk of its own. So every place of a passage of MIN_WORDS words holds a whole chunk of it: with
up to three lines one is long; with more lines, none of them long, three of its boundaries or more
don't depend on other lines, and two of these are of the same chunking.

Chunks found in several places are compared byte by byte with earlier places, the match is carried
on into the lines before and after, and runs of matched lines of MIN_WORDS words or more are
removed. What is removed equals a line at an earlier place, so one copy of every line stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, texts

MIN_WORDS, WINDOW = 50, 2
#: A third of the words of the shortest passage that goes.
LONG_LINE = -(-MIN_WORDS // 3)
#: Places of a chunk that one task compares; more are salted.
GROUP = 250
_BASE, _ODD, _MASK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


def bits(lines: list[bytes], window: int = WINDOW) -> list[int]:
    """For each line the chunking that has a boundary after it, from the lines of its window."""
    hashes = [xxhash.xxh64_intdigest(x.strip()) for x in lines]
    gone = pow(_BASE, window, 1 << 64)
    rolled, out = 0, []
    for i, h in enumerate(hashes):
        rolled = (rolled * _BASE + h - (hashes[i - window] * gone if i >= window else 0)) & _MASK
        out.append((rolled * _ODD & _MASK) >> 63)
    return out


def chunks(lines: list[bytes], long_line: int = LONG_LINE, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(chunking, first line, lines) of all chunks, those without a word included; sorted by
    chunking, then place: a chunking's chunks are the whole text."""
    long = [len(x.split()) >= long_line for x in lines]
    ends = bits(lines, window)
    out = []
    for chunking in (0, 1):
        first = 0
        for i in range(len(lines)):
            if i + 1 == len(lines) or ends[i] == chunking or long[i] or long[i + 1]:
                out.append((chunking, first, i + 1 - first))
                first = i + 1
    return out


def _digest(lines: list[bytes]) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(b"\n".join(lines))
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names)


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk that holds a word, by its place."""
    names = ["doc_id", "text_hash", "start", "n_lines", "hash_a", "hash_b"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    for b in slices(batches):
        rows = []
        for doc, h, s in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), texts(b.column("text"))):
            lines = s.encode().split(b"\n")
            for first, n in sorted({(first, n) for _, first, n in chunks(lines) if any(x.strip() for x in lines[first : first + n])}):
                rows.append((doc, h, first, n, *_digest(lines[first : first + n])))
        yield _batch(rows, names, [b.schema.field("doc_id").type, *kinds])


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of repeated chunks, with the chunks beside them and WINDOW - 1 lines more before:
    as far as a passage can reach without another chunk of its own. Places that aren't the first
    need them only where they aren't later places of repeated chunks themselves."""
    names = ["doc_id", "text_hash", "start", "n_lines", "hash_a", "hash_b", "salts", "chunk", "before", "after"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    done = set()  # rows that repeat id and text are one place
    for b in slices(batches):
        rows, size = [], 0
        kind = b.schema.field("_ld_id").type
        for doc, h, s, found in zip(b.column("_ld_id").to_pylist(), b.column("_ld_key").to_pylist(), texts(b.column("_ld_text")), b.column("_ld_found").to_pylist()):
            if (doc, h) in done:
                continue
            done.add((doc, h))
            lines = s.encode().split(b"\n")
            own = chunks(lines)
            covered = set()
            for f in found:
                if not f["keeper"]:
                    covered.update(range(f["start"], f["start"] + f["n_lines"]))
            place: dict[tuple[int, int], list[int]] = {}
            for i, (_, first, n) in enumerate(own):
                place.setdefault((first, n), []).append(i)
            for f in found:
                first, n = f["start"], f["n_lines"]
                low = high = None
                if first and (f["keeper"] or first - 1 not in covered):
                    low = max(0, min(own[i - 1][1] for i in place[first, n]) - WINDOW + 1)
                if first + n < len(lines) and (f["keeper"] or first + n not in covered):
                    high = max(own[i + 1][1] + own[i + 1][2] for i in place[first, n])
                before = b"\n".join(lines[low:first]) if low is not None else None
                after = b"\n".join(lines[first + n : high]) if high is not None else None
                body = b"\n".join(lines[first : first + n])
                rows.append((doc, h, first, n, f["hash_a"], f["hash_b"], f["salts"], body, before, after))
                size += len(body) + len(before or b"") + len(after or b"")
                if size > 8 << 20:
                    yield _batch(rows, names, [kind, *kinds])
                    rows, size = [], 0
        yield _batch(rows, names, [kind, *kinds])


def _known(tree: dict, lines: list[bytes]) -> int:
    """How many of the lines, from the first on, an earlier place had in the same order; the tree
    then has them all."""
    n, new = 0, False
    for x in lines:
        if x not in tree:
            new = True
            tree[x] = {}
        tree = tree[x]
        n += not new
    return n


def _match_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line ranges equal to lines of an earlier place; rows come sorted by chunk, salt and place.

    The first place of a salt stands for the places of the salt: with its texts it goes on to the
    next round, where the salts of a chunk meet. Rows of one place (repeated rows) count once.
    """
    names = ["doc_id", "text_hash", "start", "stop", "n_lines", "hash_a", "hash_b", "salts", "chunk", "before", "after"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    key = last = None
    seen: dict[bytes, tuple[dict, dict]] = {}
    for b in slices(batches):
        rows = []
        columns = ("doc_id", "text_hash", "start", "n_lines", "hash_a", "hash_b", "salts", "salt", "chunk", "before", "after")
        for doc, h, start, n, ha, hb, salts, salt, chunk, before, after in zip(*(b.column(c).to_pylist() for c in columns)):
            if (ha, hb, salt) != key:
                key, seen, last = (ha, hb, salt), {}, None
                if salts > 1:
                    rows.append((doc, h, start, None, n, ha, hb, salts, chunk, before, after))
            if (doc, h, start) == last:
                continue
            last = (doc, h, start)
            again = chunk in seen  # equal bytes, not only equal hashes
            low, high = seen.setdefault(chunk, ({}, {}))
            x = _known(low, before.split(b"\n")[::-1]) if before is not None else 0
            y = _known(high, after.split(b"\n")) if after is not None else 0
            if again:
                rows.append((doc, h, start - x, start + n + y, *[None] * 7))
        yield _batch(rows, names, [b.schema.field("doc_id").type, *kinds])


def clean(text: str, ranges: list[tuple[int, int]], min_words: int = MIN_WORDS) -> tuple[str, int, int]:
    """The text without the runs of matched lines that are long enough; lines before, lines gone."""
    lines = text.split("\n")
    gone, stop, begin = set(), -1, 0
    for a, z in [*sorted(ranges), (len(lines) + 2, len(lines) + 2)]:
        if a > stop:
            if stop >= 0 and sum(len(x.encode().split()) for x in lines[begin:stop]) >= min_words:
                gone.update(range(begin, stop))
            begin, stop = a, z
        stop = max(stop, z)
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)


def _clean_batches(min_words: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out, before, gone = [], [], []
            for s, found in zip(b.column("_ld_text").to_pylist(), b.column("_ld_ranges").to_pylist()):
                t, n, k = clean(s, [(r["start"], r["stop"]) for r in found or ()], min_words) if s is not None else (None, 0, 0)
                out.append(t)
                before.append(n)
                gone.append(k)
            rest = [c for c in b.schema.names if c not in ("_ld_text", "_ld_ranges")]
            cols = [pa.array(out, pa.string()), pa.array(before, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *cols], [*rest, "_ld_text", "_ld_lines", "_ld_gone"])

    return run


def _keyed(docs: DataFrame, text: str, id: str) -> DataFrame:
    return docs.withColumnRenamed(text, "_ld_text").withColumns({"_ld_id": F.col(id), "_ld_key": F.xxhash64("_ld_text")})


def _same_row(keyed: DataFrame, other: DataFrame, id: str, key: str):  # noqa: ANN202
    return keyed["_ld_id"].eqNullSafe(other[id]) & (keyed["_ld_key"] == other[key])


def repeated_ranges(keyed: DataFrame) -> DataFrame:
    """(doc_id, text_hash, ranges): matched lines [start, stop) of each document that has any."""
    kind = keyed.schema["_ld_id"].dataType.simpleString()
    place = f"doc_id {kind}, text_hash long, start int"
    base = keyed.select(F.col("_ld_id").alias("doc_id"), F.col("_ld_key").alias("text_hash"), F.col("_ld_text").alias("text"))
    found = cut(base.mapInArrow(_chunk_batches, f"{place}, n_lines int, hash_a long, hash_b long"))
    at = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("start").alias("s"))
    # Cut, so that the join has an exchange on either side and a hot chunk's partition can be split.
    several = cut(found.groupBy("hash_a", "hash_b").agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1"))
    hits = found.join(several, ["hash_a", "hash_b"]).withColumn("keeper", at.eqNullSafe(F.col("first"))).withColumn("salts", F.ceil(F.col("n") / GROUP).cast("int"))
    # A document's own chunks: no more than its lines. The hint builds on these lists, a row for a
    # document and shorter than its text, where a sort of the texts would spill them.
    by_doc = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n_lines", "hash_a", "hash_b", "keeper", "salts")).alias("_ld_found"))
    by_doc = by_doc.toDF("_ld_d", "_ld_h", "_ld_found").hint("shuffle_hash")
    # All columns go along, though unused: so the texts are dealt out once for this join and the last.
    mine = keyed.join(by_doc, _same_row(keyed, by_doc, "_ld_d", "_ld_h"))
    carried = "n_lines int, hash_a long, hash_b long, salts int, chunk binary, before binary, after binary"
    spread = mine.mapInArrow(_text_batches, f"{place}, {carried}")
    ranges, level = None, 0
    while True:
        # By place, so copies of a text are spread over all salts.
        salt = F.pmod(F.xxhash64("doc_id", "text_hash", "start", F.lit(level)), F.col("salts")).cast("int")
        dealt = spread.withColumn("salt", salt).repartition("hash_a", "hash_b", "salt").sortWithinPartitions("hash_a", "hash_b", "salt", F.col("doc_id").isNull(), "doc_id", "text_hash", "start")
        matched = dealt.mapInArrow(_match_batches, f"{place}, stop int, {carried}")
        matched = cut(matched)
        part = matched.where("stop is not null").select("doc_id", "text_hash", "start", "stop")
        ranges = part if ranges is None else ranges.union(part)
        spread = matched.where("stop is null").drop("stop").withColumn("salts", F.ceil(F.col("salts") / GROUP).cast("int"))
        if spread.isEmpty():
            return ranges.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
        level += 1


def dedup_lines(docs: DataFrame, text: str = "text", id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text cleaned, and _ld_lines and _ld_gone: lines before, and lines removed.

    The first place is that of the least (id, text hash, line); null ids come last. Ids may be of
    any type that has an order. A null text stays null with 0 lines; a text without words loses
    nothing. Rows that repeat both id and text are one place: all stay alike. Within a document
    later repeats go too. Other columns are carried, whatever their names (but for those that begin
    with _ld_). An empty table gives an empty one. Of a chunk with over GROUP places each salt's
    first is compared with the other salts' in a further round; lines beside the chunk that only
    the other places share are not met then.
    """
    keyed = _keyed(docs, text, id)
    ranges = repeated_ranges(keyed).toDF("_ld_d", "_ld_h", "_ld_ranges").hint("shuffle_hash")
    both = keyed.join(ranges, _same_row(keyed, ranges, "_ld_d", "_ld_h"), "left")
    names = docs.columns
    rest = [c for c in names if c != text]
    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    shape += ", " * bool(rest) + "_ld_text string, _ld_lines long, _ld_gone long"
    out = both.select(*rest, "_ld_text", "_ld_ranges").mapInArrow(_clean_batches(min_words), shape)
    return out.select(*(F.col("_ld_text").alias(text) if c == text else c for c in names), "_ld_lines", "_ld_gone")
