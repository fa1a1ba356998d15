"""Edit-aware token counts.

Each document has a segment tree over its pre-tokens: a leaf is a run of up to LEAF of them
with its characters and tokens, an inner node the sums of its two children. An edit re-encodes
only the leaves it touches plus boundary context, until a pre-token ends where an old leaf
ended; sums change on the paths from these leaves to the root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SharedTokenizer, Tokenizer
from .common import slices, texts

LEAF = 32
#: Whether a pre-token ends at a place depends on at most so many characters after it.
LOOKAHEAD = 2


class Tree:
    """Characters and tokens of runs of pre-tokens, with sums. Node 1 is the root."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.size = 1 << max(0, len(chars) - 1).bit_length()
        self.used = len(chars)
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + len(chars), 0] = chars
        self.sums[self.size : self.size + len(tokens), 1] = tokens
        for i in range(self.size.bit_length() - 2, -1, -1):
            low = 1 << i
            self.sums[low : 2 * low] = self.sums[2 * low : 4 * low : 2] + self.sums[2 * low + 1 : 4 * low : 2]

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at (the last one, beyond the end), and its start."""
        node, start = 1, 0
        while node < self.size:
            left = int(self.sums[2 * node, 0])
            if at < left or not self.sums[2 * node + 1, 0]:
                node = 2 * node
            else:
                at, start, node = at - left, start + left, 2 * node + 1
        return node - self.size, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        self.sums[node] = chars, tokens
        while node > 1:
            node >>= 1
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]


def _leaves(pieces: list[str], counts: list[int]) -> tuple[list[int], list[int]]:
    at = range(0, len(counts), LEAF)
    return [sum(map(len, pieces[i : i + LEAF])) for i in at], [sum(counts[i : i + LEAF]) for i in at]


def build(t: Tokenizer, text: str) -> Tree:
    pieces = t.find(text)
    counts = list(map(len, t.pieces_of(pieces)))
    return Tree(*_leaves(pieces, counts))


def edit(t: Tokenizer, tree: Tree, text: str, start: int, stop: int, new: str) -> tuple[Tree, str, int]:
    """Replaces characters start to stop (clipped to the text); the tree, the text and the
    characters that were encoded again."""
    start = min(max(start, 0), len(text))
    stop = min(max(stop, start), len(text))
    shift = len(new) - (stop - start)
    edited = text[:start] + new + text[stop:]
    if not tree.n_chars or not edited:
        return build(t, edited), edited, len(edited)
    first, begin = tree.find(max(0, start - LOOKAHEAD))
    last, end = first, begin + int(tree.sums[tree.size + first, 0])
    pieces: list[str] = []
    at = begin
    for m in t.iterate(edited, begin):
        at = m.end()
        pieces.append(m.group())
        while last + 1 < tree.used and (end < stop or end + shift < at):
            last += 1
            end += int(tree.sums[tree.size + last, 0])
        if end >= stop and end + shift == at:
            break
    else:  # to the end of the text
        last = tree.used - 1
    counts = [len(t.piece(p)) for p in pieces]
    if len(pieces) > 4 * LEAF:  # many new leaves: others keep their sums, the tree is laid out anew
        chars, tokens = _leaves(pieces, counts)
        old = tree.sums[tree.size : tree.size + tree.used]
        return Tree([*old[:first, 0].tolist(), *chars, *old[last + 1 :, 0].tolist()], [*old[:first, 1].tolist(), *tokens, *old[last + 1 :, 1].tolist()]), edited, at - begin
    tree.set(first, at - begin, sum(counts))
    for leaf in range(first + 1, last + 1):
        tree.set(leaf, 0, 0)
    return tree, edited, at - begin


def token_counts(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", id: str = "doc_id", edits: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, reencoded_chars, edited_chars of every row.

    edits names a column array<struct<start:int,stop:int,text:string>>: replacements of
    characters, applied in order, each to the text that the one before left. Places beyond the
    text are clipped to it; a null edit, place or text counts as none, 0 or empty. Null texts
    count as empty (0 tokens). Repeated rows each get their own row.
    """
    tokenizer = SharedTokenizer(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer()
        for b in slices(batches):
            rows = []
            changes = b.column("edits").to_pylist()
            for s, todo in zip(texts(b.column("text")), changes):
                tree = build(t, s)
                before, again, todo = tree.n_tokens, 0, [e for e in todo or () if e]
                for e in todo:
                    tree, s, chars = edit(t, tree, s, e["start"] or 0, e["stop"] or 0, e["text"] or "")
                    again += chars
                rows.append((before, len(todo), tree.n_tokens, again, len(s)))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "reencoded_chars", "edited_chars"])

    kind = docs.schema[id].dataType.simpleString()
    none = F.expr("cast(array() as array<struct<start:int,stop:int,text:string>>)")
    chosen = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), (F.col(edits) if edits else none).alias("edits"))
    return chosen.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_edits long, n_tokens_edited long, reencoded_chars long, edited_chars long")


def with_edits(docs: DataFrame, edits: DataFrame, id: str = "doc_id") -> DataFrame:
    """docs with the column edits from a table (doc_id, seq, start, stop, text), in order of seq.

    A document's edits are held together, as its text is.
    """
    listed = edits.groupBy(F.col(id).alias("_ed_id")).agg(F.expr("transform(array_sort(collect_list(struct(seq, start, stop, text))), x -> struct(cast(x.start as int) as start, cast(x.stop as int) as stop, x.text as text))").alias("edits"))
    return docs.drop("edits").join(listed, docs[id] == listed["_ed_id"], "left").drop("_ed_id")
