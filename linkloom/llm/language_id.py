"""Language identification by a byte convolutional network in numpy.

Bytes are embedded, convolved with filters of several widths, max-pooled over a window of
WINDOW bytes and classified by softmax. A document's score for a language is the mean over all
its windows, by the bytes they hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, slices, text_buffer, texts

WINDOW, EMBEDDING, WIDTHS, FILTERS = 256, 6, (2, 3, 4), 12
#: Training takes at most so many documents of each language, and windows of each of them.
SAMPLE, SAMPLE_WINDOWS, EPOCHS, MAX_LANGUAGES = 600, 4, 6, 200
UNKNOWN = "und"
#: Bytes of which windows are held at once, a multiple of WINDOW.
PIECE = 1 << 20
_letter = regex.compile(r"\p{L}").search


class Network:
    """Filters of all widths lie in one matrix over the widest; the rows a narrower one doesn't
    see are masked. Windows are padded with the byte 0, whose embedding is 0."""

    def __init__(self, languages: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.languages, total = languages, FILTERS * len(WIDTHS)
        self.mask = np.zeros((max(WIDTHS) * EMBEDDING, total), np.float32)
        for i, k in enumerate(WIDTHS):
            self.mask[: k * EMBEDDING, i * FILTERS : (i + 1) * FILTERS] = 1
        normal = lambda *shape: rng.standard_normal(shape).astype(np.float32)
        self.p = {"e": normal(256, EMBEDDING), "w": normal(total, len(languages)) / np.float32(total**0.5), "b": np.zeros(len(languages), np.float32)}
        self.p["e"][0] = 0
        self.p["c"] = normal(*self.mask.shape) * self.mask / np.sqrt(self.mask.sum(axis=0))
        self.p["d"] = np.zeros(total, np.float32)

    def seen(self, windows: np.ndarray) -> np.ndarray:
        """For each place of each window the embedded bytes that the filters see there."""
        wide = np.zeros((len(windows), windows.shape[1] + max(WIDTHS) - 1), np.uint8)
        wide[:, : windows.shape[1]] = windows
        x = self.p["e"][wide]
        shape = (len(windows), windows.shape[1], max(WIDTHS) * EMBEDDING)
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, shape, x.strides)).reshape(-1, shape[2])

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        z = (self.seen(windows) @ self.p["c"]).reshape(len(windows), windows.shape[1], -1)
        return np.maximum(z.max(axis=1) + self.p["d"], 0)

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.p["w"] + self.p["b"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, windows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.softmax(self.pooled(windows[i : i + 64])) for i in range(0, len(windows), 64)] or [np.zeros((0, len(self.languages)), np.float32)])

    def gradients(self, windows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n, size = windows.shape
        seen = self.seen(windows).reshape(n, size, -1)
        z = seen @ self.p["c"]
        at = z.argmax(axis=1)  # n, filters
        h = np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0] + self.p["d"], 0)
        error = self.softmax(h)
        error[np.arange(n), y] -= 1
        error /= n
        own = (error @ self.p["w"].T) * (h > 0)
        rows = np.arange(n)[:, None]
        g = {"w": h.T @ error, "b": error.sum(axis=0), "d": own.sum(axis=0), "e": np.zeros_like(self.p["e"])}
        g["c"] = np.einsum("nf,nfd->df", own, seen[rows, at]) * self.mask
        wide = np.zeros((n, size + max(WIDTHS) - 1), np.uint8)
        wide[:, :size] = windows
        used = wide[rows[:, :, None], at[:, :, None] + np.arange(max(WIDTHS))]  # n, filters, widest
        np.add.at(g["e"], used.ravel(), (own[:, :, None] * self.p["c"].T[None]).reshape(-1, EMBEDDING))
        g["e"][0] = 0
        return g

    def fit(self, windows: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 5e-3, seed: int = 1) -> None:
        """Adam on the cross-entropy; languages weigh alike however many windows they have."""
        rng = np.random.default_rng(seed)
        m, v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                g, t = self.gradients(windows[part], y[part]), t + 1
                step = rate * (0.3 if epoch == epochs - 1 else 1) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
                for k in self.p:
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.01 * (g[k] * g[k] - v[k])
                    self.p[k] -= (step * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of each document, its last one padded; their document and bytes."""
    length = np.diff(offsets)
    count = -(-length // WINDOW)
    doc = np.repeat(np.arange(len(length)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    out = np.zeros((len(doc), WINDOW), np.uint8)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], length) + np.repeat((np.cumsum(count) - count) * WINDOW, length)
    out.ravel()[place] = data
    return out, doc, np.minimum(WINDOW, length[doc] - number * WINDOW)


def document_means(net: Network, data: np.ndarray, offsets: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Each document's probabilities, the mean over its windows by their bytes; 0 for an empty one.
    A document longer than `piece` bytes is cut where windows begin, so memory has a bound."""
    length = np.diff(offsets)
    count = -(-length // piece)
    doc = np.repeat(np.arange(len(length)), count)
    start = offsets[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * piece
    bounds = np.append(start, offsets[-1])  # pieces lie one after another
    out = np.zeros((len(length), len(net.languages)))
    for a, z in runs(bounds, piece):
        windows, of, size = cut_windows(data[bounds[a] : bounds[z]], bounds[a : z + 1] - bounds[a])
        np.add.at(out, doc[a:z][of], net.predict(windows) * size[:, None].astype(np.float64))
    return out / np.maximum(length, 1)[:, None]


def held_out(id: str = "doc_id"):  # noqa: ANN201
    return F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network from documents with text and lang that aren't held out; None without any.

    Of each language at most about `sample` rows are taken, those of least hash of id and text (equal
    ones count once), and SAMPLE_WINDOWS windows of each from places spread over its text. More than MAX_LANGUAGES
    languages are an error. Null ids are never held out, nor are they learned from.
    """
    own = docs.select("doc_id", "lang", "text").where(F.col("doc_id").isNotNull() & ~held_out()).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, min(1.0, sample / n)).otherwise(share)
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000 < share
    pieces = F.concat_ws("", *(F.substring("text", F.lit(1) + (F.length("text") * i / SAMPLE_WINDOWS).cast("int"), F.lit(WINDOW)) for i in range(SAMPLE_WINDOWS)))
    rows = own.where(spread).select("doc_id", "lang", pieces.alias("piece")).distinct().toPandas().sort_values(["lang", "doc_id", "piece"])
    net = Network(sorted(counts))
    if len(rows):
        windows, doc, _ = cut_windows(*text_buffer(pa.array(rows["piece"], pa.string())))
        number = {lang: i for i, lang in enumerate(net.languages)}
        y = np.array([number[x] for x in rows["lang"]])[doc]
        size = np.bincount(y, minlength=len(net.languages))
        rng = np.random.default_rng(3)
        even = np.concatenate([rng.choice(np.flatnonzero(y == i), int(min(size.max(), 2000)), replace=n < min(size.max(), 2000)) for i, n in enumerate(size) if n])
        net.fit(windows[even], y[even])
    return net


def predict(docs: DataFrame, net: Network | None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score of every row; `und` with score 0 where text is null or has no
    letter (or nothing was learned). All windows of the whole text count. Repeated rows and null
    ids stay, an empty table gives an empty one; other columns, of whatever names, are not carried."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in slices(batches):
            named, score = [], []
            strings = texts(b.column("text"))
            known = np.array([net is not None and _letter(s) is not None for s in strings], bool)
            if net is not None:
                mean = document_means(net, *text_buffer(b.column("text")))
                best = mean.argmax(axis=1)
                named = [net.languages[i] if k else UNKNOWN for i, k in zip(best, known)]
                score = np.where(known, np.clip(mean.max(axis=1), 0, 1), 0.0)
            else:
                named, score = [UNKNOWN] * len(strings), np.zeros(len(strings))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(named, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def remainder(doc_id: int) -> int:
    return crc32(str(doc_id).encode()) % 4
