"""Toxicity by a classifier chain.

Categories are predicted one after the other: the label columns beside the overall one (quality,
in the driver's tables), then toxicity itself. Each has a linear (logistic) model over word and
word-part features; the models of later categories also see the probabilities of the earlier
ones. In training these probabilities are out-of-fold: each row's come from models, and from
features, that were chosen without it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegralType

from .common import slices, texts

#: Labelled rows a training takes at most of each label, those of least hash; the model's size,
#: and the words a training row may bring, don't grow with the corpus.
SAMPLE, FOLDS, DIMENSION, SELECTED = 3000, 4, 1 << 18, 4096
REJECT = 0.5
#: Least G statistic (halved) of a feature: at this, few of the many tested pass by chance.
GAIN = 7.0
#: Words a worker remembers the features of.
CACHE = 200_000
_words = regex.compile(r"\p{L}+").findall


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a word: itself, and its beginnings of 4 to 6 letters."""
    raw = ["=" + word, *(word[:n] for n in (4, 5, 6) if len(word) > n)]
    return tuple(crc32(x.encode()) % DIMENSION for x in raw)


class Features:
    """Features of texts; remembers words, without bearing on the results."""

    def __init__(self, wanted: np.ndarray | None = None):
        self.wanted = None if wanted is None else {int(f): i for i, f in enumerate(wanted)}
        self.cache: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        got = word_features(word)
        if self.wanted is not None:
            got = tuple(self.wanted[f] for f in got if f in self.wanted)
        if len(self.cache) > CACHE:
            self.cache.clear()
        if len(word) <= 40:
            self.cache[word] = got
        return got

    def __call__(self, text: str) -> set[int]:
        out: set[int] = set()
        cache = self.cache
        for w in set(_words(text.lower())):
            got = cache.get(w)
            out.update(self._word(w) if got is None else got)
        return out


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def score(self, rows: np.ndarray, columns: np.ndarray, n: int, dense: np.ndarray) -> np.ndarray:
        k = len(self.weights) - dense.shape[1]
        z = np.bincount(rows, weights=self.weights[columns], minlength=n) + dense @ self.weights[k:] + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(rows: np.ndarray, columns: np.ndarray, n: int, k: int, dense: np.ndarray, y: np.ndarray, rounds: int = 300, l2: float = 2e-5) -> Linear:
    """Logistic regression on k binary features and the dense columns, by Adam on all rows.

    Rows of the rarer class weigh more, as the square root of the ratio of the classes.
    """
    w = np.zeros(k + dense.shape[1])
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if n else 0.5
    model = Linear(w, float(np.log(share / (1 - share))))
    weight = np.where(y > 0, np.sqrt((1 - share) / share), 1.0)
    weight /= weight.sum() or 1
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1 if n else 1):
        error = (model.score(rows, columns, n, dense) - y) * weight
        g = np.concatenate([np.bincount(columns, weights=error[rows], minlength=k), dense.T @ error]) + l2 * model.weights
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c, s = 1 - 0.9**t, 1 - 0.99**t
        model.weights = model.weights - 0.1 * (m / c) / (np.sqrt(v / s) + 1e-9)
        model.bias -= 0.1 * (mb / c) / (np.sqrt(vb / s) + 1e-9)
    return model


@dataclass
class Chain:
    """Models in the order of the categories; the last is the overall one."""

    categories: list[str]
    features: np.ndarray
    models: list[Linear]

    def predict(self, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, 0))
        for model in self.models:
            out = np.column_stack([out, model.score(rows, columns, n, out)])
        return out


def _flat(sets: list) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in sets], np.int64)
    return np.repeat(np.arange(len(sets)), size), np.fromiter(chain.from_iterable(sets), np.int64, int(size.sum()))


def select(rows: np.ndarray, raw: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The features, sorted, that tell most of a category in these rows, by the G statistic."""
    seen = np.bincount(raw, minlength=DIMENSION).astype(float)
    with_it = np.bincount(raw, weights=y[rows], minlength=DIMENSION)
    share = np.float64(y.mean() if len(y) else 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        both = with_it * np.log(with_it / (seen * share)) + (seen - with_it) * np.log((seen - with_it) / (seen * (1 - share)))
        gain = np.where(with_it == 0, seen * np.log(1 / (1 - share)), np.where(with_it == seen, seen * np.log(1 / share), both))
    gain = np.where((seen >= 3) & np.isfinite(gain), gain, 0)
    best = np.argsort(-gain, kind="stable")[:SELECTED]
    return np.sort(best[gain[best] > GAIN])


def _known(rows: np.ndarray, raw: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the chosen features."""
    if not len(chosen):
        return rows[:0], raw[:0]
    at = np.minimum(np.searchsorted(chosen, raw), len(chosen) - 1)
    kept = chosen[at] == raw
    return rows[kept], at[kept]


def fit(sets: list, labels: np.ndarray, folds: np.ndarray, categories: list[str]) -> Chain:
    """sets: features of each row; labels: 0 or 1 by row and category; folds: each row's.

    Every category has features of its own. A fold's rows get their probabilities from models whose
    features, too, were chosen without them.
    """
    rows, raw = _flat(sets)
    n, labels = len(sets), labels.astype(float)
    earlier, chosen, models = np.zeros((n, 0)), [], []
    for c in range(len(categories)):
        y, held = labels[:, c], np.zeros(n)
        for f in np.unique(folds):
            out = folds == f
            of, renumber = out[rows], np.where(out, np.cumsum(out), np.cumsum(~out)) - 1
            own = select(renumber[rows[~of]], raw[~of], y[~out])
            part = fit_linear(*_known(renumber[rows[~of]], raw[~of], own), int((~out).sum()), len(own), earlier[~out], y[~out])
            held[out] = part.score(*_known(renumber[rows[of]], raw[of], own), int(out.sum()), earlier[out])
        chosen.append(select(rows, raw, y))
        models.append(fit_linear(*_known(rows, raw, chosen[c]), n, len(chosen[c]), earlier, y))
        earlier = np.column_stack([earlier, held])
    features = np.unique(np.concatenate(chosen))
    for own, model in zip(chosen, models):  # in the columns that all share
        weights = np.zeros(len(features) + len(model.weights) - len(own))
        weights[np.searchsorted(features, own)] = model.weights[: len(own)]
        weights[len(features) :] = model.weights[len(own) :]
        model.weights = weights
    return Chain(categories, features, models)


def train(docs: DataFrame, labels: DataFrame, categories: list[str] | None = None, overall: str = "toxic", sample: int = SAMPLE) -> Chain:
    """A chain from documents (doc_id, text) with labels (doc_id, overall, further categories).

    categories: the columns predicted before the overall one; if not given, all others of labels
    that hold whole numbers or booleans, in their order. At most `sample` rows of either overall
    label are taken, those of least hash of the id, so it doesn't matter how rows lie. Null texts,
    labels and ids are left out. An id labelled several times has the greatest label; of an id's
    several texts the one of least hash counts. Without labelled rows every probability is one half.
    """
    if categories is None:
        categories = [f.name for f in labels.schema if f.name not in ("doc_id", overall) and isinstance(f.dataType, (IntegralType, BooleanType))]
    names = [*categories, overall]
    marked = labels.select("doc_id", *(F.col(c).cast("int").alias(c) for c in names)).dropna().groupBy("doc_id").agg(*(F.max(c).alias(c) for c in names))
    order = F.xxhash64("doc_id")
    ids = None
    for value in (0, 1):
        part = marked.where(F.col(overall) == value).orderBy(order, "doc_id").limit(sample)
        ids = part if ids is None else ids.union(part)
    # 2 * sample rows at most: their size is known, so they are sent to where the texts are.
    ids = ids.select(F.col("doc_id").alias("_tx_id"), *(F.col(c).alias(f"_tx_{c}") for c in names))
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), F.col("doc_id") == F.col("_tx_id"))
    # One row for an id before anything goes to the driver: equal texts meet map-side.
    one = found.groupBy("doc_id", *(f"_tx_{c}" for c in names)).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in slices(batches):
            got = [sorted(features(s)) for s in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.list_(pa.int32())), *(b.column(f"_tx_{c}") for c in names)], ["doc_id", "features", *(f"_tx_{c}" for c in names)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, features array<int>, " + ", ".join(f"_tx_{c} int" for c in names)
    rows = one.select("doc_id", F.col("t.text").alias("text"), *(f"_tx_{c}" for c in names)).mapInArrow(run, schema).toPandas().sort_values("doc_id")
    y = np.column_stack([rows[f"_tx_{c}"] for c in names])
    folds = np.array([crc32(str(d).encode()) % FOLDS for d in rows["doc_id"]])
    return fit(list(rows["features"]), y.reshape(len(rows), len(names)), folds, names)


def predict(docs: DataFrame, chain: Chain, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns in carry (doc_id, if not given) with p_<category> for each category.

    Null and wordless texts have no features; their probabilities are the models' bases. Every
    row gets its own row, repeated ones too; an empty table gives an empty one. Texts are read whole.
    """
    carry = carry or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        features = Features(model.features)
        for b in slices(batches):
            rows, columns = _flat([features(s) for s in texts(b.column("_tx_text"))])
            p = model.predict(rows, columns, b.num_rows)
            rest = [c for c in b.schema.names if c != "_tx_text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *(pa.array(np.ascontiguousarray(p[:, i])) for i in range(p.shape[1]))], [*rest, *(f"p_{c}" for c in chain.categories)])

    shape = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry] + [f"p_{c} double" for c in chain.categories])
    return docs.select(*carry, F.col(text).alias("_tx_text")).mapInArrow(run, shape)


def clean(docs: DataFrame, chain: Chain, threshold: float = REJECT, text: str = "text") -> DataFrame:
    """The rows of docs whose overall probability is under the threshold, with all their columns;
    one that meets the threshold goes. Null and wordless texts are taken as in predict()."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        features = Features(model.features)
        for b in slices(batches):
            rows, columns = _flat([features(s) for s in texts(b.column(text))])
            yield b.filter(pa.array(model.predict(rows, columns, b.num_rows)[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)
