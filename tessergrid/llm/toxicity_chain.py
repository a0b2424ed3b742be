"""Toxicity by a classifier chain over words.

The categories are label columns in a fixed order. The linear model of each sees
which words a document holds and the probabilities that the models before it give;
those probabilities are out-of-fold during training, so that a later model learns
from what earlier ones say about documents they have not seen. All documents are
scored in one pass, without a shuffle. With one toxicity label, as in the tables
here, the chain has one toxicity link, after that of ``quality``; any list of label
columns makes a longer one.

The models are fitted on a bounded sample: about ``PER_CLASS`` labelled documents
for each combination of labels, weighted back to their numbers in the table.

Defined cases: texts without words (null, empty, punctuation) get probability 0 for
every category; a category whose labels are all equal, or missing, gets 0 or 1 as
they are (0 without labels); rows of labels with a null id or a null label never
train; repeated label rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import Words, append_columns, slices, string_bytes

BUCKETS = 1 << 20
PER_CLASS = 4000
FOLDS = 4
#: A word is a feature of a category if its rate differs by so many standard errors between the two classes; all such words are.
LEAST_Z = 4.0
RIDGE = 0.1
#: Training ends when the gradient has fallen to this part of the first.
SMALL = 1e-6


def word_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, word bucket) of a column of texts."""
    raw, offsets = string_bytes(column)
    rows, buckets = [], []
    for a, b in slices(offsets):
        w = Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        key = np.unique((w.row + a).astype(np.int64) * BUCKETS + (w.hash >> np.uint64(44)).astype(np.int64))
        rows.append(key // BUCKETS)
        buckets.append(key % BUCKETS)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(buckets)


@dataclass
class Link:
    """One model of the chain: features, their weights, weights of the earlier probabilities, intercept."""

    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    intercept: float

    def probabilities(self, rows: np.ndarray, buckets: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.features, buckets), max(len(self.features) - 1, 0))
        hit = self.features[at] == buckets if len(self.features) else np.zeros(len(buckets), bool)
        return _probability(self.intercept + np.bincount(rows[hit], self.weights[at[hit]], n) + before @ self.earlier)


def _probability(x: np.ndarray) -> np.ndarray:
    """The logistic function, 0 and 1 from log-odds of 30 on."""
    return np.where(x <= -30, 0.0, np.where(x >= 30, 1.0, 1 / (1 + np.exp(-np.clip(x, -30, 30)))))


def _conjugate_gradient(product: Callable[[np.ndarray], np.ndarray], target: np.ndarray, diagonal: np.ndarray, close: float) -> np.ndarray:
    """The solution of a positive definite system, given by its products and its diagonal, up to a part ``close`` of the target."""
    x = np.zeros(len(target))
    left = target.copy()
    z = left / diagonal
    way, size = z.copy(), left @ z
    enough = close * np.abs(target).max()
    for _ in range(10 * len(target)):
        if np.abs(left).max() <= enough:
            break
        along = product(way)
        step = size / (way @ along)
        x += step * way
        left -= step * along
        z = left / diagonal
        size, before = left @ z, size
        way = z + way * (size / before)
    return x


def fit_link(rows: np.ndarray, buckets: np.ndarray, y: np.ndarray, weight: np.ndarray, before: np.ndarray) -> Link:
    """Ridge logistic regression on words and the probabilities before, by Newton's method over sparse rows.

    Features are chosen and weighted on the sample as it is; the intercept is then moved to the table's rates.
    """
    if not len(y) or y.min() == y.max():
        return Link(np.zeros(0, np.int64), np.zeros(0), np.zeros(before.shape[1]), 30.0 if len(y) and y[0] else -30.0)
    n, n1 = len(y), y.sum()
    ones = np.bincount(buckets, y[rows], BUCKETS)
    every = np.bincount(buckets, minlength=BUCKETS)
    rate = every / n
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n1 + 1 / (n - n1)))
    z = np.where(every >= 3, np.abs(ones / n1 - (every - ones) / (n - n1)) / spread, 0)
    features = np.flatnonzero(z >= LEAST_Z)
    place = np.full(BUCKETS, -1)
    place[features] = np.arange(len(features))
    hit = place[buckets] >= 0
    row, column = rows[hit], place[buckets[hit]]
    dense = np.column_stack([before, np.ones(n)])
    d = len(features)
    penalty = np.full(d + dense.shape[1], RIDGE)
    penalty[-1] = 1e-6
    forth = lambda b: np.bincount(row, b[:d][column], n) + dense @ b[d:]
    back = lambda r: np.concatenate([np.bincount(column, r[row], d), dense.T @ r])
    beta = np.zeros(d + dense.shape[1])
    first = None
    for _ in range(60):
        p = _probability(forth(beta))
        gradient = back(y - p) - penalty * beta
        steep = np.abs(gradient).max()
        first = steep if first is None else first
        if steep <= SMALL * first:
            break
        v = np.maximum(p * (1 - p), 1e-6)
        diagonal = np.concatenate([np.bincount(column, v[row], d), (dense**2).T @ v]) + penalty
        # a step is solved as closely as it is worth: roughly at first, closely near the end
        beta += _conjugate_gradient(lambda b, v=v: back(v * forth(b)) + penalty * b, gradient, diagonal, min(0.1, (steep / first) ** 0.5))
    odds = (weight[y == 1].sum() / n1) / (weight[y == 0].sum() / (n - n1))
    return Link(features, beta[:d], beta[d:-1], float(beta[-1] + np.log(odds)))


def fit_chain(rows: np.ndarray, buckets: np.ndarray, labels: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> list[Link]:
    """One link per column of ``labels``; the earlier probabilities it learns from are out-of-fold."""
    n = len(labels)
    before = np.zeros((n, 0))
    chain = []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(np.float64)
        out = np.zeros(n)
        for f in np.unique(fold).tolist():
            kept = fold != f
            number = np.cumsum(kept) - 1
            own = kept[rows]
            link = fit_link(number[rows[own]], buckets[own], y[kept], weight[kept], before[kept])
            out[~kept] = link.probabilities(rows, buckets, n, before)[~kept]
        chain.append(fit_link(rows, buckets, y, weight, before))
        before = np.column_stack([before, out])
    return chain


def score_texts(column: pa.Array, chain: list[Link]) -> np.ndarray:
    """Probabilities (texts x categories)."""
    n = len(column)
    rows, buckets = word_buckets(column)
    out = np.zeros((n, 0))
    for link in chain:
        out = np.column_stack([out, link.probabilities(rows, buckets, n, out)])
    out[np.bincount(rows, minlength=n) == 0] = 0
    return out


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], *, doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> list[Link]:
    usable = F.col(doc_id).isNotNull()
    for c in categories:
        usable &= F.col(c).isNotNull()
    marked = labels.where(usable).select(F.col(doc_id).alias("id"), *[(F.col(c) > 0).cast("int").alias(c) for c in categories])
    counts = {tuple(r[: len(categories)]): r["n"] for r in marked.groupBy(*categories).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [Link(np.zeros(0, np.int64), np.zeros(0), np.zeros(k), -30.0) for k in range(len(categories))]
    share = F.lit(0.0)
    for combo, n in counts.items():
        same = F.lit(True)
        for c, v in zip(categories, combo, strict=True):
            same &= F.col(c) == v
        share = F.when(same, F.lit(min(1.0, per_class / n))).otherwise(share)
    sample = marked.withColumn("share", share).where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    # the sample is bounded (2^categories x per_class rows), so no text is shuffled for it
    joined = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body")).join(F.broadcast(sample), "id")

    def features(column: pa.Array) -> list[pa.Array]:
        rows, buckets = word_buckets(column)
        at = np.searchsorted(rows, np.arange(len(column) + 1)).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(at), pa.array(buckets.astype(np.int32)))]

    got = append_columns(joined, "body", features, "words array<int>").drop("body").toArrow()
    words = got.column("words").combine_chunks()
    sizes = words.value_lengths().to_numpy()
    rows, buckets = np.repeat(np.arange(len(words)), sizes), words.flatten().to_numpy().astype(np.int64)
    y = np.column_stack([got.column(c).to_numpy() for c in categories])
    ids = got.column("id").to_numpy().astype(np.int64).view(np.uint64)
    fold = ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % FOLDS
    return fit_chain(rows, buckets, y, 1 / got.column("share").to_numpy(), fold)


def score(docs: DataFrame, chain: list[Link], categories: tuple[str, ...], *, text: str = "text") -> DataFrame:
    """``docs`` plus a column <category>_prob for each link of the chain."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    return append_columns(docs, text, lambda c: [pa.array(p) for p in score_texts(c, shared.value).T], ", ".join(f"{c}_prob double" for c in categories))


def toxicity_report(docs: DataFrame, labels: DataFrame, *, categories: tuple[str, ...] = ("quality", "toxic"), train_on: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, a probability per category, and whether the last category, toxic, is at 0.5 or more."""
    unseen = F.lit(False) if train_on is None else ~train_on
    chain = train(docs, labels if train_on is None else labels.where(train_on), categories, doc_id=doc_id, text=text)
    scored = score(docs.select(doc_id, text), chain, categories, text=text).drop(text)
    return scored.select(doc_id, F.coalesce(unseen, F.lit(False)).alias("held_out"), *[f"{c}_prob" for c in categories], (F.col(f"{categories[-1]}_prob") >= 0.5).alias(categories[-1]))


__all__ = ["fit_chain", "fit_link", "score", "score_texts", "toxicity_report", "train"]
