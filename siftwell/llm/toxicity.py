"""Toxicity by a counterfactually regularised logistic classifier over the words of a text.

Features are the presence of hashed words; those that part the classes best are kept, and
every word of an identity term. In each labelled text that names a group, each term found (of one word or
two) is swapped for each other of its kind, and the squared change of the score (its logit)
between the text and its swapped versions is added to the loss, averaged over a text's versions and over all texts with any: naming a
group can't by itself make a text toxic. Fitted on at most `most` labelled ids of
each class, taken in the order of a hash of their ids; every text is then scored whole.

Rows of one labelled id train once, with the text of the least hash. Words are counted and the
features chosen by a distributed aggregate; what comes to the driver is a row for each training
text, with feature numbers only, so it is bounded by `most` and `features`, not by the texts' length.

Null and empty texts get the score of the intercept. Each input row gives one row, repeated
rows and null ids too. Labels that differ for one id count as toxic. Without labels of both
classes, or a word that tells them apart, every score is the share of toxic labels, 0 without labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import _text as T
from siftwell.llm._spark import saved

#: Labelled ids of each class to fit on at most.
MOST = 4000
FEATURES = 2048
#: Standard errors that a word's shares in the two classes must differ by to be a feature; chosen on folds of the training rows.
TELLING = 3

#: Identity terms by kind; a term is swapped for the others of its kind.
IDENTITY = {
    "gender": ["women", "men", "girls", "boys", "woman", "man", "trans", "transgender", "female", "male", "trans women", "trans men"],
    "religion": ["muslim", "muslims", "jewish", "jews", "christian", "christians", "hindu", "hindus", "buddhist", "buddhists", "atheist", "atheists"],
    "origin": ["african", "asian", "european", "american", "mexican", "arab", "immigrant", "immigrants", "refugee", "refugees", "black", "white", "latino", "african american", "asian american", "native american"],
    "orientation": ["gay", "lesbian", "straight", "bisexual", "queer", "homosexual", "heterosexual"],
    "ability": ["deaf", "blind", "disabled", "autistic"],
    "age": ["old", "young", "elderly", "teenagers"],
}


class Model:
    """Sorted feature hashes, a weight for each, and the intercept."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        w = T.words(data, offsets, T.ALNUM_WORD)
        at, there = T.find(self.features, T.word_hashes(w))
        pairs = np.unique(w.row[there] * (len(self.features) + 1) + at[there])
        logit = np.bincount(pairs // (len(self.features) + 1), self.weights[pairs % (len(self.features) + 1)], minlength=w.rows) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _kinds() -> list[list[np.ndarray]]:
    return [[np.array([T.hash_word(w) for w in term.split()], np.uint64) for term in terms] for terms in IDENTITY.values()]


def swaps(h: np.ndarray, kinds: list[list[np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words that go, words that come) of each version of a text, given as its word hashes in order, with one of its terms swapped for another of its kind."""
    for terms in kinds:
        for term in terms:
            at = np.flatnonzero(np.logical_and.reduce([h[i : len(h) - len(term) + 1 + i] == w for i, w in enumerate(term)])) if len(h) >= len(term) else np.zeros(0, int)
            if not len(at):
                continue
            out = np.zeros(len(h), bool)
            for i in range(len(term)):
                out[at + i] = True
            left = np.unique(h[~out])
            gone = term[~np.isin(term, left)]
            for other in terms:
                if other is not term:
                    yield gone[~np.isin(gone, other)], np.unique(other[~np.isin(other, left) & ~np.isin(other, gone)])


class Changes:
    """Versions of texts as the features they change: entries (version, feature, sign), and the weight of each version."""

    def __init__(self, version: np.ndarray, feature: np.ndarray, sign: np.ndarray, weight: np.ndarray):
        self.version, self.feature, self.sign, self.weight = version, feature, sign, weight

    def of(self, weights: np.ndarray) -> np.ndarray:
        """The change of the logit in each version."""
        return np.bincount(self.version, self.sign * weights[self.feature], minlength=len(self.weight))

    def gradient(self, weights: np.ndarray) -> np.ndarray:
        """Of the weighted sum of squared changes."""
        return np.bincount(self.feature, (2 * self.weight * self.of(weights))[self.version] * self.sign, minlength=len(weights))


def train(x: np.ndarray, labels: np.ndarray, changes: Changes, swap_weight: float = 1.0, ridge: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """(weights, bias) from the presence x [texts, features] and the versions of the texts. Both classes must be there."""
    n = np.bincount(labels.astype(int), minlength=2)
    balance = np.where(labels == 1, n.sum() / 2 / n[1], n.sum() / 2 / n[0])
    weights, bias = np.zeros(x.shape[1]), 0.0
    step_w, step_b = np.zeros(x.shape[1]), 0.0
    seen_w, seen_b = np.full(x.shape[1], 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights.astype(np.float32) + bias, -50, 50)))
        g = (balance * (p - labels)) / len(labels)
        grad, grad_b = x.T @ g.astype(np.float32) + ridge * weights + swap_weight * changes.gradient(weights), g.sum()
        # Adam
        step_w, step_b = 0.9 * step_w + 0.1 * grad, 0.9 * step_b + 0.1 * grad_b
        seen_w, seen_b = 0.99 * seen_w + 0.01 * grad**2, 0.99 * seen_b + 0.01 * grad_b**2
        weights -= 0.05 * step_w / np.sqrt(seen_w)
        bias -= 0.05 * step_b / np.sqrt(seen_b)
    return weights, float(bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, features: int = FEATURES, **more) -> Model:
    """A model from docs and labels(doc_id, toxic), at most `most` ids of each class."""
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = labels.where("toxic = 1").orderBy(*order).limit(most).unionAll(labels.where("toxic <> 1").orderBy(*order).limit(most))
    few = few.select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(few), "doc_id")
    one = saved(labelled.groupBy("doc_id").agg(F.any_value("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("toxic", "text"))
    size = {r.toxic: r.n for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        logit = {(): -500.0, (False,): -500.0, (True,): 500.0}[tuple(size)]
        return Model(np.zeros(0, np.uint64), np.zeros(0), logit)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
            for low, data, offsets in T.slices(batch.column(1)):
                w = T.words(data, offsets, T.ALNUM_WORD)
                h, row = T.word_hashes(w), w.row
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, is_toxic = h[fresh], toxic[low + row[fresh]]
                keys, at = np.unique(h, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(keys)), pa.array(np.bincount(at, ~is_toxic, len(keys)).astype(np.int64)), pa.array(np.bincount(at, is_toxic, len(keys)).astype(np.int64))], names=["h", "clean", "toxic"])

    df = one.mapInArrow(words, "h long, clean long, toxic long").groupBy("h").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    clean, toxic, n = size[False], size[True], size[False] + size[True]
    pooled = (F.col("clean") + F.col("toxic")) / n
    z = F.abs(F.col("toxic") / toxic - F.col("clean") / clean) / F.sqrt(pooled * (1 - pooled) * (1 / clean + 1 / toxic) + 1e-12)
    best = df.where(F.col("clean") + F.col("toxic") >= min(4, clean, toxic)).withColumn("z", z).where(f"z > {TELLING}").orderBy(F.desc("z"), "h").limit(features)
    telling = np.array([r.h for r in best.select("h").collect()], np.int64).view(np.uint64)
    if not len(telling):
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(toxic / clean)))
    kinds = _kinds()
    keep = np.unique(np.concatenate([telling, *[t for terms in kinds for t in terms]]))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there, changed = [], []
            for _, data, offsets in T.slices(batch.column(1)):
                w = T.words(data, offsets, T.ALNUM_WORD)
                h, ends = T.word_hashes(w), np.searchsorted(w.row, np.arange(w.rows), "right")
                for own in np.split(h, ends[:-1]):
                    at, known = T.find(keep, own)
                    there.append(np.unique(at[known]).astype(np.int32))
                    entries = []
                    for v, (gone, come) in enumerate(swaps(own, kinds)):
                        entries += [(v, f, -1) for f in np.searchsorted(keep, gone)] + [(v, f, 1) for f in np.searchsorted(keep, come)]
                    changed.append(np.array(entries, np.int32).reshape(-1, 3).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(there, pa.list_(pa.int32())), pa.array(changed, pa.list_(pa.int32()))], names=["toxic", "there", "changed"])

    found = sorted((r.toxic, r.there, r.changed) for r in one.mapInArrow(bags, "toxic boolean, there array<int>, changed array<int>").collect())
    x = np.zeros((len(found), len(keep)), np.float32)
    parts, weight, versions = [], [], 0
    for i, (_, there, changed) in enumerate(found):
        x[i, there] = 1
        entries = np.array(changed, np.int64).reshape(-1, 3)
        if len(entries):
            count = entries[:, 0].max() + 1
            parts.append(entries + [versions, 0, 0])
            weight.append(np.full(count, 1 / count))
            versions += count
    entries = np.concatenate([*parts, np.zeros((0, 3), np.int64)])
    changes = Changes(*entries.T, np.concatenate([*weight, np.zeros(0)]) / max(1, len(parts)))
    return Model(keep, *train(x, np.array([float(t) for t, _, _ in found]), changes, **more))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs; with `keep`, the rows of docs whose prediction is 0 instead, with those columns."""

    def scores(column: pa.Array) -> np.ndarray:
        parts = [model.scores(data, offsets) for _, data, offsets in T.slices(column)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(keep.index(text_col))) < 0.5))

    if keep is not None:
        # by number, as names may hold dots
        kept = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
        return kept.mapInArrow(clean, kept.schema).toDF(*keep)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
