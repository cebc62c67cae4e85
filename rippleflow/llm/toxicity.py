"""Toxicity by a chain of linear classifiers.

Categories come in a fixed order. The classifier of a category sees the words of a text and the
probabilities of the earlier categories. While training, those are out-of-fold predictions: each
labelled row is predicted by a model that was fitted without its fold, so a later classifier sees
earlier ones as uncertain as they are on new texts. Features are lower-case words and word starts
of four and five letters, each once per text; those that tell a category apart (chi-square) are
kept.

Bounds: the chain is fitted on about ``SAMPLE`` labelled rows, chosen by a hash of the id, and
``FEATURES`` features per category; the driver gets the feature numbers of these rows. Every
document is scored, whole.

Defined cases: a missing or empty text has no features and scores by the classifiers' constants;
a category without both outcomes in the labels has its share as a constant; rows without label do
not train; a label that is missing in one category counts as 0 there; repeated rows score alike;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleflow.llm.common import arrow_schema, hash_sample, map_batches

SAMPLE = 12_000
FEATURES = 1_500
LEAST_TEXTS = 4
#: Weaker links between a feature and a category are as likely chance, among so many features.
LEAST_CHI_SQUARE = 15.0
FOLDS = 3
PENALTY = 1.0
STEPS = 150
WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str | None) -> set[str]:
    words = set(WORD.findall((text or "").lower()))
    starts = {f"{w[:k]}*" for w in words for k in (4, 5) if len(w) > k}
    return words | starts


@dataclass
class Link:
    """One classifier: a constant, weights of features, weights of earlier categories."""

    constant: float
    weights: np.ndarray
    earlier: np.ndarray

    def score(self, rows: np.ndarray, columns: np.ndarray, size: int, before: np.ndarray):
        z = self.constant + np.bincount(rows, self.weights[columns], size) + before @ self.earlier
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[str, int]
    links: list[Link]

    def score(self, rows: np.ndarray, columns: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, 0))
        for link in self.links:
            out = np.column_stack([out, link.score(rows, columns, size, out)])
        return out


def fit(rows: np.ndarray, columns: np.ndarray, size: int, width: int, before: np.ndarray,
        target: np.ndarray) -> Link:
    """Logistic regression with an L2 penalty by accelerated gradient steps."""
    share = (target.sum() + 0.5) / (size + 1)
    constant = float(np.log(share / (1 - share)))
    none = Link(constant, np.zeros(width), np.zeros(before.shape[1]))
    if size == 0 or target.min() == target.max():
        return none
    # features are scaled to equal spread, which steps of one size need
    spread = 1 / np.sqrt(np.maximum(np.bincount(columns, minlength=width), 1) / size)
    scale = np.minimum(spread, 30.0)
    w, b, e = np.zeros(width), constant, np.zeros(before.shape[1])
    mw, mb, me = w.copy(), b, e.copy()
    # the steepest curvature, by power steps on the constant, the features and earlier categories
    rng = np.random.default_rng(0)
    v, steep = (rng.random(1), rng.random(width), rng.random(before.shape[1])), 1.0
    for _ in range(20):
        z = v[0] + np.bincount(rows, (v[1] * scale)[columns], size) + before @ v[2]
        v = (np.array([z.mean()]), np.bincount(columns, z[rows], width) * scale / size,
             before.T @ z / size)
        steep = float(np.sqrt(sum((x * x).sum() for x in v)))
        v = tuple(x / steep for x in v)
    rate, momentum = 3 / steep, 1.0
    for _ in range(STEPS):
        z = mb + np.bincount(rows, (mw * scale)[columns], size) + before @ me
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / size
        nw = mw - rate * (np.bincount(columns, error[rows], width) * scale + PENALTY * mw / size)
        nb = mb - rate * error.sum()
        ne = me - rate * (before.T @ error + PENALTY * me / size)
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        push = (momentum - 1) / following
        mw, mb, me = nw + push * (nw - w), nb + push * (nb - b), ne + push * (ne - e)
        w, b, e, momentum = nw, nb, ne, following
    return Link(float(b), w * scale, e)


def train_chain(rows, columns, size, width, targets, folds) -> list[Link]:
    """Fit the links; later ones get out-of-fold probabilities of earlier ones."""
    links, before = [], np.zeros((size, 0))
    for target in targets:
        links.append(fit(rows, columns, size, width, before, target))
        held = np.zeros(size)
        for fold in np.unique(folds):
            out = folds == fold
            place = np.cumsum(~out) - 1
            inside = ~out[rows]
            model = fit(place[rows[inside]], columns[inside], int((~out).sum()), width,
                        before[~out], target[~out])
            held[out] = model.score(rows, columns, size, before)[out]
        before = np.column_stack([before, held])
    return links


def select_features(sample: DataFrame, categories: list[str], limit: int) -> list[str]:
    """The features that tell some category apart, by chi-square over the sampled rows."""
    kinds = ", ".join(f"c{i} long" for i in range(len(categories)))
    layout = arrow_schema(f"feature string, n long, {kinds}")

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = np.column_stack([np.ones(batch.num_rows, np.int64), *(
                batch.column(3 + i).to_numpy() for i in range(len(categories)))])
            for text, label in zip(batch.column(1).to_pylist(), labels):
                for f in features_of(text):
                    if f in counts:
                        counts[f] += label
                    else:
                        counts[f] = label.copy()
            if len(counts) > 400_000:
                yield out(counts)
                counts = {}
        if counts:
            yield out(counts)

    def out(counts):
        table = np.array(list(counts.values()))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts)), *(pa.array(c) for c in table.T)], schema=layout)

    sums = [F.sum(f"c{i}").alias(f"c{i}") for i in range(len(categories))]
    counted = sample.mapInArrow(run, f"feature string, n long, {kinds}").groupBy("feature").agg(
        F.sum("n").alias("n"), *sums).where(F.col("n") >= LEAST_TEXTS)
    totals = sample.agg(F.count("*").alias("n"), *[
        F.sum(c).alias(f"c{i}") for i, c in enumerate(categories)]).first()
    chosen: set[str] = set()
    for i in range(len(categories)):
        size, positive = totals["n"] or 0, totals[f"c{i}"] or 0
        if not 0 < positive < size:
            continue
        a, n = F.col(f"c{i}"), F.col("n")
        gap = (a * float(size) - n * float(positive))
        score = gap * gap / (n * (float(size) - n + 1) * float(positive * (size - positive)))
        telling = counted.where(score * float(size) >= LEAST_CHI_SQUARE)
        best = telling.orderBy(F.desc(score), "feature").limit(limit).select("feature").collect()
        chosen.update(r["feature"] for r in best)
    return sorted(chosen)


def numbered(batch_texts: list, vocabulary: dict[str, int]) -> list[list[int]]:
    names = vocabulary.keys()
    return [sorted(vocabulary[f] for f in names & features_of(t)) for t in batch_texts]


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE,
          features: int = FEATURES, seed: int = 5) -> Chain:
    """Fit the chain; ``categories`` are boolean expressions over the columns of ``labels``."""
    names = list(categories)
    label = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[
        F.max(F.coalesce(c, F.lit(False)).cast("long")).alias(n) for n, c in categories.items()])
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    chosen = hash_sample(label, sample, seed + 1, "doc_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "text", F.pmod(order, F.lit(FOLDS)).cast("int").alias("fold"), *names)
    rows = rows.persist()
    try:
        vocabulary = {f: i for i, f in enumerate(select_features(rows, names, features))}

        def run(batch: pa.RecordBatch) -> dict:
            found = numbered(batch.column(1).to_pylist(), vocabulary)
            return {"doc_id": batch.column(0), "fold": batch.column(2), "found": found,
                    "labels": list(zip(*(batch.column(3 + i).to_pylist()
                                         for i in range(len(names)))))}

        got = map_batches(rows, run, "doc_id long, fold int, found array<int>, labels array<long>")
        # repeated rows of one id train once
        train_rows = list({r["doc_id"]: r for r in got.toLocalIterator()}.values())
    finally:
        rows.unpersist()
    train_rows.sort(key=lambda r: r["doc_id"])
    size = len(train_rows)
    lengths = [len(r["found"]) for r in train_rows]
    at = np.repeat(np.arange(size), lengths)
    columns = np.array([c for r in train_rows for c in r["found"]], np.int64)
    targets = np.array([r["labels"] for r in train_rows], float).reshape(size, len(names)).T
    folds = np.array([r["fold"] for r in train_rows], int)
    links = train_chain(at, columns, size, len(vocabulary), targets, folds)
    return Chain(names, vocabulary, links)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, one probability per category) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batch: pa.RecordBatch) -> dict:
        chain = shared.value
        found = numbered(batch.column(1).to_pylist(), chain.vocabulary)
        at = np.repeat(np.arange(len(found)), [len(f) for f in found])
        columns = np.array([c for f in found for c in f], np.int64)
        got = chain.score(at, columns, len(found))
        return {"doc_id": batch.column(0)} | dict(zip(chain.categories, got.T))

    kinds = ", ".join(f"`{c}` double" for c in chain.categories)
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run,
                       f"doc_id long, {kinds}")
