"""Quality by weak supervision: rules vote or abstain, their accuracies are estimated.

A rule scores a property of a document, higher is worse. It votes bad above the corpus's quantile
``BAD``, good up to the quantile ``GOOD``, and abstains between them and where it has nothing to
judge; neither bound lies below what the rule takes as harmless anyway, so a clean corpus gets no
bad votes for being uneven. Quantiles are exact over scores in thousandths.

The rules judge what the base checks let through. Two accuracies per rule, how often it is right on
good and on bad documents, and the share of good documents are estimated from those votes alone, by
expectation-maximisation over the number of documents of each combination of votes: all such
documents count, and what the driver gets is one row per combination that occurs (at most three to
the number of rules) and one per score (at most ``TOP`` a rule). A document is kept if its posterior
probability of being good reaches the threshold and the base checks passed.

One accuracy for both classes would not do: most rules find nothing wrong with most bad documents,
so a rule's "good" must weigh little where its "bad" may weigh much. No character counts for two
rules, as votes are taken as independent within a class. Starting from rules that are right more
often than not, the maximisation keeps that reading of "good": a vote never speaks for the class
that it names less often, and then weighs nothing. Where more than a tenth of what the base lets
through is bad in one way, that rule names the worst tenth and abstains on the next.

Defined cases: a missing text has no words and fails the base checks; rules abstain where they have
nothing to judge; very long texts are read whole; repeated rows vote each; an empty table gives an
empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import functools
import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleflow.llm.common import map_batches, staged

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
ROUNDS = 200
#: Votes are good up to the first of these quantiles of a score and bad above the second.
GOOD, BAD = 0.75, 0.9
#: Scores in thousandths end here.
TOP = 10_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (the SplitMix64 finaliser)."""
    x = (x + np.uint64(1)) * MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(ids: np.ndarray, text: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Marks of the words that lie in a window of ``window`` words found twice or more in its text.

    ``ids`` numbers equal words alike; ``text`` numbers the texts, which lie one after another.
    Windows meet by a 64-bit hash, and those that meet are compared word by word.
    """
    n = len(ids) - window + 1
    marked = np.zeros(len(ids), bool)
    if n < 1:
        return marked
    words = scramble(ids.astype(np.uint64))
    hashes = scramble(text[:n].astype(np.uint64))
    for k in range(window):
        hashes = hashes * MIX + words[k:k + n]
    inside = np.flatnonzero(text[:n] == text[window - 1:])
    order = inside[np.argsort(hashes[inside], kind="stable")]
    same = hashes[order][1:] == hashes[order][:-1]
    for k in range(window):
        same &= ids[order[1:] + k] == ids[order[:-1] + k]
    same &= text[order[1:]] == text[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = order[twice]
    for k in range(window):
        marked[starts + k] = True
    return marked


@functools.cache
def character_classes() -> np.ndarray:
    """By code point: 0 other, 1 letter, 2 capital letter."""
    return np.fromiter((c.isalpha() + (c.isalpha() and c.isupper()) for c in
                        map(chr, range(sys.maxunicode + 1))), np.uint8, sys.maxunicode + 1)


METRICS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
           "n_repeat_words long, n_lines long, n_letters long, n_upper long, n_ends long, "
           "n_kinds long")


def measure(docs: DataFrame) -> DataFrame:
    """Counts over every whole text."""

    def run(batch: pa.RecordBatch) -> dict:
        ids: dict[bytes, int] = {}
        out: dict[str, list] = {name: [] for name in names}
        numbers, lengths = [], []
        for value in batch.column(1).to_pylist():
            value = value or ""
            data = value.encode()
            words = data.split()
            number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
            numbers.append(number)
            lengths.append(len(words))
            lines = [line for line in data.split(b"\n") if line.strip(SPACES)]
            points = np.frombuffer(value.encode("utf-32-le"), "<u4")
            _, small, upper = np.bincount(character_classes()[points], minlength=3).tolist()
            row = {
                "n_words": len(words),
                "word_chars": len(value) - sum(data.count(c) for c in SPACES),
                "n_symbols": sum(data.count(c) for c in SYMBOLS),
                "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines),
                "n_letters": small + upper, "n_upper": upper,
                "n_ends": sum(line.rstrip(SPACES)[-1:] in b".!?\"" for line in lines),
                "n_kinds": len(set(words)),
            }
            for name, v in row.items():
                out[name].append(v)
        text = np.repeat(np.arange(len(lengths)), lengths)
        every = np.concatenate([np.array([], np.int64), *numbers])
        out["n_repeat_words"] = np.bincount(
            text, repeated_words(every, text), len(lengths)).astype(np.int64)
        return out | {"doc_id": batch.column(0)}

    names = [n for n in (c.split()[0] for c in METRICS.split(", "))
             if n not in ("doc_id", "n_repeat_words")]
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, METRICS)


BASE = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def thousandths(part: Column, whole: Column) -> Column:
    """A share as a whole number up to ``TOP``; null where nothing is there to share."""
    return F.least(F.floor(F.try_divide(1000 * part, whole)), F.lit(TOP)).cast("int")


def word_length() -> Column:
    return thousandths(F.col("word_chars"), F.col("n_words"))


def scores(usual: int) -> dict[str, tuple[Column, int]]:
    """Score of each rule and the score up to which it is harmless; ``usual`` is the corpus's median
    word length."""
    words, lines = F.col("n_words"), F.col("n_lines")
    other = F.col("word_chars") - F.col("n_letters") - F.col("n_symbols")
    return {
        "symbols": (thousandths(F.col("n_symbols"), words), 20),
        "word_length": (F.abs(word_length() - usual), 750),
        "copied_lines": (F.when(lines > 1, thousandths(F.col("n_dup_lines"), lines)), 100),
        "repeats": (thousandths(F.col("n_repeat_words"), words), 50),
        "letters": (thousandths(other, F.col("word_chars")), 50),
        "capitals": (thousandths(F.col("n_upper"), F.col("n_letters")), 100),
        "line_ends": (F.when(lines > 2, thousandths(lines - F.col("n_ends"), lines)), 50),
        "variety": (F.when(words >= 50, thousandths(words - F.col("n_kinds"), words)), 500),
    }


def quantiles(table: DataFrame, columns: dict[str, Column], shares: tuple[float, ...]
              ) -> dict[str, list[int | None]]:
    """The least values that reach these shares of a column's counted values, or None without any."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("int").alias("value"))
                               for n, c in columns.items()])).alias("one")
    counted = table.select(each).where("one.value IS NOT NULL").groupBy(
        "one.name", "one.value").agg(F.count("*").alias("n")).orderBy("name", "value").collect()
    found: dict[str, list[int | None]] = {}
    for name in columns:
        values = np.array([r["value"] for r in counted if r["name"] == name], int)
        upto = np.cumsum([r["n"] for r in counted if r["name"] == name])
        found[name] = [int(values[np.searchsorted(upto, share * upto[-1])]) if len(values) else None
                       for share in shares]
    return found


def rules(passed: DataFrame) -> dict[str, Column]:
    """The vote of each rule, 1 good, -1 bad or 0, with bounds from ``passed``."""
    usual = quantiles(passed, {"word_length": word_length()}, (0.5,))["word_length"][0]
    scored = scores(usual or 0)
    bounds = quantiles(passed, {n: c for n, (c, _) in scored.items()}, (GOOD, BAD))
    return {name: F.when(score > max(harmless, bounds[name][1] or 0), -1)
            .when(score <= max(harmless, bounds[name][0] or 0), 1).otherwise(0)
            for name, (score, harmless) in scored.items()}


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS
             ) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each combination, accuracies of each rule (on good, on bad), share of
    good.

    A rule that votes is right with the accuracy of the class, and abstains regardless of it.
    """
    good, bad, prior = np.full(votes.shape[1], 0.8), np.full(votes.shape[1], 0.8), 0.8
    posterior = np.zeros(len(votes))
    up, down = (votes > 0).astype(float), (votes < 0).astype(float)
    for _ in range(rounds):
        odds = (up @ np.log(good / (1 - bad)) + down @ np.log((1 - good) / bad)
                + math.log(prior / (1 - prior)))
        new = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        ups = np.stack([(new * counts) @ up, ((1 - new) * counts) @ up])
        downs = np.stack([(new * counts) @ down, ((1 - new) * counts) @ down])
        # one imagined right and one imagined wrong vote keep accuracies off 0 and 1
        share = (ups + 1) / (ups + downs + 2)
        pooled = (ups.sum(0) + 1) / (ups.sum(0) + downs.sum(0) + 2)
        turned = share[0] < share[1]
        good = np.clip(np.where(turned, pooled, share[0]), 1e-6, 1 - 1e-6)
        bad = np.clip(np.where(turned, 1 - pooled, 1 - share[1]), 1e-6, 1 - 1e-6)
        prior = float(np.clip(((new * counts).sum() + 1) / (counts.sum() + 2), 0.01, 0.99))
        if np.abs(new - posterior).max(initial=0) < 1e-12:
            break
        posterior = new
    return posterior, np.stack([good, bad], axis=1), prior


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts, votes, posterior and verdict of every document."""
    spark = docs.sparkSession
    measured = staged(measure(docs), "quality-metrics").withColumn("base_failed", F.expr(BASE))
    named = rules(measured.where("NOT base_failed"))
    measured = measured.withColumn("votes", F.array(*[c.cast("int") for c in named.values()]))
    combined = measured.groupBy("votes").agg(
        F.count_if(~F.col("base_failed")).alias("n")).orderBy("votes").collect()
    votes = np.array([r["votes"] for r in combined], int).reshape(-1, len(named))
    posterior, _, _ = estimate(votes, np.array([r["n"] for r in combined], float))
    table = spark.createDataFrame(
        [(v.tolist(), float(p)) for v, p in zip(votes, posterior)],
        "votes array<int>, posterior double")
    return measured.join(F.broadcast(table), "votes", "left").withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
