"""Language identification, word first with back-off to character n-grams.

Training counts every word of every training row per language, and the n-grams of all counted words.
A known word scores by its log frequency in each language. An unseen word scores
by its n-grams: of four characters if any of them is known, else of three, two, one; word borders
count as characters. The language with the largest sum over all words of the whole text wins, and
the score is its share of probability against the others.

Sizes: every counted word and n-gram is scored, and nothing that grows with the corpus is gathered.
The most frequent words, as many as fit in ``HEAD_BYTES``, are shipped to the executors and add up
to most of a text where it lies. The rarer and unseen words of a text are handed on as (text, word),
meet the count tables in a join, and are added to the text's sum. Texts are told apart by 96 bits
of hashes, words of the shipped part by 64.

Defined cases: a missing text, or one without a letter, is ``und`` with score 0, and so is every
text if there is nothing to learn from; ties go to the language that sorts first; repeated rows
count once each in training and get equal results; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleflow.llm.common import arrow_schema, join_sized, map_batches, staged, steps

UNKNOWN = "und"
#: Size of the shipped part: a hash and one number per language for each word.
HEAD_BYTES = 24_000_000
#: Bins of word counts per octave.
BINS = 8
ORDERS = (4, 3, 2, 1)
SMOOTHING = 0.5
#: Distinct counters that a task holds before it hands them on.
HELD = 80_000
#: Scored tokens that a task remembers.
REMEMBERED = 160_000
WORD = re.compile(r"[^\W\d_]+")


def words_of(token: str) -> list[str]:
    """Lower-case words of a piece of text: runs of letters."""
    lower = token.lower()
    if lower.isalpha():
        return [lower]
    return [w for w in WORD.findall(lower) if any(map(str.isalpha, w))]


def grams_of(word: str, order: int) -> list[str]:
    padded = f"^{word}$" if order > 1 else word
    return [padded[i:i + order] for i in range(len(padded) - order + 1)]


def count_words(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows of (lang, text); counted in the task before the shuffle."""
    layout = arrow_schema("lang string, word string, n long")

    def out(held: dict[str, Counter]) -> pa.RecordBatch:
        words = {lang: Counter() for lang in held}
        for lang, tokens in held.items():
            for token, n in tokens.items():
                for word in words_of(token):
                    words[lang][word] += n
        rows = [(lang, w, n) for lang, c in words.items() for w, n in c.items()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ([], [], []), layout)],
            schema=layout)

    def run(batches):
        held: dict[str, Counter] = {}
        for batch in (part for whole in batches for part in steps(whole)):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, Counter()).update(text.split())
                if len(held[lang]) > HELD:
                    yield out({lang: held.pop(lang)})
            if sum(map(len, held.values())) > HELD:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n"))


def count_grams(words: DataFrame) -> DataFrame:
    """(lang, gram, n) of all lengths from word counts."""
    layout = arrow_schema("lang string, gram string, n long")

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for order in ORDERS:
                    for gram in grams_of(word, order):
                        held[lang, gram] += n
            if len(held) > HELD:
                yield out(held)
                held = Counter()
        if held:
            yield out(held)

    def out(held: Counter) -> pa.RecordBatch:
        langs, grams = zip(*held)
        return pa.RecordBatch.from_arrays(
            [pa.array(langs), pa.array(grams), pa.array(list(held.values()), pa.int64())],
            schema=layout)

    return words.select("lang", "word", "n").mapInArrow(
        run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def by_language(counts: DataFrame, unit: str, languages: list[str]) -> DataFrame:
    """(unit, n0, n1, ...): a row for each counted unit."""
    return counts.groupBy(unit).agg(*[
        F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}")
        for i, lang in enumerate(languages)])


def unit_key(unit: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(unit.encode())


class Packed:
    """Scores by unit, as sorted hashes and a matrix."""

    def __init__(self, keys: np.ndarray, scores: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.scores = keys[order], scores[order]

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Whether each unit is known, and its row."""
        wanted = np.fromiter(map(unit_key, units), np.uint64, len(units))
        at = np.minimum(self.keys.searchsorted(wanted), max(len(self.keys) - 1, 0))
        return self.keys[at] == wanted if len(self.keys) else np.zeros(len(units), bool), at


def gathered(wide: DataFrame, floors: list[float]) -> Packed:
    """The rows of (word, n0, n1, ...) with their scores."""
    layout = arrow_schema("part binary")

    def run(batches):
        for batch in batches:
            rows = np.empty((batch.num_rows, batch.num_columns), np.uint64)
            rows[:, 0] = list(map(unit_key, batch.column(0).to_pylist()))
            for c in range(1, batch.num_columns):
                rows[:, c] = batch.column(c).to_numpy().astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()])], schema=layout)

    parts = [np.frombuffer(r["part"], np.uint64).reshape(-1, len(floors) + 1)
             for r in wide.mapInArrow(run, "part binary").collect()]
    rows = np.concatenate([np.empty((0, len(floors) + 1), np.uint64), *parts])
    return Packed(rows[:, 0].copy(), np.log(rows[:, 1:] + SMOOTHING) - np.array(floors))


def most_frequent(wide: DataFrame, languages: list[str], units: int) -> DataFrame:
    """Rows of (word, n0, ...) of the largest counts, at most ``units`` of them, by whole bins."""
    total = sum((F.col(f"n{i}") for i in range(len(languages))), F.lit(0))
    bin_of = F.floor(F.log2(total) * BINS)
    left, least = units, None
    for r in sorted(wide.groupBy(bin_of.alias("b")).count().collect(), reverse=True):
        if r["count"] > left:
            break
        left, least = left - r["count"], r["b"]
    return wide.where("false") if least is None else wide.where(bin_of >= least)


@dataclass
class Model:
    """Scores of the most frequent words, the count tables (word, n0, ...) and (gram, n0, ...), and
    what the scores take off the logarithms, by n-gram length (0: words)."""

    languages: list[str]
    head: Packed
    words: DataFrame | None = None
    grams: DataFrame | None = None
    floors: dict[int, list[float]] | None = None


def train(labelled: DataFrame, head_bytes: int = HEAD_BYTES) -> Model:
    """Learn from the columns ``lang`` and ``text`` of all rows."""
    counts = staged(count_words(labelled), "word-counts")
    totals = {(r["lang"], 0): r["n"] for r in
              counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(lang for lang, _ in totals)
    if not languages:
        return Model([], Packed(np.empty(0, np.uint64), np.empty((0, 0))))
    gram_counts = staged(count_grams(counts), "gram-counts")
    totals |= {(r["lang"], r["k"]): r["n"] for r in gram_counts.groupBy(
        "lang", F.length("gram").alias("k")).agg(F.sum("n").alias("n")).collect()}
    words = staged(by_language(counts, "word", languages), "words")
    grams = staged(by_language(gram_counts, "gram", languages), "grams")
    kinds = {r["k"]: r["n"] for r in grams.groupBy(F.length("gram").alias("k")).agg(
        F.count("*").alias("n")).collect()} | {0: words.count()}
    floors = {k: [math.log(totals.get((lang, k), 1) + SMOOTHING * kinds.get(k, 0)) for lang in languages]
              for k in (0, *ORDERS)}
    units = head_bytes // (8 * (len(languages) + 1))
    return Model(languages, gathered(most_frequent(words, languages, units), floors[0]),
                 words, grams, floors)


class TokenScores(dict):
    """Rows of a score table by token, filled as tokens come: a score per language, the number of
    words, and the number of words left to the joins."""

    def __init__(self, languages: int, head: Packed):
        super().__init__()
        self.languages, self.head = languages, head
        self.table = np.zeros((1024, languages + 2))
        self.rare: dict[int, list[str]] = {}

    def prepare(self, texts: list[str | None]) -> None:
        """Look up the new tokens of several texts at once."""
        if len(self) > REMEMBERED:
            self.clear()
            self.rare.clear()
        new = [t for t in {t for text in texts for t in (text or "").split()} if t not in self]
        split = [words_of(t) for t in new]
        known, at = self.head.find([w for words in split for w in words])
        first, place = len(self), 0
        while len(self.table) < first + len(new):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[first:first + len(new)] = 0
        singles, rows = [], []
        for row, words in enumerate(split, first):
            if len(words) == 1 and known[place]:
                singles.append(row)
                rows.append(at[place])
            else:
                for k, word in enumerate(words, place):
                    if known[k]:
                        self.table[row, :-2] += self.head.scores[at[k]]
                    else:
                        self.rare.setdefault(row, []).append(word)
                self.table[row, -2:] = len(words), len(self.rare.get(row, ()))
            place += len(words)
        if singles:
            self.table[singles, :-2] = self.head.scores[rows]
            self.table[singles, -2] = 1
        self.update(zip(new, range(first, first + len(new))))

    def text(self, text: str | None) -> tuple[np.ndarray, list[str]]:
        """The sums over a text's tokens, and its rare words, as often as they stand there."""
        tokens = (text or "").split()
        rows = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        picked = self.table[rows]
        rare = [self.rare[row] for row in rows[picked[:, -1] > 0].tolist()]
        return picked.sum(axis=0), list(chain.from_iterable(rare))


_SCORES: dict[int, TokenScores] = {}


def scores_of(shared, languages: int) -> TokenScores:
    """One table per process and model, so that it serves all tasks that run there."""
    if shared.value is not getattr(_SCORES.get(0), "head", None):
        _SCORES[0] = TokenScores(languages, shared.value)
    return _SCORES[0]


KEYS = ("__k1", "__k2")


def text_keys() -> list[Column]:
    return [F.xxhash64("text").alias(KEYS[0]), F.hash("text").alias(KEYS[1])]


def first_sums(docs: DataFrame, model: Model) -> DataFrame:
    """(keys, n, s0, ..., rare): what the shipped words add up to, and the other words with counts."""
    numbers = range(len(model.languages))
    shared = docs.sparkSession.sparkContext.broadcast(model.head)
    languages = len(model.languages)
    schema = f"{KEYS[0]} long, {KEYS[1]} int, n long, " + "".join(
        f"s{i} double, " for i in numbers) + "rare array<string>"

    def run(batch: pa.RecordBatch) -> dict:
        state = scores_of(shared, languages)
        texts = batch.column(2).to_pylist()
        state.prepare(texts)
        got = [state.text(t) for t in texts]
        return {KEYS[0]: batch.column(0), KEYS[1]: batch.column(1), "n": [int(g[0][-2]) for g in got],
                "rare": [g[1] for g in got],
                **{f"s{i}": [float(g[0][i]) for g in got] for i in numbers}}

    return map_batches(docs.select(*text_keys(), "text"), run, schema)


def scored(table: DataFrame, unit: str, floors: list[float]) -> DataFrame:
    return table.select(unit, *[
        (F.log(F.col(f"n{i}") + SMOOTHING) - floor).alias(f"s{i}") for i, floor in enumerate(floors)])


def backed_off(words: DataFrame, model: Model) -> DataFrame:
    """(word, s0, ...) of words that were not counted, from the longest n-grams of which any was."""
    found, numbers = None, range(len(model.languages))
    layout = arrow_schema("word string, gram string")
    for order in ORDERS:
        def split(batches, order=order):
            for batch in batches:
                pairs = [(w, g) for w in batch.column(0).to_pylist() for g in grams_of(w, order)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.string()) for c in (zip(*pairs) if pairs else ([], []))],
                    schema=layout)

        table = scored(model.grams.where(F.length("gram") == order), "gram", model.floors[order])
        met = join_sized(words.mapInArrow(split, "word string, gram string"), table, "gram", salts=4)
        # an n-gram shares its characters with its neighbours
        part = staged(met.where("s0 IS NOT NULL").groupBy("word").agg(
            *[(F.sum(f"s{i}") / order).alias(f"s{i}") for i in numbers]), "backed-off")
        found = part if found is None else found.unionByName(part)
        words = words.join(part.select("word"), "word", "left_anti")
    return found


def rare_sums(sums: DataFrame, model: Model) -> DataFrame:
    """(keys, r0, ...): what the words outside the shipped part add to all copies of each text."""
    numbers = range(len(model.languages))
    rare = sums.select(*KEYS, F.explode("rare").alias("word"))
    wanted = staged(rare.select("word").distinct(), "wanted-words")
    counted = wanted.join(scored(model.words, "word", model.floors[0]), "word", "left")
    counted = staged(counted, "counted-words")
    unseen = counted.where("s0 IS NULL").select("word")
    scores = counted.where("s0 IS NOT NULL").unionByName(backed_off(unseen, model))
    # a word that was counted but not shipped is rare; adaptive execution splits a hot unseen one
    return rare.join(scores, "word").groupBy(*KEYS).agg(
        *[F.sum(f"s{i}").alias(f"r{i}") for i in numbers])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All input columns with ``lang_pred`` and ``score``, from the texts alone."""
    rest = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "text")]
    out = docs.select(*[F.col(f"`{c}`") for c in rest], "text")
    if not model.languages:
        return out.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    numbers = range(len(model.languages))
    sums = staged(first_sums(docs, model), "text-sums")
    texts = sums.groupBy(*KEYS).agg(
        F.max("n").alias("n"), F.count("*").alias("copies"),
        *[F.max(f"s{i}").alias(f"s{i}") for i in numbers])
    texts = texts.join(rare_sums(sums, model), list(KEYS), "left").select(*KEYS, "n", *[
        (F.col(f"s{i}") + F.coalesce(F.col(f"r{i}") / F.col("copies"), F.lit(0.0))).alias(f"s{i}")
        for i in numbers])
    top = F.greatest(*[f"s{i}" for i in numbers], F.lit(float("-inf")))
    name = F.coalesce(*[F.when(F.col(f"s{i}") == top, F.lit(lang))
                        for i, lang in enumerate(model.languages)])
    share = F.lit(1.0) / sum(F.exp(F.col(f"s{i}") - top) for i in numbers)
    found = staged(texts.where("n > 0").select(*KEYS, name.alias("lang_pred"), share.alias("score")),
                   "text-languages")
    joined = join_sized(out.select("*", *text_keys()), found, list(KEYS), salts=8)
    return joined.select(
        *[F.col(f"`{c}`") for c in rest], "text",
        F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
