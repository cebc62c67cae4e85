"""Benchmark decontamination by winnowing, in SQL functions only.

A window is a run of ``SPAN`` words of a benchmark item; an item of fewer words is one window. The
fingerprint of a window is the least hash of its word k-grams, which is what winnowing keeps of it:
equal windows keep equal fingerprints, so every shared span of a window's length is found.

1. Benchmark items become an index (fingerprint, window, item).
2. Each document keeps its distinct fingerprints; those in the index mark a text as a candidate.
3. Hits of candidate texts are extended to the windows that kept the hit fingerprint, which count if
   all their words agree (64-bit fingerprint and an independent 64-bit hash of all words).
4. The windows found are merged into spans of words and listed with the items they occur in.

Words: after A-Z are lower-cased, maximal runs of characters that are none of the ASCII ones outside
0-9 and a-z. Items shorter than ``SPAN`` need fingerprints of their own length, made once per length
that occurs in the benchmark.

Sizes: nothing is gathered. The index is broadcast only if counted small, else joined with salts.
Copies of a text meet under its digest, so their hits are one set.

Defined cases: a missing or wordless text has no words and no hits; ids may repeat or be missing, as
rows are told apart by their text; a benchmark row without words is never found, one without id
marks words but is not listed; equal item ids count once; empty tables give no rows, or rows without hits;
other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleflow.llm.common import join_sized, staged

SPAN = 10
GRAM = 5
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_LONGS = "array<bigint>"


def words_of(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, BREAK), "")


def hashed(table: DataFrame, *keep: Column | str) -> DataFrame:
    """``keep``, with the hashes of all words in order and their number."""
    table = table.select(*keep, words_of(F.col("text")).alias("words"))
    return table.withColumn("h", F.coalesce(
        F.transform("words", lambda w: F.xxhash64(w)), F.array().cast(NO_LONGS))).drop(
        "words").withColumn("n_words", F.size("h"))


def along(n: Column, width: int, of) -> Column:
    """``of(i)`` for each start of a run of ``width`` among ``n``."""
    runs = F.transform(F.sequence(F.lit(0), n - width), of)
    return F.when(n >= width, runs).otherwise(F.array().cast(NO_LONGS))


def grams(length: int) -> Column:
    """Hashes of the k-grams that windows of ``length`` words are fingerprinted by."""
    k = min(GRAM, length)
    return along(F.size("h"), k, lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(k)]))


def kept(length: int) -> Column:
    """The fingerprint of each window of ``length`` words: the least of its k-gram hashes."""
    kinds = length - min(GRAM, length) + 1
    least = [lambda i, j=j: F.get("g", i + j) for j in range(kinds)]
    return along(F.size("h"), length, lambda i: F.least(*[f(i) for f in least]) if kinds > 1
                 else least[0](i))


def windows(table: DataFrame, length: int, *keep: str) -> DataFrame:
    """(keep..., length, start, fp, window): a row for each run of ``length`` words of ``h``."""
    whole = along(F.size("h"), length, lambda i: F.xxhash64(
        F.lit(length), *[F.get("h", i + j) for j in range(length)]))
    got = table.withColumn("g", grams(length)).select(
        *keep, kept(length).alias("fp"), whole.alias("window"))
    got = got.select(*keep, F.posexplode(F.arrays_zip("fp", "window")).alias("start", "w"))
    return got.select(*keep, F.lit(length).alias("length"), "start", "w.fp", "w.window")


def union_all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def index_of(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """(fp, window, item) of all items, and the window lengths in use (at most ``SPAN`` of them)."""
    items = staged(hashed(benchmark, F.col("item_id").cast("string").alias("item")).where(
        "n_words > 0"), "benchmark-words")
    used = F.least(F.col("n_words"), F.lit(SPAN))
    lengths = sorted({SPAN, *(r["k"] for r in items.select(used.alias("k")).distinct().collect())})
    parts = [windows(items.where(used == k), k, "item") for k in lengths]
    index = union_all(parts).select("fp", "window", "item").distinct()
    return staged(index, "benchmark-windows"), lengths


def spans_of(hits: DataFrame) -> DataFrame:
    """(key, spans): the windows of each text, merged where they meet or overlap."""
    ends = hits.groupBy("key", "start").agg(
        (F.col("start") + F.max("length")).alias("end"))
    order = Window.partitionBy("key").orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = F.when(F.col("start") > F.coalesce(before, F.lit(-1)), 1).otherwise(0)
    runs = ends.withColumn("first", first).withColumn("run", F.sum("first").over(order))
    merged = runs.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans, items) of every row: hit runs of words as [start, end) and the ids of
    the items with a window in the text, sorted as strings."""
    index, lengths = index_of(benchmark)
    known = index.select("fp").distinct().withColumn("known", F.lit(True))
    key = F.md5("text").alias("key")

    marked = hashed(docs, "doc_id", key)
    fps = None
    for k in lengths:
        marked = marked.withColumn("g", grams(k)).withColumn("kept", F.array_distinct(kept(k)))
        marked = marked.withColumn(
            "fps", F.col("kept") if fps is None else F.array_distinct(F.concat("fps", "kept")))
        fps = "fps"
    marked = staged(marked.select("doc_id", "key", F.col("n_words").cast("long").alias("n_words"),
                                  "fps"), "document-fingerprints")

    met = join_sized(marked.select("key", F.explode("fps").alias("fp")), known, "fp").where("known")
    candidates = staged(met.select("key").distinct(), "candidates").withColumn(
        "candidate", F.lit(True))
    texts = join_sized(docs.select(key, "text"), candidates, "key", salts=8).where("candidate")
    texts = hashed(texts, "key")
    spread = union_all([windows(texts, k, "key") for k in lengths])
    known = index.select("fp", "window").distinct().withColumn("known", F.lit(True))
    hits = staged(join_sized(spread, known, ["fp", "window"], salts=8).where("known").select(
        "key", "length", "start", "fp", "window").distinct(), "hits")

    listed = join_sized(hits.select("key", "fp", "window").distinct(), index, ["fp", "window"])
    listed = listed.where("item IS NOT NULL").select("key", "item").distinct()
    listed = listed.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = staged(spans_of(hits).join(listed, "key", "left"), "contaminated")
    rows = join_sized(marked.select("doc_id", "key", "n_words"), found, "key", salts=8)
    return rows.select(
        "doc_id", "n_words",
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
