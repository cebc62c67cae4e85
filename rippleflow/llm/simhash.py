"""SimHash near-duplicates with bit-sliced comparison.

1. A fingerprint has a bit for each of 64 majorities over the hashes of a text's word shingles.
   Rows with equal fingerprints become one row, so copies cost nothing further.
2. The 64 bits are cut into 5 blocks. Two fingerprints that differ in at most 3 bits agree on at
   least 2 whole blocks, so they meet in one of the 10 tables keyed by two blocks (about 26 bits).
3. Within a bucket the fingerprints are stored as bit planes: word w of plane b holds bit b of 64
   members. One fingerprint is compared with 64 others at once: its bit is exclusive-ored into each
   plane and the differing bits are added up by a carry-save counter of two words and a sticky
   overflow. Words whose 64 counters have all overflowed are abandoned after every few planes.
4. A bucket reports its links as a forest, at most one row per member. A bucket beyond ``BLOCK``
   members is cut into chunks and every two chunks meet in a task of their own, so a hot bucket is
   spread and no task holds more than two chunks at a time.
5. Components of the links give each document the least id that it reaches.

Defined cases: a text without words (missing and empty ones too) has fingerprint zero and links
like any other; fewer words than a shingle form one shingle; rows without id take part but never
name a component, which is null if no row of it has an id; repeated rows come back each; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleflow.llm.common import BROADCAST_ROWS, arrow_schema, map_batches, staged
from rippleflow.llm.components import components

BITS = 64
SEED = 42
#: Members of a bucket that are compared in one piece.
BLOCK = 4096
#: (fingerprint, word) comparisons that are under way at once, which bounds memory.
LANES = 1 << 18
PLANES_PER_STEP = 8
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


# ---- fingerprints ---------------------------------------------------------------------------

def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of all word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return np.array([], np.uint64)
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    count = max(1, len(words) - shingle + 1)
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, count)


def fingerprint(text: str | None, shingle: int) -> int:
    """Bits that are set in over half of the hashes of all shingles, repeats included."""
    hashes = shingle_hashes(text, shingle)
    return int(majorities(hashes.reshape(-1, 1))[0]) if len(hashes) else 0


def majorities(hashes: np.ndarray) -> np.ndarray:
    """One word for each column: bits that are set in over half of its hashes."""
    count, words = hashes.shape
    # how often each of the bytes has each value, then bits from byte values
    octets = hashes.astype("<u8").view(np.uint8).reshape(count, 8 * words)
    places = np.arange(8 * words, dtype=np.int64) * 256
    counts = np.bincount((octets + places).ravel(), minlength=2048 * words).reshape(
        -1, 256) @ BYTE_BITS
    return np.packbits(counts.ravel() * 2 > count, bitorder="little").view("<u8")


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint of ``64 * words`` bits; each further word takes the hashes mixed once more."""
    if not len(hashes):
        return np.zeros(words, np.uint64)
    mixed = hashes[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ mixed >> np.uint64(shift)) * np.uint64(factor)
    return majorities(mixed ^ mixed >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def run(batch: pa.RecordBatch) -> dict:
        values = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "fp": np.array(values, np.uint64).view(np.int64)}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run,
                       "doc_id long, fp long")


# ---- bit-sliced comparison ------------------------------------------------------------------

def planes(members: np.ndarray) -> np.ndarray:
    """Bit planes: ``planes(m)[b, w]`` holds bit b of members 64 w .. 64 w + 63."""
    words = -(-len(members) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[:len(members)] = members
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                         bitorder="little")
    packed = np.packbits(bits.T.reshape(BITS, words, 64), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").reshape(BITS, words)


def close_pairs(members: np.ndarray, bucket: np.ndarray, radius: int,
                split: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of members of one bucket that differ in at most ``radius`` bits.

    ``bucket`` is sorted. With ``split`` (0 or 1 for each member) only pairs across it are made.
    """
    vertical = planes(members)
    size = len(members)
    index = np.arange(size)
    ends = np.searchsorted(bucket, bucket, side="right")
    first, last = (index + 1) // 64, (ends - 1) // 64  # words that hold later members
    number = np.where(ends > index + 1, last - first + 1, 0)
    other = planes(split.astype(np.uint64))[0] if split is not None else None
    total = np.cumsum(number)
    start = 0
    while start < size:
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + LANES, side="right")))
        own = np.repeat(index[start:stop], number[start:stop])
        if len(own):
            base = np.repeat(np.cumsum(number[start:stop]) - number[start:stop], number[start:stop])
            word = np.arange(len(own)) - base + first[own]
            valid = _mask_from(index[own] + 1, word) & ~_mask_from(ends[own], word)
            if other is not None:
                valid &= np.where(split[own] == 1, ~other[word], other[word])
            yield from _compare(vertical, members, own, word, valid, radius)
        start = stop


def _mask_from(position: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Bits of ``word`` at member positions from ``position`` on."""
    shift = np.clip(position - word * 64, 0, 64).astype(np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    return np.where(shift >= 64, np.uint64(0), full << np.minimum(shift, np.uint64(63)))


def _compare(vertical, members, own, word, valid, radius):
    digits = max(1, math.ceil(math.log2(radius + 1)))
    # counters start so that they overflow at radius + 1
    offset = (1 << digits) - 1 - radius
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    counter = [np.full(len(own), full if offset >> d & 1 else 0, np.uint64) for d in range(digits)]
    over = ~valid
    for plane in range(BITS):
        bit = (members[own] >> np.uint64(plane)) & np.uint64(1)
        carry = vertical[plane][word] ^ (np.uint64(0) - bit)
        for d in range(digits):
            counter[d], carry = counter[d] ^ carry, counter[d] & carry
        over |= carry
        if plane % PLANES_PER_STEP == PLANES_PER_STEP - 1:
            alive = np.flatnonzero(over != full)
            if len(alive) < len(own):
                own, word, over = own[alive], word[alive], over[alive]
                counter = [c[alive] for c in counter]
            if not len(own):
                return
    bits = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                         bitorder="little")
    lane, place = np.nonzero(bits)
    yield own[lane], word[lane] * 64 + place


def forest(members: np.ndarray, bucket: np.ndarray, radius: int,
           split: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the close pairs: members and the root that each hangs on."""
    top = trees(close_pairs(members, bucket, radius, split), len(members))
    moved = np.flatnonzero(top != np.arange(len(members)))
    return members[moved], members[top[moved]]


def trees(pairs: Iterator[tuple[np.ndarray, np.ndarray]], count: int) -> np.ndarray:
    """The root of each of ``count`` positions, the least that the pairs join it with."""
    parent = np.arange(count)
    for i, j in pairs:
        while True:
            a, b = roots(parent, i), roots(parent, j)
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low < high
            if not apart.any():
                break
            np.minimum.at(parent, high[apart], low[apart])
    return roots(parent, np.arange(count))


def roots(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    while True:
        above = parent[nodes]
        if np.array_equal(above, nodes):
            return nodes
        nodes = above


# ---- operator -------------------------------------------------------------------------------

def block_tables(radius: int) -> list[int]:
    """Masks of two of ``radius + 2`` blocks: any two fingerprints in reach agree on one mask."""
    edges = np.linspace(0, BITS, radius + 3).round().astype(int).tolist()
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(blocks, 2)]


def links(unique: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """(src, dst) forests of the distinct fingerprints within ``radius`` bits."""
    masks = block_tables(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k"))
                     for i, m in enumerate(signed)])
    rows = unique.select("fp", F.explode(keys).alias("key")).select("fp", "key.t", "key.k")
    sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.withColumn("chunks", F.ceil(F.col("n") / block).cast("int"))
    sizes = F.broadcast(sizes) if sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else sizes
    met = rows.join(sizes, ["t", "k"])
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    # every two chunks meet in one pair; a bucket of one chunk has the pair (0, 0)
    met = met.withColumn("own", own).withColumn(
        "o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "t", "k", F.least("own", "o").alias("a"), F.greatest("own", "o").alias("b"), "own", "fp")
    dealt = met.repartition("t", "k", "a", "b").sortWithinPartitions("t", "k", "a", "b", "fp")
    layout = arrow_schema("src long, dst long")

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # the last bucket of a batch may go on in the next one
            held.append(batch)
            keys = [batch.column(i).to_numpy() for i in range(4)]
            same = np.ones(batch.num_rows, bool)
            for k in keys:
                same &= k == k[-1]
            cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield out(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                held = [batch.slice(cut)] if cut < batch.num_rows else []
        if held:
            yield out(pa.Table.from_batches(held))

    def out(table: pa.Table) -> pa.RecordBatch:
        t, k, a, b, own, fp = (table.column(i).to_numpy() for i in range(6))
        new = np.ones(len(t), bool)
        new[1:] = (np.diff(t) != 0) | (k[1:] != k[:-1]) | (np.diff(a) != 0) | (np.diff(b) != 0)
        across = a != b
        src, dst = [], []
        bucket = np.cumsum(new)
        for rows_, split in ((~across, None), (across, (own == b)[across])):
            if rows_.any():
                x, y = forest(fp[rows_].view(np.uint64), bucket[rows_], radius, split)
                src.append(x.view(np.int64))
                dst.append(y.view(np.int64))
        empty = np.array([], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([empty, *src])), pa.array(np.concatenate([empty, *dst]))],
            schema=layout)

    return dealt.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3,
                    block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    # of 16 bytes a row: a file for each few MB, not one for each task that read texts
    rows = staged(fingerprints(docs, shingle).hint("rebalance"), "fingerprints")
    unique = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    label = components(links(unique, radius, block))
    named = unique.join(label, unique.fp == label.node, "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = named.join(ids, "label").select("fp", "component_id")
    return rows.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Input rows of one document per component, that with the least id.

    Rows without id can't be named and stay; rows with equal id and text become one.
    """
    found = near_duplicates(docs, **options)
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(dropped, "doc_id", "left_anti")
    return named.dropDuplicates(["doc_id", "text"]).select(docs.columns).union(docs.where("doc_id IS NULL"))
