"""Best-fit packing of token sequences by linear grouping.

1. Documents become token ids and an end mark; only those longer than a sequence are cut, into full
   pieces behind a first piece that takes the remainder. The pieces are written once.
2. There are at most ``capacity`` different lengths, so the plan is made from the count of each
   length, whatever the number of documents. Large lengths are sorted and grouped into groups of
   equal cardinality, and each is rounded up to the longest of its group. The few rounded sizes
   are packed by a linear program over configurations (sets of sizes that fit one sequence),
   solved by column generation: a knapsack proposes configurations while one improves. Whole
   parts of the solution are taken.
3. The actual lengths take the places of the rounded ones, each as long as the later places of its
   sequence allow; the small lengths, and the large ones that no whole configuration took, are then
   added by best fit, a new sequence only when none has room.
4. A document's rank among those of its length gives its place: ranks come from counts per bucket
   and local row numbers, so no length is gathered into one task.

Sequences of equal contents form a class; a plan has some thousand classes at most. Each document
looks its rank up in the classes of its length.

Defined cases: a missing text is an empty one (just the end mark); rows with equal ids are packed
each for itself and share their piece numbers; an empty table gives an empty result. Very long
texts are read whole, in slices that end where a token must end.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rippleflow.llm.common import arrow_schema, join_sized, staged

END = 2
GROUPS = 128
#: Lengths above this share of a sequence are large.
LARGE = 1 / 8
CACHED_WORDS = 200_000
#: Below this character both libraries part texts alike (a test goes through all of them).
ALIKE = "\u0250"
# Fixed value: how byte-level tokenizers of this kind part a text before merging.
WORD_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


# ---- tokens ---------------------------------------------------------------------------------

class Tokens:
    """Ids of whole texts, as ``tokenizers`` makes them from its file.

    Byte-level merges never cross a lone space before a word, so words with their leading space are
    encoded once and remembered. New words go through ``tiktoken``, which merges three times
    faster, with the ranks of the same file, if all their characters are below ``ALIKE``: Latin
    letters and signs of which the Unicode tables of both libraries hold the same. Other words go
    through ``tokenizers``, and so does, whole, a text with the string of a special token.
    """

    SPACE = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.words: dict[str, bytes] = {}
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.fast = byte_merges(self.tokenizer)

    def encode(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in got]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words behind a space, in one call: a line break between them stays a token."""
        text = " " + "\n ".join(words)
        if len(self.line) != 1 or text.count("\n") != len(words) - 1:
            return self.encode([" " + w for w in words])
        if self.fast is None or (not text.isascii() and max(text) >= ALIKE):
            ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        else:
            ids = self.fast.encode_ordinary(text)
        ids = np.array(ids, self.kind)
        ends = [*np.flatnonzero(ids == self.line[0]).tolist(), len(ids)]
        if len(ends) != len(words):
            return self.encode([" " + w for w in words])
        data, size = ids.tobytes(), ids.itemsize
        starts = [0, *(e + 1 for e in ends)]
        return [data[size * a:size * b] for a, b in zip(starts, ends)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        marked = [any(s in t for s in self.special) for t in texts]
        if any(marked):
            whole = iter(self.encode([t for t, m in zip(texts, marked) if m]))
            rest = iter(self([t for t, m in zip(texts, marked) if not m]))
            return [np.frombuffer(next(whole), self.kind) if m else next(rest) for m in marked]
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        known = self.words
        split = [text.split(" ") for text in texts]
        new = self.unknown(split)
        odd = {w for w in new if not w or w.strip() is not w}
        if odd:  # a space beside other white space is not where a token must end
            for i, words in enumerate(split):
                if words[0] in odd or words[0][-1:].isspace() or not odd.isdisjoint(words[1:]):
                    split[i] = self.SPACE.split(texts[i])
            new = self.unknown(split)
        broken = [w for w in new if "\n" in w]
        foreign = [w for w in new.difference(broken) if not w.isascii() and max(w) >= ALIKE]
        whole = list(new.difference(broken, foreign))
        for names in (whole, foreign, broken):
            known.update(zip(names, self.encode_words(names)))
        heads = self.encode([words[0] for words in split])
        return [np.frombuffer(first + b"".join(map(known.__getitem__, words[1:])), self.kind)
                for first, words in zip(heads, split)]

    def unknown(self, split: list[list[str]]) -> set[str]:
        return set().union(*[words[1:] for words in split]).difference(self.words)


def byte_merges(tokenizer):
    """A ``tiktoken`` encoding with the ranks of a byte-level tokenizer; None if it is another."""
    import tiktoken

    # byte-level files write bytes as characters: visible ones as themselves, others from 256 on
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    letter = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {}
    for token, number in tokenizer.get_vocab().items():
        if token not in special:
            if not all(c in letter for c in token):
                return None
            ranks[bytes(letter[c] for c in token)] = number
    try:
        return tiktoken.Encoding("words", pat_str=WORD_PATTERN, mergeable_ranks=ranks,
                                 special_tokens={})
    except Exception:  # the ranks are not those of byte pairs
        return None


@functools.cache
def tokens_of(path: str) -> Tokens:
    """One per process, so that its words serve all tasks that run there."""
    return Tokens(path)


def tokenise(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids."""
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, ids binary"
    layout = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(vocabulary)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for at in range(0, len(names), 256):
                texts = [t or "" for t in batch.column(1).slice(at, 256).to_pylist()]
                rows = []
                for name, ids in zip(names[at:at + 256], tokens(texts)):
                    ids = np.append(ids, np.array([END], tokens.kind))
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        part = ids[a:b]
                        rows.append((name, piece, a, b - a, crc32(part.astype("<u4").tobytes()),
                                     part.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), layout)], schema=layout)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


# ---- plan -----------------------------------------------------------------------------------

@dataclass
class Class:
    """``count`` sequences that hold the same lengths."""

    count: int
    lengths: Counter


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS,
         large: float = LARGE) -> list[Class]:
    """Classes of sequences that hold each length as often as the histogram says."""
    full = histogram.get(capacity, 0)
    classes = [Class(full, Counter({capacity: 1}))] if full else []
    big = {n: c for n, c in histogram.items() if large * capacity < n < capacity and c}
    small = {n: c for n, c in histogram.items() if n <= large * capacity and c}
    opened, left = substitute(grouped(big, groups), big, capacity)
    return classes + best_fit(opened, Counter(left) + Counter(small), capacity)


def grouped(big: dict[int, int], groups: int) -> dict[int, int]:
    """How many lengths take each rounded size: groups of equal cardinality, longest first, rounded
    up to the longest of each."""
    per = -(-sum(big.values()) // groups) if big else 0
    out: Counter = Counter()
    size = room = 0
    for length in sorted(big, reverse=True):
        left = big[length]
        while left:
            if not room:
                size, room = length, per
            used = min(left, room)
            out[size] += used
            left, room = left - used, room - used
    return out


def configurations(sizes: list[int], counts: list[int], capacity: int
                   ) -> list[tuple[tuple[int, ...], float]]:
    """A fractional packing of few sizes: (copies of each size, number of sequences).

    The master program is kept small: it is solved anew by the simplex method on the columns so
    far, and the knapsack over the sizes' prices proposes the next one.
    """
    k = len(sizes)
    basis = np.diag([float(capacity // size) for size in sizes])
    inverse = np.diag(1 / np.diag(basis))
    demand = np.array(counts, float)
    amount = product(inverse, demand)
    for turn in range(1, 60 * k):
        price = inverse.sum(axis=0)
        best, column = knapsack(sizes, price, capacity)
        if best <= 1 + 1e-9:
            break
        entering = product(inverse, column)
        ratios = np.where(entering > 1e-9, amount / np.where(entering > 1e-9, entering, 1), np.inf)
        leave = int(np.argmin(ratios))
        step = ratios[leave]
        amount = np.maximum(amount - step * entering, 0)
        amount[leave] = step
        basis[:, leave] = column
        if turn % 250:
            row = inverse[leave] / entering[leave]
            inverse -= np.outer(entering, row)
            inverse[leave] = row
        else:  # rounding errors add up
            inverse = inverted(basis)
            amount = np.maximum(product(inverse, demand), 0)
    return [(tuple(int(round(x)) for x in basis[:, i]), float(amount[i])) for i in range(k)
            if amount[i] > 1e-9]


def product(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(axis=1)


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by elimination with exchanged rows.

    This and ``product`` are element by element: BLAS has threads of its own for them, which can
    block one another for good in a process that has started a Spark session.
    """
    k = len(matrix)
    both = np.hstack([matrix, np.eye(k)])
    for i in range(k):
        at = i + int(np.argmax(np.abs(both[i:, i])))
        if not both[at, i]:
            raise np.linalg.LinAlgError("singular matrix")
        both[[i, at]] = both[[at, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0
        both -= np.outer(factor, both[i])
    return both[:, k:]


def knapsack(sizes: list[int], price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of sizes that fits, by dynamic programming over the room, all rooms at
    once; a size is tried as often as it can fit."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for i, (size, gain) in enumerate(zip(sizes, price)):
        if gain <= 0:
            continue
        for _ in range(capacity // size):
            new = value[:-size] + gain
            better = new > value[size:] + 1e-12
            if not better.any():
                break
            value[size:][better] = new[better]
            choice[size:][better] = i
    # value[room] holds for sums of exactly the chosen sizes or less, so follow the choices
    column, room = np.zeros(len(sizes)), capacity
    while choice[room] >= 0:
        column[choice[room]] += 1
        room -= sizes[choice[room]]
    return float(column @ price), column


class Pool:
    """Lengths with their counts; the longest one up to a limit is found by links to lower ones."""

    def __init__(self, lengths: dict[int, int], capacity: int):
        self.count = [lengths.get(n, 0) for n in range(capacity + 1)]
        self.link = list(range(-1, capacity))

    def longest(self, limit: int) -> int:
        """0 if there is none."""
        passed, at = [], limit
        while at and not self.count[at]:
            passed.append(at)
            at = self.link[at]
        for n in passed:  # shorten the way for the next search
            self.link[n] = at
        return at


def substitute(rounded: dict[int, int], lengths: dict[int, int], capacity: int
               ) -> tuple[list[Class], dict[int, int]]:
    """Sequences of the configurations, as often as whole, with actual lengths in the places of the
    rounded ones; and the lengths that are left."""
    sizes = sorted(rounded, reverse=True)
    if not sizes:
        return [], {}
    pool, classes = Pool(lengths, capacity), []
    columns = configurations(sizes, [rounded[s] for s in sizes], capacity)
    for column, amount in sorted(columns, reverse=True):
        places = [s for s, copies in zip(sizes, column) for _ in range(copies)]
        classes += fill_places(places, int(amount + 1e-6), pool, capacity)
    return classes, {n: c for n, c in enumerate(pool.count) if c}


def fill_places(places: list[int], count: int, pool: Pool, capacity: int) -> list[Class]:
    """``count`` sequences of one configuration. Every place takes the longest length that leaves
    the later places their rounded sizes, so room that a shorter length leaves is used at once;
    sequences fall into classes where a length runs out."""
    after = [sum(places[i + 1:]) for i in range(len(places))]
    open_, out = [(count, ())], []
    while open_:
        n, held = open_.pop()
        if not n:
            continue
        if len(held) == len(places):
            if any(held):
                out.append(Class(n, Counter(x for x in held if x)))
            continue
        length = pool.longest(capacity - sum(held) - after[len(held)])
        used = min(n, pool.count[length]) if length else n
        if length:
            pool.count[length] -= used
        open_ += [(n - used, held), (used, (*held, length))]
    return out


def best_fit(classes: list[Class], lengths: dict[int, int], capacity: int) -> list[Class]:
    """Add lengths, longest first, each to the fullest sequence that has room for it.

    Sequences with equal room are handled together: a sequence that takes an item stays the
    fullest, so it takes items until none fits.
    """
    by_room: list[list[Class]] = [[] for _ in range(capacity + 1)]

    def put(c: Class) -> None:
        if c.count:
            by_room[capacity - sum(n * k for n, k in c.lengths.items())].append(c)

    for c in classes:
        put(c)
    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        room = length
        while left:
            while room <= capacity and not by_room[room]:
                room += 1
            if room > capacity:
                per = capacity // length
                put(Class(left // per, Counter({length: per})))
                put(Class(1, Counter({length: left % per})) if left % per else Class(0, Counter()))
                break
            c, per = by_room[room].pop(), room // length
            whole = min(c.count, left // per)
            put(Class(whole, c.lengths + Counter({length: per})))
            left -= whole * per
            rest = c.count - whole
            if rest and left:  # fewer items than one sequence of this class takes
                put(Class(1, c.lengths + Counter({length: left})))
                rest, left = rest - 1, 0
            put(Class(rest, c.lengths))
    return [c for level in by_room for c in level]


# ---- places of documents --------------------------------------------------------------------

def place_table(classes: list[Class]) -> dict[str, np.ndarray]:
    """For each length and class: the first rank, the class size, the first sequence, the offset."""
    used, rows, sequence = defaultdict(int), [], 0
    for c in sorted(classes, key=lambda c: sorted(c.lengths.items(), reverse=True), reverse=True):
        offset = 0
        for length in sorted(c.lengths, reverse=True):
            rows.append((length, used[length], c.count, sequence, offset))
            used[length] += c.count * c.lengths[length]
            offset += length * c.lengths[length]
        sequence += c.count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "count", "sequence", "offset"), table.T.copy()))


def ranked(pieces: DataFrame, per_bucket: int) -> DataFrame:
    """``pieces`` (read from files) with ``rank``: its place among the pieces of its length.

    Rows are spread over buckets by their place in the files; a rank is the number of rows of the
    length in earlier buckets plus a row number in the own one.
    """
    rows = pieces.select("*", F.col("_metadata.file_name").alias("__file"),
                         F.col("_metadata.row_index").alias("__row"))
    least = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, 1 + pieces.count() // per_bucket)
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("__file", "__row"), F.lit(buckets)))
    earlier = rows.groupBy("length", "__bucket").agg(F.count("*").alias("__n")).select(
        "length", "__bucket", F.coalesce(F.sum("__n").over(
            Window.partitionBy("length").orderBy("__bucket")
            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__earlier"))
    own = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy("__file", "__row"))
    return (rows.withColumn("__own", own).join(earlier, ["length", "__bucket"])
            .withColumn("rank", F.col("__earlier") + F.col("__own") - 1)
            .drop("__file", "__row", "__bucket", "__own", "__earlier"))


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, groups: int = GROUPS,
         per_bucket: int = 200_000) -> DataFrame:
    """Pieces with their ids and places: doc_id, piece, start, length, ids_crc32, ids (little-endian
    unsigned, 16 bits if the vocabulary allows, else 32), sequence_id, offset."""
    pieces = staged(tokenise(docs, vocabulary, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in
                 pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = place_table(plan(histogram, capacity, groups))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        # one sorted key from both; ranks are far below 2 ** 44
        keys = (table["length"] << 44) + table["rank"]
        at = np.searchsorted(keys, (length.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64),
                             side="right") - 1
        turn, one = np.divmod(rank.to_numpy(np.int64) - table["rank"][at], table["count"][at])
        return pd.DataFrame({"sequence_id": table["sequence"][at] + one,
                             "offset": table["offset"][at] + turn * table["length"][at]})

    return (ranked(pieces, per_bucket).withColumn("__place", place("length", "rank"))
            .select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
                    "ids_crc32", "ids", "__place.sequence_id", "__place.offset"))
