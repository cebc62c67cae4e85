"""How filters interact: what each removes, where, and what others would have removed anyway.

1. Every row gets a number in the order of the scan; numbers fall into blocks of ``BLOCK`` rows.
2. Per part (a column such as the language), block and filter, the numbers of the failing rows are
   kept as a sorted posting list; so are those of rows with a mark (good, toxic).
3. Within a block, a k-way merge of the lists gives the union of every set of filters: the list with
   the least head is galloped through up to the next list's head. Differences gallop likewise. Sizes
   are summed over the blocks.
4. What a filter removes at its place in an order is the growth of the union of all before it, so
   every order is read off the sizes of the unions.

No list is longer than a block, and no task needs more than one block of one part at a time, however
large a part or a group of copies is.

Defined cases: a missing text is empty; a missing part is the empty string; rows with repeated or
missing ids count one by one; a row without id has no labels, never fails ``repeats`` and makes no
other row fail; a row has a mark if any of its label rows has it; an empty table has no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleflow.llm.common import arrow_schema, join_sized, staged

BLOCK_BITS = 15
BLOCK = 1 << BLOCK_BITS
EVERY = "*"
SIZES = "part string, subset int, failing long, good long, toxic long"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of the four filters that look at one text."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failing(docs: DataFrame, labels: DataFrame, part: str = "lang",
            filters=text_filters, repeats: str = "E") -> DataFrame:
    """(row, part, one boolean per filter, good, toxic): the verdicts on every row."""
    text = F.coalesce("text", F.lit(""))
    verdicts = filters(text)
    rows = staged(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.coalesce(part, F.lit("")).alias("part"), F.md5(text).alias("digest"),
        *[c.alias(name) for name, c in verdicts.items()]), "verdicts")
    first = rows.groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(
        "first < last").drop("last")
    rows = join_sized(rows, first, "digest").withColumn(
        repeats, F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return join_sized(rows, marks, "doc_id", salts=4).select(
        "row", "part", *verdicts, repeats, *[F.coalesce(m, F.lit(False)).alias(m)
                                             for m in ("good", "toxic")])


def posting_lists(rows: DataFrame, names: list[str]) -> DataFrame:
    """(part, block, list, n, ids): sorted places of the failing or marked rows in their block; the
    list of all rows has a count only."""
    lists = F.array_compact(F.array(F.lit(EVERY), *[
        F.when(F.col(name), F.lit(name)) for name in names]))
    place = F.when(F.col("list") != EVERY, (F.col("row") % BLOCK).cast("int"))
    return rows.select(
        "part", F.shiftright("row", BLOCK_BITS).alias("block"), "row",
        F.explode(lists).alias("list")).groupBy("part", "block", "list").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(place)).alias("ids"))


def gallop(ids: list[int], at: int, bound: int) -> int:
    """The first place from ``at`` on whose id is not below ``bound``."""
    step, low = 1, at
    while at < len(ids) and ids[at] < bound:
        low, at, step = at + 1, at + step, step * 2
    return bisect_left(ids, bound, low, min(at, len(ids)))


def merged(lists: Iterable[list[int]]) -> list[int]:
    """The union of sorted lists without repeats."""
    live = [[ids[0], 0, ids] for ids in lists if ids]
    out: list[int] = []
    while len(live) > 1:
        live.sort()
        (head, at, ids), bound = live[0], live[1][0]
        if head == bound:  # the next list brings it
            end = at + 1
        else:
            end = gallop(ids, at, bound)
            out += ids[at:end]
        if end == len(ids):
            live.pop(0)
        else:
            live[0][:2] = ids[end], end
    return out + live[0][2][live[0][1]:] if live else out


def less(ids: list[int], taken: list[int]) -> int:
    """How many of ``ids`` are not in ``taken``; the longer list is galloped through."""
    left, at = len(ids), 0
    if len(ids) > len(taken):
        return left - len(taken) + less(taken, ids)
    for one in ids:
        at = gallop(taken, at, one)
        if at == len(taken):
            break
        left -= taken[at] == one
    return left


def union_sizes(lists: DataFrame, filters: list[str]) -> DataFrame:
    """(part, subset, failing, good, toxic): how many rows fail any filter of each subset (bit k of
    it stands for filter k), and how many of them are marked; subset -1 counts all rows."""
    layout = arrow_schema(SIZES)

    def block(table: pa.Table) -> pa.Table:
        got = {r["list"]: r for r in table.select(["list", "n", "ids"]).to_pylist()}
        ids = {name: r["ids"] for name, r in got.items()}
        good, toxic = ids.get("good", []), ids.get("toxic", [])
        rows = [(-1, got[EVERY]["n"], len(good), len(toxic))]
        for subset in range(1 << len(filters)):
            union = merged(ids.get(f, []) for k, f in enumerate(filters) if subset >> k & 1)
            rows.append((subset, len(union), len(good) - less(good, union),
                         len(toxic) - less(toxic, union)))
        part = table.column("part")[0].as_py()
        columns = [[part] * len(rows), *zip(*rows)]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, layout)], schema=layout)

    return lists.groupBy("part", "block").applyInArrow(block, SIZES).groupBy("part", "subset").agg(
        *[F.sum(c).alias(c) for c in ("failing", "good", "toxic")])


def by_order(sizes: DataFrame, filters: list[str]) -> DataFrame:
    """One row per part, order of the filters and step, read off the sizes of the unions."""
    full = (1 << len(filters)) - 1
    steps = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, k in enumerate(order, 1):
            name = "".join(filters[i] for i in order)
            steps.append(f"struct('{name}' AS filter_order, {step} AS step, '{filters[k]}' AS name, "
                         f"{before} AS before, {before | 1 << k} AS after, {1 << k} AS own, "
                         f"{full & ~(1 << k)} AS others)")
            before |= 1 << k
    per_part = sizes.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(
        "subset", F.struct("failing", "good", "toxic")))).alias("m"))
    at = per_part.select("part", "m", F.expr(f"inline(array({', '.join(steps)}))"))

    def size(subset: str, kind: str = "failing") -> Column:
        return F.col("m")[F.col(subset)][kind]

    removed = size("after") - size("before")
    got = at.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "name",
        (F.col("m")[F.lit(-1)]["failing"] - size("after")).alias("kept"),
        removed.alias("removed"), (size("own") - removed).alias("redundant"),
        (F.col("m")[F.lit(full)]["failing"] - size("others")).alias("unique_fails"),
        (size("after", "good") - size("before", "good")).alias("good_lost"),
        (size("after", "toxic") - size("before", "toxic")).alias("toxic_lost"))
    total = got.groupBy("part", "name").agg(F.sum("removed").alias("shapley"))
    return got.join(total, ["part", "name"]).drop("name")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over all rows, per language."""
    filters = [*text_filters(F.lit("")), "E"]
    lists = staged(posting_lists(failing(docs, labels), [*filters, "good", "toxic"]), "postings")
    return by_order(staged(union_sizes(lists, filters), "union-sizes"), filters)
