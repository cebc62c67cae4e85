"""Cheapest repair of the turn structure of conversations by a Viterbi search with coalescence.

A conversation is repaired so that the initials of its roles read as an optional ``s`` and one or
more pairs ``ua``, or as nothing. Edits: Keep (0), Rerole to user or assistant (2), Delete (3; the only one for blank
and duplicate rows), Insert an empty user or assistant row anywhere (2); a truncated row that is not
deleted costs 1 more. Of the cheapest edit strings (initials in order) the one that is least in ASCII counts.

The search walks the rows in order with one survivor per state (nothing yet, after s, after u, after
a). Survivors are leaves of a tree of edits that point back to their parents and count their
children. A leaf that no survivor needs any more is freed with all ancestors that only served it;
as soon as all survivors share an ancestor, the edits up to it are emitted. A survivor is dropped
when another one can imitate whatever follows for less, or the untouched start would hold all edits
to the end. So memory holds the unresolved edits only.

Ties are decided by the whole unresolved strings: equal strings have one rank, and the rank of a
longer string follows from the rank of what it extends and the letters added, as two strings over
the same rows never extend one another but by inserts, which cost. With ranks and cost differences
in place of strings and costs, a step depends on few values and is worked out once per process.

On Spark: rows are damaged or read, shuffled once by conversation, sorted there twice (for duplicates
and by turn; both spill), and streamed through the search. One conversation is one stream, as its
digest is defined over its rows in order; it needs no more memory when it is long, unless its
repair stays ambiguous to the end.

Defined cases: missing conv_id is a conversation of its own; missing roles and texts are one space;
missing turns come first; rows of one turn are ordered by role and text; a role whose first letter is
none of s, u, a (also an empty one) can't be kept; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rippleflow.llm.common import arrow_schema, steps

START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: What may follow a state: initial -> next state.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The role that may be put in: next state and name.
PUT = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: IMITATE[y][x]: what y pays at most beyond x for the same or a like continuation.
IMITATE = ((0, 0, 2, 0), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, CUT, SOUND = "blank", "duplicate", "truncated", ""
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
SUMMARY = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
           "cost long, audit string, repaired_sha256 string")


class Node:
    """An edit in the tree of survivors; ``needed`` counts its children and the survivors at it."""

    __slots__ = ("parent", "letter", "role", "text", "kids", "needed")

    def __init__(self, parent, letter, role, text):
        self.parent, self.letter, self.role, self.text = parent, letter, role, text
        self.kids: list[Node] = []
        self.needed = 0
        if parent is not None:
            parent.kids.append(self)
            parent.needed += 1


@lru_cache(maxsize=1 << 16)
def moves(state: tuple, initial: str, fixed: bool, cut: bool):
    """One row from a normalised state.

    ``state`` has (survivor, cost above the least, rank of its string, inserts since its last row).
    Returns the next state, what the least cost grew by, and how each survivor came about: (state,
    state before, letter, insert after it) with None for the letter where only the insert is new.
    """
    reached: dict[int, tuple] = {}

    def offer(to, cost, key, how):
        if to not in reached or (cost, key) < reached[to][:2]:
            reached[to] = (cost, key, how)

    extra = TRUNCATED if cut else 0
    for at, cost, rank, inserts in state:
        def key(letter):
            return rank, "I" * inserts + letter
        offer(at, cost + DELETE, key("D"), (at, "D", ""))
        if not fixed:
            if initial in NEXT[at]:
                offer(NEXT[at][initial], cost + KEEP + extra, key("K"), (at, "K", ""))
            to, role = PUT[at]
            offer(to, cost + REROLE + extra, key("R"), (at, "R", role))
    ranks = {key: n for n, key in enumerate(sorted({key for _, key, _ in reached.values()}))}
    found = {at: (cost, (ranks[key], 0), how, None) for at, (cost, key, how) in reached.items()}
    return settled(found)


def settled(found: dict) -> tuple:
    """Inserts, dominated survivors and the least cost taken off."""
    changed = True
    while changed:
        changed = False
        for at in list(found):
            cost, (rank, inserts), *_ = found[at]
            to = PUT[at][0]
            new = (cost + INSERT, (rank, inserts + 1))
            if to not in found or new < found[to][:2]:
                found[to] = (*new, None, at)
                changed = True
    kept = {x: v for x, v in found.items() if not any(
        v[0] > found[y][0] + IMITATE[y][x] for y in found)}
    needed = {v[3] for v in kept.values() if v[2] is None}
    while needed - kept.keys():  # an insert's origin stays until its node is made
        needed |= {found[x][3] for x in needed if found[x][2] is None}
        kept |= {x: found[x] for x in needed}
    least = min(v[0] for v in kept.values())
    after = tuple((x, v[0] - least, *v[1]) for x, v in sorted(kept.items()))
    # origins of inserts before the inserts
    order = sorted(kept, key=lambda x: kept[x][1][1])
    return after, least, tuple((x, kept[x][2], kept[x][3]) for x in order)


FIRST = settled({START: (0, (0, 0), ("", "", ""), None)})


class Search:
    """The repair of one conversation, row by row; edits go to ``emit(letter, turn, role, text)``."""

    def __init__(self, emit):
        self.emit = emit
        self.root = Node(None, "", None, None)
        self.state, self.cost, made = FIRST
        self.at = {START: self.root}
        self.root.needed += 1
        self._insert(made[1:], {START: self.root})

    def _insert(self, made, now: dict) -> None:
        for x, how, origin in made:
            if how is None:
                now[x] = Node(now[origin], "I", PUT[origin][1], "")
        self._hold(now)

    def _hold(self, now: dict) -> None:
        for node in now.values():
            node.needed += 1
        for node in self.at.values():
            self._release(node)
        self.at = now

    def _release(self, node: Node) -> None:
        node.needed -= 1
        while not node.needed and node.parent is not None:
            parent = node.parent
            parent.kids.remove(node)
            parent.needed -= 1
            node.parent, node = None, parent

    def row(self, role: str, text: str, fault: str) -> None:
        self.state, grown, made = moves(
            self.state, role[:1], fault in (BLANK, DUPLICATE), fault == CUT)
        self.cost += grown
        now: dict[int, Node] = {}
        shared: dict[tuple, Node] = {}
        for x, how, _ in made:
            if how is not None:
                before, letter, new_role = how
                if (how[:2]) not in shared:
                    shared[how[:2]] = Node(
                        self.at[before], letter, *((None, None) if letter == "D" else
                                                   (new_role or role, text)))
                now[x] = shared[how[:2]]
        self._insert(made, now)
        self._advance()

    def _advance(self) -> None:
        root = self.root
        while root.needed == 1 and root.kids:
            child = root.kids[0]
            self.emit(child.letter, child.role, child.text)
            child.parent, root = None, child
        self.root = root

    def end(self) -> int:
        """The cost; what was not emitted is."""
        cost, _, best = min((cost, (rank, inserts), x) for x, cost, rank, inserts in self.state
                            if x in ENDS)
        path, node = [], self.at[best]
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.emit(node.letter, node.role, node.text)
        return self.cost + cost


def ordered(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text, gone) with ``again`` for role and text seen earlier, each
    conversation in order in one partition; rows with ``gone`` only stand for their conversation."""
    role, text = (F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role, text, "gone").repartition("conv_id")
    same = Window.partitionBy("conv_id", "gone", "role", F.md5("text")).orderBy(
        F.col("turn").asc_nulls_first())
    return rows.withColumn("again", F.row_number().over(same) > 1).sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "text", "again")


def fault_of(text: str, again: bool) -> str:
    tail = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
    if not tail:
        return BLANK
    return DUPLICATE if again else CUT if tail[-1] not in ".!?" else SOUND


class Summary:
    """What is reported about one conversation, while its rows pass by."""

    def __init__(self):
        self.faults = {BLANK: 0, DUPLICATE: 0, CUT: 0, SOUND: 0}
        self.turns, self.least, self.most, self.illegal, self.last = 0, None, None, 0, None
        self.audit, self.written, self.sha = [], False, hashlib.sha256()

    def row(self, turn, role: str, fault: str) -> None:
        self.faults[fault] += 1
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        if self.last is not None and self.last + role[:1] not in LEGAL:
            self.illegal += 1
        self.last = role[:1]

    def edit(self, letter: str, role, text) -> None:
        self.audit.append(letter)
        if letter != "D":
            self.sha.update(f"\n{role}:{text}"[0 if self.written else 1:].encode("utf-8", "surrogatepass"))
            self.written = True

    def out(self, conv_id, cost: int) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (conv_id, gaps, *(self.faults[f] for f in (BLANK, DUPLICATE, CUT)), self.illegal, cost,
                "".join(self.audit), self.sha.hexdigest())


def walk(batches, begin, row, end):
    """Stream ordered rows: ``begin(conv_id)`` gives a state, ``end`` its result rows."""
    state, conv = None, None
    for batch in (part for whole in batches for part in steps(whole)):
        rows: list[tuple] = []
        for conv_id, turn, role, text, gone, again in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or conv_id != conv:
                if state is not None:
                    rows += end(state)
                state, conv = begin(conv_id), conv_id
            if not gone:
                row(state, turn, role, text, fault_of(text, again), rows)
        yield rows
    if state is not None:
        yield end(state)


def _mapped(rows: DataFrame, schema: str, stream) -> DataFrame:
    layout = arrow_schema(schema)

    def run(batches):
        for got in stream(batches):
            if got:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*got), layout)], schema=layout)

    return rows.select("conv_id", "turn", "role", "text", "gone", "again").mapInArrow(run, schema)


def repaired(conversations: DataFrame) -> DataFrame:
    """The edits of every conversation in order, as (conv_id, position, edit, role, text); rows
    without the edit D, in order, are the repaired conversation. Rows are written as they resolve."""
    if "gone" not in conversations.columns:
        conversations = conversations.withColumn("gone", F.lit(False))
    schema = "conv_id long, position long, edit string, role string, text string"

    def stream(batches):
        held: list[tuple] = []

        def begin(conv_id):
            count = [0]

            def emit(letter, role, text):
                held.append((conv_id, count[0], letter, role, text))
                count[0] += 1
            return Search(emit)

        def row(search, turn, role, text, fault, rows):
            search.row(role, text, fault)
            rows += held
            held.clear()

        def end(search):
            search.end()
            out = held.copy()
            held.clear()
            return out

        return walk(batches, begin, row, end)

    return _mapped(ordered(conversations), schema, stream)


def summaries(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cost and string of the cheapest edits and the SHA-256
    of the repaired ``role:text`` lines. Rows with ``gone`` count for nothing but their conv_id."""
    if "gone" not in conversations.columns:
        conversations = conversations.withColumn("gone", F.lit(False))

    def begin(conv_id):
        about = Summary()
        return conv_id, about, Search(about.edit)

    def row(state, turn, role, text, fault, rows):
        state[1].row(turn, role, fault)
        state[2].row(role, text, fault)

    def end(state):
        return [state[1].out(state[0], state[2].end())]

    return _mapped(ordered(conversations), SUMMARY, lambda batches: walk(batches, begin, row, end))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row (it stays as
    ``gone``), 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes its role user."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text).alias("text"), (kind == 0).alias("gone"),
        F.explode(copies).alias("copy")).drop("copy")
