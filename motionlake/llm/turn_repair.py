"""Repair of the turn structure of conversations: the cheapest edits after which roles read ``(s?(ua)+)?``.

Each conversation is a lattice of (turns taken, state of the grammar), never laid out in memory: Keep, Rerole, Delete and Insert
lead from node to node. Dijkstra's search takes nodes by (cost, audit), audit being the edits' initials so far, and ends at the
first accepting end node that it pops. Two audits that reach a node at equal cost never are one the beginning of the other, so the
order of audits holds under any further edits. Audits live in a trie with jump pointers: equal audits are one node of it, and two
are compared in logarithmic time, so that a long conversation takes memory in proportion to its turns. A worker remembers the edits
of short conversations by the faults and roles of their turns, as most conversations look alike.

``plans`` shuffles a few bytes of each row, not its text: role, digest of the text, flags. ``repaired`` then shuffles texts once,
each conversation's plan before its rows, and streams through them. An audit is one value and the rows of a conversation come in
one order, so a conversation is the work of one task; what that task holds of it is a digest a distinct row, a byte a row and the
search (about 2 KB a row), never its texts.

Edge cases: nulls in conv_id, turn, role and text count as one space where text is asked for; a null conv_id is a conversation of
its own; a null turn comes first; rows of one turn are taken by role, then by digest of the text, so that the order doesn't depend
on the table's; repeated rows are duplicates; a conversation without rows has an empty plan; a role's initial is its first
character, an empty role has none and is illegal; gaps are capped at 2**63 - 1; an empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Costs of the edits; a truncated turn that isn't deleted adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the grammar: nothing yet, after the system's, the user's, the assistant's turn. What each may take, and where a user's
#: or an assistant's turn (whichever may come next) leads.
START, SYSTEM, USER, ASSISTANT = range(4)
TAKES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Conversations of up to so many turns are remembered, so many of them at most.
SHORT, REMEMBERED = 40, 50_000


class Audit:
    """A text of edit initials as a node of a trie; nodes are equal only if they are the same."""

    __slots__ = ("parent", "jump", "depth", "letter", "D", "I", "K", "R")

    def __init__(self, parent: Audit | None = None, letter: str = ""):
        self.parent, self.letter = parent, letter
        self.D = self.I = self.K = self.R = None
        if parent is None:
            self.depth, self.jump = 0, self
        else:
            near = parent.jump
            self.depth = parent.depth + 1
            self.jump = near.jump if parent.depth - near.depth == near.depth - near.jump.depth else parent

    def then(self, letter: str) -> Audit:
        node = getattr(self, letter)
        if node is None:
            node = Audit(self, letter)
            setattr(self, letter, node)
        return node

    def beginning(self, depth: int) -> Audit:
        node = self
        while node.depth > depth:
            node = node.jump if node.jump.depth >= depth else node.parent
        return node

    def __lt__(self, other: Audit) -> bool:
        depth = min(self.depth, other.depth)
        a, b = self.beginning(depth), other.beginning(depth)
        if a is b:
            return self.depth < other.depth
        while a.parent is not b.parent:
            a, b = (a.parent, b.parent) if a.jump is b.jump else (a.jump, b.jump)
        return a.letter < b.letter

    def __str__(self) -> str:
        out, node = [], self
        while node.depth:
            out.append(node.letter)
            node = node.parent
        return "".join(reversed(out))


def search(turns: str) -> tuple[int, str]:
    """Cost and audit of the cheapest edits; of a turn, its role's initial (upper case: truncated, x: to be deleted, o: another role)."""
    n = len(turns)
    done = bytearray(4 * (n + 1))
    heap = [(0, Audit(), 0, START)]
    while True:
        cost, audit, at, state = heappop(heap)
        if done[4 * at + state]:
            continue
        if at == n and state in (START, ASSISTANT):
            return cost, str(audit)
        done[4 * at + state] = 1
        edits = [(INSERT, "I", at, NEXT[state])]
        if at < n:
            turn = turns[at]
            edits.append((DELETE, "D", at + 1, state))
            if turn != "x":
                extra = TRUNCATED * turn.isupper()
                edits.append((REROLE + extra, "R", at + 1, NEXT[state]))
                if turn.lower() in TAKES[state]:
                    edits.append((extra, "K", at + 1, TAKES[state][turn.lower()]))
        for more, letter, to, into in edits:
            if not done[4 * to + into]:
                heappush(heap, (cost + more, audit.then(letter), to, into))


remembered = lru_cache(REMEMBERED)(search)


def cheapest(turns: str) -> tuple[int, str]:
    return remembered(turns) if len(turns) <= SHORT else search(turns)


def text_of(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and times (0: dropped, 2: repeated) of every row, damaged by the CRC of conversation and turn."""
    drawn = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), drawn.alias("drawn"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("drawn") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("drawn") == 1, F.lit("")).when(F.col("drawn") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("drawn") == 0, F.lit(0)).when(F.col("drawn") == 3, F.lit(2)).otherwise(F.lit(1)).alias("times"),
    )


def digest() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


#: Rows of a conversation; nulls first.
IN_ORDER = ["turn", "role", "digest"]
PLAN = {"gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string()}
PLAN_DDL = ", ".join(f"{c} {'string' if c == 'audit' else 'long'}" for c in PLAN)
LEGAL = {"su", "ua", "au"}


class Turns:
    """What is known of a conversation's rows so far."""

    def __init__(self, key):
        self.key, self.turns, self.seen = key, [], set()
        self.first = self.last = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = None

    def add(self, turn, role: str, text_digest: bytes, blank: bool, cut: bool) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += self.last is None or turn != self.last
            self.last = turn
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        again = (role, text_digest) in self.seen
        self.seen.add((role, text_digest))
        if blank or again:
            self.blank += blank
            self.duplicate += not blank
            self.turns.append("x")
        else:
            self.truncated += cut
            letter = initial if initial in ("s", "u", "a") else "o"
            self.turns.append(letter.upper() if cut else letter)

    def plan(self) -> tuple:
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.distinct, 2**63 - 1)
        return (self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *cheapest("".join(self.turns)))


def plans(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, counts of faults, cost and audit of each conversation of ``damaged`` rows (or others of that shape)."""
    words = F.rtrim(F.col("text"), F.lit(SPACE_CHARS))
    flags = rows.select(
        "conv_id", "turn", "role", digest().alias("digest"), (words == "").alias("blank"), (~F.right(words, F.lit(1)).isin(".", "!", "?")).alias("cut"), "times"
    )
    names, kinds = ["conv_id", *PLAN], [None, *PLAN.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = kind = None
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for key, *row, times in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or key != now.key:
                    if now is not None:
                        done.append(now.plan())
                    now = Turns(key)
                for _ in range(times):
                    now.add(*row)
            yield table(done, kind)
        if now is not None:
            yield table([now.plan()], kind)

    def table(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t or kind) for k, t in enumerate(kinds)], names=names)

    return flags.repartition("conv_id").sortWithinPartitions("conv_id", *IN_ORDER).mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {PLAN_DDL}")


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Lists of (key, place, turn, role, text, edit) for the turns that stay; (key, None, ...) where a conversation begins."""
    key, audit, at, state, place = None, "", 0, START, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, state, place
        while audit[at : at + 1] == "I":
            state, at, place = NEXT[state], at + 1, place + 1
            yield key, place - 1, None, ROLES[state], "", "I"

    for batch in batches:
        out = []
        for new, planned, turn, role, text, times in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if planned is not None:
                out += inserted()
                key, audit, at, state, place = new, planned, 0, START, 0
                out.append((key, None, None, None, None, None))
            for _ in range(times):
                out += inserted()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = TAKES[state][role[0]]
                elif edit == "R":
                    state = NEXT[state]
                    role = ROLES[state]
                if edit != "D":
                    out.append((key, place, turn, role, text, edit))
                    place += 1
        yield out
    yield list(inserted())


def by_plan(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order."""
    texts = rows.where("times > 0").select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "times", digest().alias("digest"))
    heads = found.select("conv_id", "audit", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "text")], F.lit(0).alias("times"), F.lit(None).cast("binary").alias("digest"))
    ordered = texts.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *IN_ORDER)
    return ordered.select("conv_id", "audit", "turn", "role", "text", "times")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, turn, role, text and edit (K, R, I) of the turns that each conversation has after its plan's edits."""
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                names = dict(zip(batch.schema.names, batch.schema.types, strict=True))
                schema = pa.schema([("conv_id", names["conv_id"]), ("place", pa.int64()), ("turn", names["turn"]), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
                yield batch

        for out in edited(noted()):
            if schema is not None:
                stay = [x for x in out if x[1] is not None]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in stay], f.type) for k, f in enumerate(schema)], schema=schema)

    return by_plan(rows, found).mapInArrow(run, f"conv_id {kind['conv_id']}, place long, turn {kind['turn']}, role string, text string, edit string")


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of each conversation: of its repaired ``role:text``, joined by newlines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, kind = None, None, None

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        def table(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], kind), pa.array([x[1] for x in done], pa.string())], names=["conv_id", "repaired_sha256"])

        for out in edited(noted()):
            done = []
            for new, place, _, role, text, _ in out:
                if place is None:
                    if sha is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = new, hashlib.sha256()
                else:
                    sha.update(f"{chr(10) * (place > 0)}{role}:{text}".encode())
            if kind is not None:
                yield table(done)
        if sha is not None:
            yield table([(key, sha.hexdigest())])

    return by_plan(rows, found).mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")
