"""Structure of conversations repaired by the cheapest edits, found by iterative-deepening A*.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``.  Rows are kept (0), get another
role (1) or are deleted (2); a user or assistant turn without text is put in (5).  Blank and repeated rows must
go; a truncated row that stays costs 5 more.  Edits are written by their initials D, I, K, R.

Search: depth first in ASCII order of the edits, under a bound on cost plus what is still needed at least; when a
bound fails, the least value above it is the next.  What is needed at least is the cost of a relaxed task in which
a conversation may end anywhere.  A table of failed states keeps, for a row and the last initial, the largest
budget that was not enough.  The first path that is accepted is the cheapest, and of those the first in ASCII
order.  The search holds a few bytes a row, nothing of the texts, and doesn't recurse.

Spark sorts the rows of a conversation in a shuffle twice: first without texts (initial, faults, a hash), which
gives the edits; then with texts behind the edits, which stream through SHA-256.  Neither pass holds a
conversation's texts; the first holds 17 bytes a row of the conversation that it is at.  A SHA-256 is read in
order, so a conversation goes through one task, whatever its length.

Nulls: a null role or text is one space, and so is a null conv_id or turn in the key of the damage; a null
conv_id is a conversation of its own, null turns come first.  Rows that share a turn go by role, then
MD5 of the text.  Repeated rows are rows (and duplicates of each other).  An empty table gives an
empty one.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions

START, SYSTEM, USER, ASSISTANT = range(4)            # what stands last
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE = {"u": "user", "a": "assistant"}
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
EDITS = b"DIKR"
FAR = 1 << 30

# a row as one byte: initial (s, u, a, other) and 4 if it must go, 8 if it is truncated
INITIAL = {"s": 0, "u": 1, "a": 2}
GO, CUT = 4, 8
NEED = (1, 1, 2, 1)                                  # the number of the initial that comes next, by state


def _step(code: int, state: int, edit: int) -> tuple[int, int] | None:
    """(cost, new state) of an edit at a row, None if it isn't allowed."""
    if edit == 68:                                   # D
        return DELETE, state
    if edit == 73:                                   # I
        return INSERT, NEED[state] + 1
    if code & GO:
        return None
    more = TRUNCATED if code & CUT else 0
    if edit == 75:                                   # K
        initial = code & 3
        if initial == NEED[state] or initial == 0 and state == START:
            return more, initial + 1
        return None
    return REROLE + more, NEED[state] + 1            # R


STEPS = {(code, state): [(e, *s) for e in EDITS if (s := _step(code, state, e))] for code in range(12) for state in range(4)}
BEHIND = [[(73, INSERT, NEED[state] + 1)] for state in range(4)]


def needed(codes: bytes) -> array:
    """At 4 * row + state: the least cost from there on if a conversation may end anywhere (never more than the true one)."""
    n = len(codes)
    least = array("q", bytes(8 * 4 * (n + 1)))
    at = [0] * 4
    for i in range(n - 1, -1, -1):
        now = [0] * 4
        for state in range(4):
            now[state] = min(cost + at[new] for e, cost, new in STEPS[codes[i], state] if e != 73)
        for _ in range(3):                           # turns may be put in before the row, one after another
            now = [min(now[state], INSERT + now[NEED[state] + 1]) for state in range(4)]
        least[4 * i:4 * i + 4] = array("q", now)
        at = now
    return least


def cheapest(codes: bytes) -> tuple[int, bytes]:
    """(cost, edits) of the cheapest repair; of equal ones the first in ASCII order."""
    n, least = len(codes), needed(codes)
    bound = least[0]
    while True:
        failed = array("q", [-1]) * (4 * (n + 1))    # the largest budget that was not enough
        above = FAR
        path, states = bytearray(), bytearray()      # edits, and the state before each
        i, state, left, tried = 0, START, bound, 0
        while True:
            if not tried:
                if i == n and state in (START, ASSISTANT):
                    return bound - left, bytes(path)
                spot = 4 * i + state
                if least[spot] > left:
                    above, tried = min(above, bound - left + least[spot]), 255
                elif failed[spot] >= left:
                    tried = 255
            move = None
            if tried < 255:
                for e, cost, new in STEPS[codes[i], state] if i < n else BEHIND[state]:
                    if e > tried:
                        if cost <= left:
                            move = e, cost, new
                            break
                        above = min(above, bound - left + cost)
            if move:
                e, cost, new = move
                path.append(e)
                states.append(state)
                i, state, left, tried = i + (e != 73), new, left - cost, 0
                continue
            if tried < 255:
                failed[4 * i + state] = max(failed[4 * i + state], left)
            if not path:
                break
            e, state = path.pop(), states.pop()
            i -= e != 73
            cost = INSERT if e == 73 else _step(codes[i], state, e)[0]
            left, tried = left + cost, e
        bound = above


@lru_cache(1 << 14)
def _short(codes: bytes) -> tuple[int, bytes]:
    return cheapest(codes)


def solved(codes: bytes) -> tuple[int, bytes]:
    """``cheapest``; short conversations that look alike are solved once."""
    return _short(codes) if len(codes) <= 64 else cheapest(codes)


# Spark ------------------------------------------------------------------------------------------------------------
def damaged(conversations: DataFrame, key=None) -> DataFrame:
    """conv_id, turn, role, text, copies (0 for a row that is lost, 2 for one that is repeated)."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20 if key is None else key)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("int").alias("copies"))


def _runs(keys: np.ndarray, none: np.ndarray) -> list[tuple[int, int]]:
    """First and last (exclusive) row of each run of one key."""
    border = np.flatnonzero((keys[1:] != keys[:-1]) | (none[1:] != none[:-1])) + 1
    return list(zip([0, *border.tolist()], [*border.tolist(), len(keys)])) if len(keys) else []


def by_conversation(batches, columns: list[str]):
    """(conv_id, new, rows): slices of sorted batches, ``new`` where a conversation begins."""
    last, began = None, False
    for batch in batches:
        ids = batch.column(0)
        for a, b in _runs(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)):
            conv = ids[a].as_py()
            yield conv, not began or conv != last, {c: batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in columns}
            last, began = conv, True


SUMS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
TYPES = [pa.int64()] * 6 + [pa.string()]


class _Open:
    """What is kept of the conversation that a task is at: 17 bytes a row and a few numbers."""

    def __init__(self, conv):
        self.conv, self.codes, self.keys = conv, bytearray(), []
        self.least = self.most = self.turn = None
        self.turns = 0

    def add(self, turn, initial, flags, h1, h2) -> None:
        self.codes += (initial + flags).astype(np.uint8).tobytes()
        self.keys.append(np.stack([h1, h2], 1))
        known = turn.drop_null().to_numpy()
        if len(known):
            self.turns += int(np.count_nonzero(known[1:] != known[:-1])) + (self.turn is None or self.turn != known[0])
            self.least = known[0] if self.least is None else self.least
            self.most = self.turn = known[-1]

    def result(self) -> tuple:
        codes = np.frombuffer(bytes(self.codes), np.uint8).copy()
        blank, cut, duplicate = (codes & 16) > 0, (codes & 8) > 0, np.zeros(len(codes), bool)
        if len(codes) > 1:
            keys = np.concatenate(self.keys)
            order = np.lexsort((np.arange(len(keys)), keys[:, 1], keys[:, 0]))
            duplicate[order[1:]] = (keys[order[1:]] == keys[order[:-1]]).all(axis=1)
        duplicate &= ~blank
        cut &= ~blank & ~duplicate
        initial = codes & 3
        pair = initial[:-1] * 4 + initial[1:]
        illegal = int(np.count_nonzero(~np.isin(pair, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])))
        cost, edits = solved((initial + GO * (blank | duplicate) + CUT * cut).astype(np.uint8).tobytes())
        gaps = 0 if self.least is None else int(self.most) - int(self.least) + 1 - self.turns
        return self.conv, gaps, int(blank.sum()), int(duplicate.sum()), int(cut.sum()), illegal, cost, edits.decode()


def edits(rows: DataFrame) -> DataFrame:
    """A row a conversation of ``damaged`` rows: SUMS."""
    def search(batches):
        done, now = [], None
        for conv, new, part in by_conversation(batches, ["turn", "copies", "initial", "flags", "h1", "h2"]):
            if new:
                if now:
                    done.append(now.result())
                now = _Open(conv)
            copies = part["copies"].to_numpy()
            at = np.repeat(np.arange(len(copies)), copies)
            if len(at):
                now.add(part["turn"].take(pa.array(at)), *(part[c].to_numpy()[at] for c in ("initial", "flags", "h1", "h2")))
            if len(done) >= 1000:
                yield out(done)
                done = []
        if now:
            done.append(now.result())
        yield out(done)

    def out(done):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate([pa.int64(), *TYPES])], names=["conv_id", *NAMES])

    first = F.substring("role", 1, 1)
    # trailing white space is looked for from the end by a bounded number of steps, whatever the length of the text
    body = F.rtrim(F.translate("text", "\t\n\u000b\f\r", "     "))
    hashes = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    light = rows.select("conv_id", "turn", "role", "copies", F.md5("text").alias("order"),
                        F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).cast("int").alias("initial"),
                        (F.when(body == "", 16).otherwise(0) + F.when(F.substring(body, -1, 1).isin(".", "!", "?"), 0).otherwise(8)).cast("int").alias("flags"),
                        F.conv(F.substring(hashes, 1, 15), 16, 10).cast("long").alias("h1"), F.conv(F.substring(hashes, 16, 15), 16, 10).cast("long").alias("h2"))
    return light.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "order") \
        .drop("role", "order").mapInArrow(search, SUMS)


def repaired(rows: DataFrame) -> DataFrame:
    """SUMS and repaired_sha256 of ``damaged`` rows."""
    def stream(batches):
        done, now = [], None
        for conv, new, part in by_conversation(batches, [*NAMES, "kind", "role", "text", "copies"]):
            if new:
                if now:
                    done.append(now.result())
                now = _Repair(conv, [part[c][0].as_py() for c in NAMES])
            for kind, role, text, copies in zip(*(part[c].to_pylist() for c in ("kind", "role", "text", "copies"))):
                if kind:
                    for _ in range(copies):
                        now.row(role, text)
            if len(done) >= 1000:
                yield out(done)
                done = []
        if now:
            done.append(now.result())
        yield out(done)

    def out(done):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate([pa.int64(), *TYPES, pa.string()])],
                                          names=["conv_id", *NAMES, "repaired_sha256"])

    found = edits(rows).withColumns({"kind": F.lit(0), "turn": F.lit(None).cast("long"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "copies": F.lit(0)})
    texts = rows.where("copies > 0").withColumns({**{c: F.lit(None).cast("string" if c == "audit" else "long") for c in NAMES}, "kind": F.lit(1)})
    both = found.unionByName(texts).withColumn("order", F.md5("text"))
    return both.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "order") \
        .drop("turn", "order").mapInArrow(stream, SUMS + ", repaired_sha256 string")


class _Repair:
    """Edits put to the rows of a conversation as they come; what is written goes into the hash at once."""

    def __init__(self, conv, found):
        self.conv, self.found, self.audit = conv, found, found[-1]
        self.at, self.state, self.any, self.hash = 0, START, False, hashlib.sha256()

    def write(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any, self.state = True, STATE[role[0]]

    def insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.write(ROLE[NEXT[self.state]], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.write(role, text)
        elif edit == "R":
            self.write(ROLE[NEXT[self.state]], text)

    def result(self) -> tuple:
        self.insert()
        return self.conv, *self.found, self.hash.hexdigest()


def repair(conversations: DataFrame) -> DataFrame:
    """Every conversation of ``conversations`` (conv_id, turn, role, text) after the damage: faults, cheapest edits, repaired hash."""
    return repaired(damaged(conversations))
