"""Best-fit packing after Martello and Toth's dominance reduction, on counts of sizes.

Token counts are whole numbers up to the capacity, so the instance is a table of at most ``capacity`` counts,
however many documents there are.  That table alone goes to the driver.  There

1. the reduction fixes sequences that some best packing holds: the largest size left with the one size that
   fills its room, or that dominates every other set of mates; as many such sequences as counts allow at once;
2. best fit takes what is left in falling order: each size goes where the least room that holds it is.

The plan is a list of (sizes, how many sequences).  It gives the k-th piece of a size its sequence and place,
so pieces are numbered by (size, doc_id, piece) with ``numbered`` and look their place up in the plan.

Nulls: a null text is empty and has the end id alone; doc_id may be null.  Rows that share a doc_id are packed
each for itself.  No document gives no sequence.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, numbered
from .tokens import encoder

Plan = list[tuple[tuple[int, ...], int]]


def _pair_below(sizes: list[int], count: dict[int, int], room: int) -> int:
    """The largest sum of two of the items that fits ``room``; 0 if none."""
    best, i, j = 0, 0, len(sizes) - 1
    while i <= j:
        total = sizes[i] + sizes[j]
        if total > room or (i == j and count[sizes[i]] < 2):
            j -= 1
        else:
            best = max(best, total)
            i += 1
    return best


def reduce_instance(count: dict[int, int], capacity: int) -> tuple[Plan, dict[int, int]]:
    """(sequences fixed by dominance, counts left).

    For the largest size j with room r: no mate fits: j alone.  Else let i be the largest that fits: {j, i}
    dominates if i fills r, if no two mates fit together, or if no fitting set of mates weighs more than i
    (shown by the best pair when no three fit).  When two mates fit but no three, and the heaviest pair (a, b)
    has a = i, it dominates if b is the largest that fits beside a.
    """
    count, fixed = {s: n for s, n in count.items() if n > 0}, []
    sizes = sorted(count)

    def take(*members: int) -> None:
        need = defaultdict(int)
        for m in members:
            need[m] += 1
        times = min(count[m] // k for m, k in need.items())
        fixed.append((members, times))
        for m, k in need.items():
            count[m] -= k * times
            if not count[m]:
                del count[m]
                sizes.remove(m)

    held: dict[int, int] = {}                    # sizes that no rule fixes
    while sizes:
        j = sizes[-1]
        room = capacity - j
        mates = sizes[:bisect_right(sizes, room)]
        if mates == sizes and count[j] == 1:     # j cannot be its own mate
            mates = sizes[:-1]
        if not mates:
            if held and min(held) <= room:
                held[j] = count.pop(j)
                sizes.pop()
                continue
            take(j)
            continue
        i, least = mates[-1], mates[0]
        second = least if count[least] - (least == j) > 1 else (mates[1] if len(mates) > 1 else capacity)
        blocked = any(i < s <= room for s in held)
        if not blocked and (i == room or least + second > room):
            take(j, i)
            continue
        third = least if count[least] - (least == j) > 2 else second
        if not blocked and not held and least + second + third > room and j not in mates:
            pair = _pair_below(mates, count, room)
            if pair <= i:
                take(j, i)
                continue
            beside = sizes[:bisect_right(mates, room - i)]
            b = next((s for s in reversed(beside) if s != i or count[s] > 1), 0)
            if b and i + b == pair:
                rest = [s for s in mates if s < i]
                # a pair without i is covered member by member: its larger by i, its smaller by b
                if not rest or all(min(s, room - s) <= b for s in rest):
                    take(j, i, b)
                    continue
        held[j] = count.pop(j)
        sizes.pop()
    return fixed, held


def best_fit(count: dict[int, int], capacity: int) -> Plan:
    """Best fit in falling order of size, equal sequences handled together."""
    open_: dict[int, list[tuple]] = {}                    # room -> [(members, how many)]
    rooms: list[int] = []                                 # its keys, rising

    def put(members: tuple[int, ...], times: int) -> None:
        room = capacity - sum(members)
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((members, times))

    for size in sorted((s for s, n in count.items() if n > 0), reverse=True):
        left = count[size]
        while left:
            k = bisect_left(rooms, size)
            if k == len(rooms):                           # no open sequence holds it
                each = capacity // size
                times, rest = divmod(left, each)
                for members, n in (((size,) * each, times), ((size,) * rest, 1)):
                    if members and n:
                        put(members, n)
                break
            room = rooms[k]
            members, n = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[k]
            each = min(room // size, left)
            times = min(n, left // each)
            put(members + (size,) * each, times)
            if n > times:
                put(members, n - times)
            left -= each * times
    return [group for groups in open_.values() for group in groups]


def plan(count: dict[int, int], capacity: int) -> Plan:
    """Sequences for these counts of sizes."""
    fixed, left = reduce_instance(count, capacity)
    return fixed + best_fit(left, capacity)


def slots(made: Plan) -> np.ndarray:
    """Rows (size, first sequence, how many, offset), sorted by size: where the next pieces of a size go."""
    rows, sequence = [], 0
    for members, times in made:
        offset = 0
        for size in members:
            rows.append((size, sequence, times, offset))
            offset += size
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of ``docs`` (doc_id, text), ``end_id`` behind each text.

    Only documents over the capacity are cut: full pieces from the end, so the first may be shorter.
    """
    def encode(batches):
        known = encoder(vocabulary)
        for b in batches:
            for row, ids, borders in known.encode_column(b.column(1)):
                n = np.diff(borders) + 1
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = n - (pieces - 1) * capacity
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[doc], capacity)
                full = np.full(n.sum(), end_id, "<u4")
                inner = np.ones(len(full), bool)
                inner[np.cumsum(n) - 1] = False
                full[inner] = ids
                at = (np.cumsum(n) - n)[doc] + start
                raw = full.view(np.uint8)
                crc = [zlib.crc32(raw[4 * a:4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
                columns = [b.column(0).slice(row, len(n)).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([raw[4 * a:4 * (a + k)].tobytes() for a, k in zip(at.tolist(), length.tolist())], pa.binary()))
                    names.append("ids")
                for i in range(0, len(doc), 10_000):
                    yield pa.RecordBatch.from_arrays([c.slice(i, 10_000) for c in columns], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, schema)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (length, doc_id, piece, ...) of 1 to ``capacity`` tokens."""
    order = ["length", "doc_id", "piece", "start", "ids_crc32"]
    rows = numbered(pieces, order, "_n")
    count = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}    # at most ``capacity`` rows
    if any(not 0 < s <= capacity for s in count):
        raise ValueError(f"a piece is empty or longer than {capacity}")
    table = slots(plan(count, capacity))
    first = np.cumsum(table[:, 2]) - table[:, 2] if len(table) else np.zeros(0, np.int64)

    def place(batches):
        for b in batches:
            n = b["_n"].to_numpy()
            k = np.searchsorted(first, n, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i, name in enumerate(b.schema.names) if name != "_n"] + [pa.array(table[k, 1] + n - first[k]), pa.array(table[k, 3])],
                names=[name for name in b.schema.names if name != "_n"] + ["sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_n")
    return rows.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Whole documents into sequences of at most ``capacity`` tokens."""
    return pack(cut(token_pieces(docs, vocabulary, capacity, end_id, with_ids)), capacity)
