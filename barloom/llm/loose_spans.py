"""Stretches of ``span * words`` words that runs of sentences cannot align, found at places chosen by content.

A sentence of over ``words`` words is cut at a count from its own start, so equal passages inside such sentences
are equal pieces only at equal offsets.  Here a place is chosen where the hash of a word and its successor is the
least of ``words`` neighbours, so that equal passages choose equal places at any offset.  The stretch from there on
counts where it holds over ``words`` words without a sentence end.  A passage of ``(span + 1) * words - 1`` words
always holds such a place with its stretch.

A word is what stands between white space; in scripts written without blanks (Han, kana, Thai, Lao, Burmese, Khmer)
every character is half a word.  Stretches are equal where their bytes are, white space inside them too.

The first of equal stretches is that of the smallest doc_id, then the smallest place; a later one in the same text
counts once it lies behind the first.  Stretches travel in compressed blocks by hash, one task a range of hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytetext import SPACE, RangeHash, chunks
from .shared import partitions

U = np.uint64
HARD = SPACE.copy()                                        # white space that ends a line
HARD[[32, 9]] = False
STOP = np.isin(np.arange(256), list(b".!?"))


def unspaced(data: np.ndarray) -> np.ndarray:
    """Bytes of characters of scripts written without blanks."""
    second = np.append(data[1:], np.uint8(0))
    four = (data == 0xF0) & (second >= 0xA0)
    lead = ((data >= 0xE3) & (data <= 0xE9) | (data == 0xE0) & (second >= 0xB8) & (second <= 0xBB)
            | (data == 0xE1) & np.isin(second, [0x80, 0x81, 0x82, 0x9E, 0x9F]) | (data == 0xEF) & (second >= 0xBC) & (second <= 0xBE) | four)
    out = lead.copy()
    out[1:] |= lead[:-1]
    out[2:] |= lead[:-2]
    out[3:] |= four[:-3]
    return out


def least_of(key: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    least, have = key, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least


def places(key: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the least of some ``width`` neighbours of one group.  Equal ones nearer than that are a
    chain, which keeps one in ``width``."""
    if len(key) < width:
        return np.zeros(0, np.int64)
    least = least_of(key, width)
    least[group[width - 1:] != group[:len(least)]] = U(2**64 - 1)     # not of one group: nothing is that
    highest = np.concatenate([np.zeros(width - 1, U), least, np.zeros(width - 1, U)])
    whole = np.where(highest == U(2**64 - 1), U(0), highest)
    at = np.flatnonzero(~least_of(~whole, width) == key)    # the greatest of the least around it
    new = np.ones(len(at), bool)
    new[1:] = (key[at[1:]] != key[at[:-1]]) | (np.diff(at) >= width) | (group[at[1:]] != group[at[:-1]])
    bucket = (at - at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]) // width
    new[1:] |= bucket[1:] != bucket[:-1]
    return at[new]


def stretches(data: np.ndarray, offsets: np.ndarray, span: int, words: int, hashes: tuple[RangeHash, RangeHash]):
    """(text, start, end, x, y) of the stretches, start and end in bytes of the text; the end takes white space behind it."""
    solid, lone = ~SPACE[data], unspaced(data)
    first = solid & ((data & 0xC0) != 0x80)
    first[1:] &= ~solid[:-1] | lone[1:] | lone[:-1]
    borders = offsets[:-1][np.diff(offsets) > 0]
    first[borders] = solid[borders]
    start = np.flatnonzero(first)
    n = len(start)
    if n < 2:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
    text = np.searchsorted(offsets, start, "right") - 1
    behind = np.minimum(np.append(start[1:], len(data)), offsets[text + 1])
    end = np.maximum.accumulate(np.where(solid, np.arange(len(data)), -1))[behind - 1] + 1
    hard = np.concatenate([[0], np.cumsum(HARD[data])])
    ends = (end < behind) & (STOP[data[end - 1]] | (hard[behind] > hard[end]))
    weight = np.concatenate([[0], np.cumsum(2 - lone[start].astype(np.int64))])
    begins = np.ones(n, bool)
    begins[1:] = ends[:-1] | (text[1:] != text[:-1])
    since = weight[1:] - weight[np.maximum.accumulate(np.where(begins, np.arange(n), 0))]
    long = np.concatenate([[0], np.cumsum(since > 2 * words)])
    last = np.searchsorted(weight, weight[:-1] + 2 * words * span)          # behind the stretch of each word
    fits = last <= n
    fits[fits] = text[last[fits] - 1] == text[fits]
    u = np.flatnonzero(fits)
    for h in hashes:
        h.load(data)
    u = u[places(hashes[0].of(start[u], end[np.minimum(u + 1, n - 1)]), text[u], words)]
    enough = np.searchsorted(weight, weight[u] + 2 * words + 1) - 1
    u = u[long[last[u]] > long[np.minimum(enough, last[u])]]
    x, y = (h.of(start[u], end[last[u] - 1]) for h in hashes)
    return text[u], start[u] - offsets[text[u]], behind[last[u] - 1] - offsets[text[u]], x, y


#: What a block holds of each stretch, a column after the other.
FIELDS = (("x", np.uint64), ("y", np.uint32), ("doc", np.int64), ("tie", np.int32), ("start", np.int32), ("size", np.int32))
ROWS = 1 << 18


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns byte by byte, so that equal high bytes lie together, compressed."""
    raw = b"".join(np.ascontiguousarray(c.astype(t).view(np.uint8).reshape(len(c), -1).T).tobytes() for c, (_, t) in zip(columns, FIELDS))
    return pa.Codec("zstd").compress(raw, asbytes=True)


def unpacked(block: bytes, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(block, n * sum(np.dtype(t).itemsize for _, t in FIELDS), asbytes=True), np.uint8)
    out, at = [], 0
    for _, t in FIELDS:
        width = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(raw[at:at + n * width].reshape(width, n).T).view(t).ravel())
        at += n * width
    return out


def later(x, y, doc, tie, start, size) -> np.ndarray:
    """Positions of the stretches that are not the first of their kind."""
    order = np.lexsort((start, tie, doc, y, x))
    x, y, doc, tie, start, size = (c[order] for c in (x, y, doc, tie, start, size))
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    inside = (doc == doc[first]) & (tie == tie[first]) & (start < start[first] + size[first])
    return order[~new & ~inside]


def loose_repeats(docs: DataFrame, span: int, words: int) -> DataFrame:
    """doc, tie, start, end (bytes) of all stretches of ``docs`` (doc, tie, text) but the first of each kind."""
    n_blocks = partitions(docs.sparkSession)

    def cut(batches):
        hashes, held, n_held = (RangeHash(31), RangeHash(32)), [], 0

        def blocks():
            columns = [np.concatenate(c) for c in zip(*held)]
            to = (columns[0] >> U(32)) % U(n_blocks)
            order = np.argsort(to, kind="stable")
            border = np.searchsorted(to[order], np.arange(n_blocks + 1, dtype=U))
            some = np.flatnonzero(np.diff(border))
            parts = [[c[order[border[b]:border[b + 1]]] for c in columns] for b in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.diff(border)[some], pa.int32()), pa.array([packed(p) for p in parts], pa.binary())],
                                              names=["block", "n", "rows"])

        for b in batches:
            doc, tie = b.column(0).to_numpy(), b.column(1).to_numpy()
            for row, data, offsets in chunks(b.column(2)):
                text, start, end, x, y = stretches(data, offsets, span, words, hashes)
                held.append((x, y.astype(np.uint32), doc[row + text], tie[row + text], start, end - start))
                n_held += len(x)
                if n_held >= ROWS:
                    yield blocks()
                    held, n_held = [], 0
        if n_held:
            yield blocks()

    def meet(batches):
        held = [unpacked(block, n) for b in batches for n, block in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        if held:
            x, y, doc, tie, start, size = (np.concatenate(c) for c in zip(*held))
            at = later(x, y, doc, tie, start, size)
            for i in range(0, len(at), 1 << 16):
                p = at[i:i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(c[p]) for c in (doc, tie, start, start + size)], names=["doc", "tie", "start", "end"])

    return (docs.select("doc", "tie", "text").mapInArrow(cut, "block int, n int, rows binary").repartition("block")
            .mapInArrow(meet, "doc long, tie int, start int, end int"))
