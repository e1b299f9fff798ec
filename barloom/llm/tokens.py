"""Token ids of whole texts, encoding each different piece of text once.

The vocabulary's own pattern never joins a blank or line feed that a solid character follows to
what stands before it, nor a line feed to that character, nor a letter to a stop behind it, so a
text is cut there and the pieces are encoded alone.  Pieces recur; ids of those met before are
looked up by hash, and the bytes are compared, so a hash that two pieces share changes nothing.

An added token such as <|endoftext|> may hold such a place, so a text with one is encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .bytetext import SPACE, RangeHash, chunks, ragged

#: Bytes after a blank that may begin white space beyond ASCII (C2 E1 E2 E3) or are controls: no cut there.
UNSURE = SPACE.copy()
UNSURE[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
STOP = np.isin(np.arange(256), list(b".,;:!?|#*%&$"))
#: A piece that a line of its own does not change: a blank at most, then no white space.
PLAIN = re.compile(rb" ?[\x21-\x7E\xC3-\xDF\x80-\xBF]+\Z")
LETTER = np.array([chr(i).isascii() and chr(i).isalpha() for i in range(256)])


class Encoder:
    """Ids of many texts at a time.  ``limit``: pieces that the memory holds before it starts anew.

    ``added``: an added token's content in a text is that token, as the library has it unless told otherwise;
    else it is text like any other.
    """

    def __init__(self, path: str, limit: int = 2_000_000, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.limit = limit
        self.hasher = RangeHash(11)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)       # sorted hashes of known pieces
        self.slot = np.zeros(0, np.int64)        # their numbers
        self.text_at, self.text = np.zeros(1, np.int64), np.zeros(0, np.uint8)
        self.ids_at, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _plain(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)]

    def _flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._plain(texts)
        return np.array([x for i in ids for x in i], np.uint32), np.cumsum([len(i) for i in ids])

    def _lines(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces without a line feed, encoded as the lines of one text: the feed is one id of its own there."""
        ids = np.array(self._plain([b"\n".join(pieces) + b"\n."])[0], np.uint32)[:-1]
        feed = np.flatnonzero(ids == self._plain([b"\n"])[0][0])
        if len(feed) != len(pieces):                       # another vocabulary's pattern
            return self._flat(pieces)
        return np.delete(ids, feed), feed - np.arange(len(feed))

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        simple = np.array([bool(PLAIN.match(p)) for p in pieces])
        for part, way in ((np.flatnonzero(simple), self._lines), (np.flatnonzero(~simple), self._flat)):
            if len(part):
                self._add(keys[part], [pieces[i] for i in part], *way([pieces[i] for i in part]))

    def _add(self, keys: np.ndarray, pieces: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        place = np.searchsorted(self.keys, keys)            # keys come sorted
        slot = len(self.text_at) - 1 + np.arange(len(pieces))
        self.text_at = np.concatenate([self.text_at, self.text_at[-1] + np.cumsum([len(p) for p in pieces])])
        self.ids_at = np.concatenate([self.ids_at, self.ids_at[-1] + ends])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(pieces), np.uint8)])
        self.ids = np.concatenate([self.ids, ids])
        self.keys, self.slot = np.insert(self.keys, place, keys), np.insert(self.slot, place, slot)

    def _holders(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The texts that hold an added token."""
        raw = data.tobytes() if self.added else b""
        found = [m.start() for token in self.added for m in re.finditer(b"(?=" + re.escape(token) + b")", raw)]
        return np.unique(np.searchsorted(offsets, found, "right") - 1) if found else np.zeros(0, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, n + 1 borders in them)."""
        holders = self._holders(data, offsets)
        if not len(holders):
            return self._by_pieces(data, offsets)
        size, alone = np.diff(offsets), np.ones(len(offsets) - 1, bool)
        alone[holders] = False
        ids, ends = self._flat([data[offsets[i]:offsets[i + 1]].tobytes() for i in holders])
        others, borders = self._by_pieces(data[np.repeat(alone, size)], np.concatenate([[0], np.cumsum(size[alone])]))
        n_ids = np.zeros(len(size), np.int64)
        n_ids[holders], n_ids[alone] = np.diff(ends, prepend=0), np.diff(borders)
        merged, mine = np.zeros(n_ids.sum(), np.uint32), np.repeat(alone, n_ids)
        merged[mine], merged[~mine] = others, ids
        return merged, np.concatenate([[0], np.cumsum(n_ids)])

    def _by_pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(len(data), bool)
        blank, follower = (data[:-1] == 32) | (data[:-1] == 10), ~UNSURE[data[1:]]
        cut[:-1] = blank & follower
        cut[1:] |= (data[:-1] == 10) & follower
        cut[1:] |= LETTER[data[:-1]] & STOP[data[1:]]
        filled = np.diff(offsets) > 0
        ends = offsets[1:][filled] - 1
        cut[ends] &= ~SPACE[data[ends]]                     # white space that ends a text has no follower
        cut[offsets[:-1][filled]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        keys = self.hasher.load(data).of(start, end)
        different, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(different) > self.limit:
            self._forget()
        place = np.searchsorted(self.keys, different)
        known = np.zeros(len(different), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == different[inside]
        new = np.flatnonzero(~known)
        if len(new):
            self._learn(different[new], [data[start[i]:end[i]].tobytes() for i in first[new]])
            place = np.searchsorted(self.keys, different)
        slot = self.slot[place][which]
        length = end - start
        same = length == self.text_at[slot + 1] - self.text_at[slot]
        if not (same.all() and np.array_equal(self.text[ragged(self.text_at[slot], length)], data)):
            ids, ends = self._flat([data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])])   # two pieces share a hash
            return ids, np.concatenate([[0], ends])
        n_ids = self.ids_at[slot + 1] - self.ids_at[slot]
        total = np.concatenate([[0], np.cumsum(n_ids)])
        return self.ids[ragged(self.ids_at[slot], n_ids)], total[np.searchsorted(start, offsets)]

    def encode_column(self, column: pa.Array, size: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, borders) for each chunk of the column."""
        for row, data, offsets in chunks(column, size):
            yield row, *self.encode(data, offsets)


def encoder(path: str) -> Encoder:
    """The Python worker's encoder for a vocabulary.  It outlives the task, so pieces met by earlier tasks are
    known; it hangs on a module of its own because functions travel by value, with new globals each time."""
    import sys
    import types
    home = sys.modules.setdefault("barloom_token_memory", types.ModuleType("barloom_token_memory"))
    known = vars(home).setdefault("encoders", {})
    if path not in known:
        known[path] = Encoder(path, added=True)
    return known[path]
