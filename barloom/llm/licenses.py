"""Licence notices in texts, by a positional index of rare words over licence templates.

A template is a run of words with a label and key phrases that must stand in it.  How many documents hold each
licence word is counted over all of them; that gives its weight (inverse document frequency).  A file looks up
its own heaviest words of every template it can still satisfy: a word at place i that the template has at place
p votes for the diagonal i - p, and postings of different words are intersected by it, exactly for phrases
and within ``slack`` words for longer templates.  Where enough rare words agree, the key phrases are
compared word by word at their places; the share of the template's weight that stands in place is the score.

A word is a run of letters a-z, digits and characters beyond ASCII, after A-Z are lower-cased.  A place of a
phrase has all its words, so its heaviest ones meet there: no place is missed.  Work is linear in
the text times the number of places a word has in the templates.

Nulls: a null text is empty (no words, no labels, score 0); doc_id may be null.  Equal rows each get a row with
the same result.  An empty table gives an empty one.  Ties of weight go by the word.  Other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import RangeHash, chunks, lower, words

# Phrases whose places are counted, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Characteristic sentences of public licences, with the phrases that must stand in them.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction", ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    ("mit", "released under the terms of the MIT license", ["terms of the mit license"]),
    ("mit", "licensed under the MIT license", ["mit license"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
     ["apache license version 2", "except in compliance with the license"]),
    ("apache-2", "released under the Apache 2.0 license", ["apache 2 0 license"]),
    ("gpl-3", "licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("gpl-3", "licensed under the GNU GPL v3", ["gnu gpl v3"]),
    ("gpl-2", "licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
     ["redistribute it and or modify it", "gnu general public license", "free software foundation"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the GNU Affero General Public License", ["gnu affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
     ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
     ["permission to use copy modify", "with or without fee is hereby granted"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license v 2 0"]),
    ("epl-2", "available under the terms of the Eclipse Public License 2.0", ["eclipse public license 2 0"]),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by", "licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal", ["cc0 1 0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("wtfpl", "Do What The Fuck You Want To Public License", ["do what the fuck you want to"]),
]

#: Bytes between words (of lower-cased text).
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, int], ...]        # first and last place (exclusive) of each key phrase
    slack: int
    base: bool


def split(text: str) -> tuple[str, ...]:
    data = lower(np.frombuffer(text.encode(), np.uint8))
    start, end, _ = words(data, np.array([0, len(data)]), GAP)
    return tuple(data[a:b].tobytes().decode() for a, b in zip(start, end))


def template(label: str, text: str, keys: list[str], base: bool = False) -> Template:
    """A template; longer ones allow a word in eight to be put in or left out between key phrases."""
    ws = split(text)
    places = []
    for key in map(split, keys):
        at = next((i for i in range(len(ws) - len(key) + 1) if ws[i:i + len(key)] == key), None)
        if at is None or not key:
            raise ValueError(f"a key phrase must stand in its template: {key}")
        places.append((at, at + len(key)))
    return Template(label, ws, tuple(places), 0 if base else len(ws) // 8, base)


def templates() -> list[Template]:
    return [template(label, p, [p], True) for p, label in PHRASES.items()] + [template(*n) for n in NOTICES]


class Index:
    """Licence words with the templates and places they have, and how a text's words are told."""

    def __init__(self, known: list[Template]):
        self.known = known
        self.vocabulary = sorted({w for t in known for w in t.words})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.ids = [np.array([number[w] for w in t.words]) for t in known]
        self.postings = [{w: np.flatnonzero(ids == w) for w in np.unique(ids).tolist()} for ids in self.ids]
        self.musts = [np.unique(np.concatenate([ids[a:b] for a, b in t.keys])) for t, ids in zip(known, self.ids)]
        self.hash = RangeHash(11)
        joined = "".join(self.vocabulary).encode()
        ends = np.cumsum([len(w.encode()) for w in self.vocabulary])
        hashes = self.hash.load(np.frombuffer(joined, np.uint8)).of(np.concatenate([[0], ends[:-1]]), ends)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words a text, text, word number in it, licence word) of a chunk; the last three for licence words only."""
        data = lower(data)
        start, end, text = words(data, offsets, GAP)
        count = np.bincount(text, minlength=len(offsets) - 1)
        hashes = self.hash.load(data).of(start, end)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        hit = np.flatnonzero(self.sorted[at] == hashes)
        before = np.cumsum(count) - count
        return count, text[hit], hit - before[text[hit]], self.order[at[hit]]


def frequencies(docs: DataFrame, index: Index) -> tuple[int, np.ndarray]:
    """(documents, documents that hold each licence word), over all of them; a row a batch and word is summed by Spark."""
    size = len(index.vocabulary)

    def count(batches):
        for batch in batches:
            total, rows = np.zeros(size + 1, np.int64), 0
            for _, data, offsets in chunks(batch.column(0)):
                _, text, _, word = index.read(data, offsets)
                total[:size] += np.bincount(np.unique(text * size + word) % size, minlength=size)
            total[size] = batch.num_rows
            held = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["word", "n"])

    got = dict(map(tuple, docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n")).collect()))   # a row a licence word
    return got.get(size, 0), np.array([got.get(i, 0) for i in range(size)], float)


def places(index: Index, weight: np.ndarray, k: int, at: np.ndarray, word: np.ndarray, rare: int = 6) -> list[tuple[int, float]]:
    """(place, score) of template ``k`` in a text whose licence words ``word`` stand at the ascending word numbers ``at``."""
    t, ids, postings = index.known[k], index.ids[k], index.postings[k]
    here = np.isin(word, list(postings))
    at, word = at[here], word[here]
    present = sorted(np.unique(word).tolist(), key=lambda w: (-weight[w], w))[:rare]        # the file's heaviest
    diagonal, vote = [], []
    for w in present:
        spots = at[word == w]
        for p in postings[w]:
            diagonal.append(spots - p)
            vote.append(np.full(len(spots), w))
    diagonal, vote = np.concatenate(diagonal), np.concatenate(vote)
    order = np.argsort(diagonal, kind="stable")
    diagonal, vote = diagonal[order], vote[order]
    first = np.unique(diagonal)
    low, high = np.searchsorted(diagonal, first), np.searchsorted(diagonal, first + t.slack, "right")
    need = len(present) if t.base else -(-len(present) * 3 // 4)
    agree = np.zeros(len(first), np.int64)
    for w in present:                                                                       # different words a window
        sums = np.concatenate([[0], np.cumsum(vote == w)])
        agree += sums[high] > sums[low]
    first = first[agree >= need]
    if not len(first):
        return []
    # the key phrases at their places: every word of one in a row
    number = np.full(int(at[-1]) + 2, -1)
    number[at] = word

    def stands(where: np.ndarray, w: int) -> np.ndarray:
        return (where >= 0) & (where < len(number)) & (number[np.clip(where, 0, len(number) - 1)] == w)

    good = np.ones(len(first), bool)
    for a, b in t.keys:
        found = np.zeros(len(first), bool)
        for shift in range(t.slack + 1):
            found |= np.all([stands(first + shift + p, ids[p]) for p in range(a, b)], axis=0)
        good &= found
    first = first[good]
    held = np.zeros(len(first))
    for p in range(len(ids)):
        held += weight[ids[p]] * np.any([stands(first + shift + p, ids[p]) for shift in range(t.slack + 1)], axis=0)
    return list(zip(np.maximum(first, 0).tolist(), np.minimum(held / weight[ids].sum(), 1.0).tolist()))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, found array<struct<label:string,place:long,score:double>>"


def licenses(docs: DataFrame, known: list[Template] | None = None, least: float = 0.6) -> DataFrame:
    """doc_id, n_words, the places of the base phrases (n_base, first_word, last_word), base_labels, labels, score, found.

    ``found`` has each label's best place and score; ``score`` is the best of them, 0 without any; templates other
    than base phrases need ``least``.  The counts of licence words and documents are the only thing that the driver sees.
    """
    index = Index(templates() if known is None else known)
    total, held = frequencies(docs, index)
    weight = np.log((1 + total) / (1 + held)) + 1e-3              # a word that all documents hold still counts a little
    size = len(index.vocabulary)

    def scan(batches):
        for batch in batches:
            ids = batch.column(0)
            for row, data, offsets in chunks(batch.column(1)):
                n = len(offsets) - 1
                count, text, at, word = index.read(data, offsets)
                present = np.zeros((n, size), bool)
                present[text, word] = True
                border = np.searchsorted(text, np.arange(n + 1))
                base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
                best: list[dict[str, tuple[float, int]]] = [{} for _ in range(n)]
                for k, t in enumerate(index.known):
                    for i in np.flatnonzero(present[:, index.musts[k]].all(axis=1)).tolist():
                        part = slice(border[i], border[i + 1])
                        got = places(index, weight, k, at[part], word[part])
                        if t.base:
                            base[i] += [(p, t.label) for p, _ in got]
                        for p, score in got:
                            if t.base or score >= least:
                                best[i][t.label] = max(best[i].get(t.label, (0.0, 0)), (score, -p))
                spots = [[p for p, _ in b] for b in base]
                columns = [ids.slice(row, n), pa.array(count, pa.int64()), pa.array([len(s) for s in spots], pa.int64()),
                           pa.array([min(s, default=None) for s in spots], pa.int64()), pa.array([max(s, default=None) for s in spots], pa.int64()),
                           pa.array([",".join(sorted({x for _, x in b})) for b in base], pa.string()), pa.array([",".join(sorted(b)) for b in best], pa.string()),
                           pa.array([max((s for s, _ in b.values()), default=0.0) for b in best], pa.float64()),
                           pa.array([[{"label": x, "place": -b[x][1], "score": b[x][0]} for x in sorted(b)] for b in best], found)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    found = pa.list_(pa.struct([("label", pa.string()), ("place", pa.int64()), ("score", pa.float64())]))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, SCHEMA)
