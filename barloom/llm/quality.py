"""Quality of texts by a factorisation machine.

A text's features: its words, hashed to ``2**bits`` places, by how often they stand there, scaled to length 1;
statistics of its structure (shares of letters, capitals, stops, signs, repeated words, lengths); and what is
known of the text as a whole (its size, lines, mean line).  The statistics enter as they are and as one of a
few ranges each, so that the machine can weigh a range by itself.  A score is linear in the features plus all
their pairwise products through vectors of ``rank`` numbers, computed in linear time:
sum over f of ((sum v_if x_i)**2 - sum (v_if x_i)**2) / 2.  Labels, lang, source and doc_id are no features.

The machine is fitted on at most ``sample`` labelled rows of at most ``most`` features (bounds; those of the smallest
hash of doc_id), whose features, not texts, go to the driver.  Scoring is one pass over whole texts.

Nulls: a null text is empty and scored like one; a null doc_id is scored and not held out; labels of null
quality or null doc_id are not used, of labels that share a doc_id the smallest counts.  Equal rows each get a
row.  Without labels of both kinds every score is next to the share of label 1, next to 1 without any.  Other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import RangeHash, chunks, lower, ragged, words
from .shared import cut

STATS = ("size", "words", "lines", "word length", "line length", "capitals", "small", "digits", "beyond ascii", "stops", "marks",
         "signs", "bars", "white", "different words", "same as before", "capital words", "signed words", "commonest")
CLASSES = {"capitals": range(65, 91), "small": range(97, 123), "digits": range(48, 58), "beyond ascii": range(128, 256), "stops": b".,;:",
           "marks": b"!?", "signs": b"#%&$*@^~", "bars": b"|", "white": b" \n\t\r\v\f"}


def class_tables() -> np.ndarray:
    out = np.zeros((len(CLASSES), 256), bool)
    for i, members in enumerate(CLASSES.values()):
        out[i, list(members)] = True
    return out


def features(data: np.ndarray, offsets: np.ndarray, bits: int, hasher: RangeHash, tables: np.ndarray):
    """((text, place, value) of the words, statistics as a row a text)."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    small = lower(data)
    start, end, doc = words(data, offsets)
    place = (hasher.load(small).of(start, end) >> np.uint64(64 - bits)).astype(np.int64)
    key, count = np.unique(doc << bits | place, return_counts=True)
    k_doc, k_place = key >> bits, key & (1 << bits) - 1
    length = np.sqrt(np.bincount(k_doc, count.astype(float) ** 2, n))
    n_words = np.bincount(doc, minlength=n).astype(float)
    per = lambda x, of: x / np.maximum(of, 1)

    def each(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    lines = each(data == 10) + (size > 0)
    shares = [per(each(t[data]), size) for t in tables]
    again = np.zeros(len(place), bool)
    again[1:] = (place[1:] == place[:-1]) & (doc[1:] == doc[:-1])
    first, last = (data[start], data[end - 1]) if len(start) else (data[:0], data[:0])
    capital = (first >= 65) & (first <= 90) & (last >= 65) & (last <= 90)
    signed = np.isin(last, np.frombuffer(b"#%&$*!@^~|", np.uint8))
    most = np.zeros(n)
    np.maximum.at(most, k_doc, count)
    stats = np.stack([np.log1p(size) / 10, np.log1p(n_words) / 10, np.log1p(lines) / 10, per(np.bincount(doc, (end - start).astype(float), n), n_words) / 10,
                      np.log1p(per(size, lines)) / 10, *shares, per(np.bincount(k_doc, minlength=n), n_words), per(np.bincount(doc, again, n), n_words),
                      per(np.bincount(doc, capital, n), n_words), per(np.bincount(doc, signed, n), n_words), per(most, n_words)], axis=1)
    return (k_doc, k_place, count / length[k_doc]), stats


def inputs(triples, stats: np.ndarray, edges: np.ndarray, bits: int):
    """All features as (text, place, value): words, then each statistic's value, then its range."""
    doc, place, value = triples
    n, k = stats.shape
    rows = np.repeat(np.arange(n), k)
    bins = np.stack([np.searchsorted(edges[j], stats[:, j]) for j in range(k)], axis=1) if n else np.zeros((0, k), int)
    ranges = (1 << bits) + k + np.arange(k) * (edges.shape[1] + 1) + bins
    return (np.concatenate([doc, rows, rows]), np.concatenate([place, np.tile((1 << bits) + np.arange(k), n), ranges.ravel()]).astype(np.int64),
            np.concatenate([value, stats.ravel(), np.full(n * k, 0.5)]))


def raw_scores(doc, place, value, n: int, bias: float, linear: np.ndarray, vectors: np.ndarray):
    """(score before the sigmoid, sums per text and factor)."""
    z = bias + np.bincount(doc, linear[place] * value, n)
    sums = np.zeros((n, vectors.shape[1]))
    for f in range(vectors.shape[1]):
        part = vectors[place, f] * value
        sums[:, f] = np.bincount(doc, part, n)
        z += 0.5 * (sums[:, f] ** 2 - np.bincount(doc, part ** 2, n))
    return z, sums


def fit(y: np.ndarray, at: np.ndarray, places: np.ndarray, values: np.ndarray, stats: np.ndarray, bits: int, rank: int, ranges: int = 8,
        epochs: int = 12, rate: float = 0.1, weight: float = 1e-5, seed: int = 1) -> dict:
    """Fit by stochastic gradients (a step size a parameter).  Row i has label y[i], words at[i] to at[i + 1] and stats[i]."""
    y = y.astype(float)
    model = {"bits": bits, "edges": np.zeros((len(STATS), ranges - 1)), "bias": float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))) if len(y) else 20.0}
    size = (1 << bits) + len(STATS) * (1 + ranges)
    model |= {"linear": np.zeros(size), "vectors": np.zeros((size, rank))}
    if len(np.unique(y)) < 2:
        return model
    model["edges"] = np.quantile(stats, np.arange(1, ranges) / ranges, axis=0).T.copy()
    rng = np.random.default_rng(seed)
    bias, linear, vectors = model["bias"], model["linear"], rng.normal(0, 0.02, (size, rank))
    seen_b, seen_l, seen_v = 1.0, np.ones(size), np.ones((size, rank))
    for _ in range(epochs):
        mixed = rng.permutation(len(y))
        for i in range(0, len(mixed), 128):
            batch = mixed[i:i + 128]
            length = at[batch + 1] - at[batch]
            pick = ragged(at[batch], length)
            d, p, x = inputs((np.repeat(np.arange(len(batch)), length), places[pick], values[pick]), stats[batch], model["edges"], bits)
            z, sums = raw_scores(d, p, x, len(batch), bias, linear, vectors)
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            here, which = np.unique(p, return_inverse=True)
            g = np.bincount(which, slope[d] * x, len(here)) + weight * linear[here]
            seen_l[here] += (g * len(batch)) ** 2
            linear[here] -= rate * g * len(batch) / np.sqrt(seen_l[here])
            for f in range(rank):
                g = np.bincount(which, slope[d] * x * (sums[d, f] - vectors[p, f] * x), len(here)) + weight * vectors[here, f]
                seen_v[here, f] += (g * len(batch)) ** 2
                vectors[here, f] -= rate * g * len(batch) / np.sqrt(seen_v[here, f])
            seen_b += (slope.sum() * len(batch)) ** 2
            bias -= rate * slope.sum() * len(batch) / np.sqrt(seen_b)
    return model | {"bias": float(bias), "linear": linear, "vectors": vectors}


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000, bits: int = 16, rank: int = 8, most: int = 8_000_000) -> dict:
    """The machine, from at most ``sample`` rows of ``labels`` (doc_id, quality) that are not held out.

    Of those, in order of their hash, as many as hold ``most`` features together: 8 bytes each are what the driver holds.
    """
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.min("quality").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def gather(batches):
        hasher, tables = RangeHash(3), class_tables()
        for b in batches:
            for row, data, offsets in chunks(b["text"]):
                (doc, place, value), stats = features(data, offsets, bits, hasher, tables)
                cuts = np.searchsorted(doc, np.arange(len(offsets))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    b["doc_id"].slice(row, len(stats)), b["_y"].slice(row, len(stats)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(place.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(value.astype(np.float32))),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, stats.shape[1], dtype=np.int32)), pa.array(stats.ravel()))],
                    names=["doc_id", "y", "places", "values", "stats"])

    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))        # of rows that share a doc_id
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_y").agg(one.alias("one"))
               .select("doc_id", F.col("_y").cast("int").alias("_y"), "one.text")
               .mapInArrow(gather, "doc_id long, y int, places array<int>, values array<float>, stats array<double>"))
    sizes = sorted((h, d, n) for h, d, n in rows.select(F.xxhash64("doc_id"), "doc_id", F.size("places")).collect())      # at most ``sample`` rows
    held = np.cumsum([n for *_, n in sizes]) <= most
    place_of = {d: i for i, (_, d, _) in enumerate(sizes[:int(held.sum())])}
    if not held.all():
        h, d, _ = sizes[max(len(place_of) - 1, 0)]
        here = F.xxhash64("doc_id")
        rows = rows.where(((here < h) | (here == h) & (F.col("doc_id") <= d)) if place_of else F.lit(False))
    table = rows.toArrow()
    order = np.argsort([place_of[d] for d in table.column("doc_id").to_pylist()])
    places, values = table.column("places").combine_chunks(), table.column("values").combine_chunks()
    y, stats = table.column("y").to_numpy()[order], table.column("stats").combine_chunks().flatten().to_numpy().reshape(-1, len(STATS))[order]
    borders = np.concatenate([[0], np.cumsum(places.value_lengths().to_numpy())])
    words_, weights = places.flatten().to_numpy(), values.flatten().to_numpy()
    length = np.diff(borders)[order]
    move = ragged(borders[:-1][order], length)
    words_, weights = words_[move], weights[move]
    del table, places, values, move
    return fit(y, np.concatenate([[0], np.cumsum(length)]), words_, weights, stats, bits, rank)


def scorer(model: dict):
    """A column function: score of a text.  Texts go to Python, only scores come back."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        hasher, tables = RangeHash(3), class_tables()
        out = np.zeros(len(texts))
        for row, data, offsets in chunks(texts):
            n = len(offsets) - 1
            z, _ = raw_scores(*inputs(*features(data, offsets, model["bits"], hasher, tables), model["edges"], model["bits"]),
                              n, model["bias"], model["linear"], model["vectors"])
            out[row:row + n] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return pa.array(out)

    return score


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    score = scorer(train(docs, labels, sample))
    return docs.select("doc_id", score("text").alias("score")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 8000) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more."""
    return docs.where(scorer(train(docs, labels, sample))("text") >= threshold)
