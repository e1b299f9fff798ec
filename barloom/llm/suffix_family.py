"""Repeated byte strings, found with a logarithmic family of sparse suffix arrays.

What is removed: each byte covered by a ``length``-byte string that also starts earlier.

*Suffixes.*  Of every ``length`` bytes the suffix at the least hashed 24-byte string is kept (about one in 39);
equal strings keep equal suffixes.  A suffix stands for the strings that chose it: ``n`` neighbouring starts
from ``p`` on.  It is filed under ``h``, the hash of its first 24 bytes, and ``c``, the hash of all bytes those
strings cover, so suffixes with equal (h, c) stand for the same strings in the same places.

*Family.*  Documents come in batches by doc_id.  A batch's suffix array is a table sorted and bucketed by h.
It is merged with each level of the family in one pass without a shuffle: where a level, or an earlier row of
the batch, has (h, c), all its strings start earlier.  Where only h is there, the strings are compared one by
one (below).  The first of each (h, c) becomes a level of its own, and two levels of equal size merge into
one of twice the size, by a merge join of their buckets, so a suffix is rewritten once for each doubling.

*Single strings.*  Only suffixes whose h recurs with other surroundings (the rims of repeated passages) are
taken apart.  Their bytes are cut out of the texts and meet by h, where the strings of a group are compared
by 128-bit hashes; all but the first of each start later.  A group of over ``group_rows`` suffixes is not
held in one task: its strings go on one by one and are summed up by hash.

Repeats inside a chunk of texts, such as one word over and over, are folded into ranges before anything is
shuffled.  A suffix that a third of all documents hold is a few rows a document of about eighty.

Nulls: a null text is empty; a null doc_id comes last.  Rows that share doc_id are ordered by a 31-bit hash of
their texts; rows that share both count as one document, and each gets its result.  Texts under ``length``
bytes keep all.  Long texts are worked through in overlapping segments, with the same result.  Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytetext import RangeHash, chunks, mix, ragged
from .shared import new_folder, partitions, shared_folder

U = np.uint64
NO_ID = 2**63 - 1
GRAM = 24
SEGMENT = 4 << 20
SUFFIX = "h long, c long, doc long, tie int, p int, n int"
PLACE = ["doc", "tie", "p"]


def keyed(docs: DataFrame) -> DataFrame:
    """doc, tie, text: what orders documents.  The tie is 0 throughout where no doc_id is repeated."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")
    unique = docs.select(doc).groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    tie = F.lit(0) if unique else F.shiftrightunsigned(F.xxhash64("text"), 33).cast("int")
    return docs.select(doc, tie.alias("tie"), F.coalesce("text", F.lit("")).alias("text"))


def segments(column: pa.Array, length: int):
    """(first row, bytes, borders, place of the first byte in its text): whole texts, or overlapping parts of a long one."""
    for row, data, offsets in chunks(column, min(SEGMENT, 1 << 20)):
        if len(data) <= SEGMENT:
            yield row, data, offsets, 0
        else:                                              # one long text
            for at in range(0, len(data) - length + 1, SEGMENT):
                part = data[at:at + SEGMENT + length - 1]
                yield row, part, np.array([0, len(part)]), at


def suffixes(data: np.ndarray, offsets: np.ndarray, length: int, grams: RangeHash, whole: RangeHash):
    """(text, p, n, h, c) of the suffixes kept; p within the text."""
    window = length - GRAM + 1
    n_starts = len(data) - length + 1
    if n_starts < 1:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
    h = grams.load(data).windows(GRAM)
    low, step = (h >> U(28) << U(28)) | np.arange(len(h), dtype=U), 1
    while step * 2 <= window:                              # least of each ``window`` neighbours, the left one of ties
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[:n_starts], low[window - step:window - step + n_starts])
    anchor = (low & U((1 << 28) - 1)).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(n_starts), "right") - 1
    valid = np.arange(n_starts) + length <= offsets[text + 1]
    start = np.flatnonzero(valid)
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
    new = np.ones(len(start), bool)
    new[1:] = (anchor[start[1:]] != anchor[start[:-1]]) | (text[start[1:]] != text[start[:-1]])
    first = start[new]
    n = np.diff(np.append(np.flatnonzero(new), len(start)))
    a = anchor[first]
    c = mix(whole.load(data).of(first, first + n + length - 1) ^ mix(((a - first) * 256 + n).astype(U)))
    return text[first], first - offsets[text[first]], n, h[a], c


def suffix_rows(docs: DataFrame, length: int) -> DataFrame:
    """Suffixes of ``docs`` (doc, tie, text).  Rows with n < 0 are ranges of -n starts already known to repeat."""
    def run(batches):
        grams, whole = RangeHash(41), RangeHash(43)
        for b in batches:
            doc_id, tie_of = b["doc"].to_numpy(), b["tie"].to_numpy()
            for row, data, offsets, at in segments(b["text"], length):
                text, p, n, h, c = suffixes(data, offsets, length, grams, whole)
                doc, tie, p = doc_id[row + text], tie_of[row + text], p + at
                order = np.lexsort((p, tie, doc, c, h))
                doc, tie, p, n, h, c = (x[order] for x in (doc, tie, p, n, h, c))
                same = np.zeros(len(h), bool)
                same[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
                lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
                later = (doc != doc[lead]) | (tie != tie[lead]) | (p != p[lead])
                out = [[x[~later] for x in (h, c, doc, tie, p, n)]]
                if later.any():                            # neighbouring ranges of one text become one
                    d, t, q, k = (x[later] for x in (doc, tie, p, n))
                    order = np.lexsort((q, t, d))
                    d, t, q, k = (x[order] for x in (d, t, q, k))
                    new = np.ones(len(d), bool)
                    new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (q[1:] > q[:-1] + k[:-1])
                    i = np.flatnonzero(new)
                    last = np.append(i[1:], len(d)) - 1
                    spread = mix(mix(d[i].astype(U)) + q[i].astype(U))
                    out.append([spread, spread, d[i], t[i], q[i], -(q[last] + k[last] - q[i])])
                h, c, doc, tie, p, n = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(doc), pa.array(tie.astype(np.int32)),
                                                  pa.array(p.astype(np.int32)), pa.array(n.astype(np.int32))], names=["h", "c", "doc", "tie", "p", "n"])
    return docs.mapInArrow(run, SUFFIX)


class SuffixFamily:
    """Levels of suffix arrays; ``add`` takes batches in rising order of documents.

    Levels are tables in a database of the shared folder, ``close`` drops them.  What was found is kept in two
    folders of files there: ``covered`` (doc, tie, p, n: n starts from p on repeat) and ``open`` (h besides: to be
    compared).
    """

    def __init__(self, spark: SparkSession, length: int = 100):
        self.spark, self.length, self.buckets = spark, length, partitions(spark)
        self.base = f"suffixes_{uuid.uuid4().hex[:12]}"
        spark.sql(f"CREATE DATABASE {self.base} LOCATION '{shared_folder(spark).rstrip('/')}/{self.base}'")
        self.levels: list[tuple[int, str]] = []            # (batches in it, table), large to small
        self.covered, self.open = new_folder(spark, "covered"), new_folder(spark, "open")
        self.made = 0

    def _save(self, rows: DataFrame) -> str:
        self.made += 1
        name = f"{self.base}.t{self.made}"
        # tables bucketed by h may meet on (h, c) where they lie; Spark's default deals both out anew by all join keys
        conf, key = self.spark.conf, "spark.sql.requireAllClusterKeysForCoPartition"
        before = conf.get(key, "true")
        conf.set(key, "false")
        try:
            rows.write.bucketBy(self.buckets, "h").sortBy("h", "c", *PLACE).saveAsTable(name)
        finally:
            conf.set(key, before)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")

    def add(self, docs: DataFrame) -> None:
        """Scan a batch (doc, tie, text) against the levels and take it in; levels of equal size merge before that."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            self._merge()
        array = self._save(suffix_rows(docs, self.length).repartition(self.buckets, "h").sortWithinPartitions("h", "c", *PLACE))
        rows = self.spark.table(array)
        rows.where("n < 0").select(*PLACE, (-F.col("n")).alias("n")).write.mode("append").parquet(self.covered)
        rows = rows.where("n > 0")
        kind = Window.partitionBy("h", "c").orderBy(*PLACE)
        rows = rows.withColumn("later", F.rank().over(kind) > 1)
        near = Window.partitionBy("h")
        rows = rows.withColumn("others", F.min("c").over(near) != F.max("c").over(near))
        for i, (_, level) in enumerate(self.levels):
            held = self.spark.table(level)
            rows = rows.join(held.select("h", "c", F.lit(True).alias(f"hit{i}")).hint("merge"), ["h", "c"], "left")
            rows = rows.join(held.groupBy("h").agg(F.lit(True).alias(f"near{i}")).hint("merge"), "h", "left")
        none = F.lit(False)
        hit = F.coalesce(*[F.when(F.col(f"hit{i}"), True) for i in range(len(self.levels))], none)
        close = F.coalesce(*[F.when(F.col(f"near{i}"), True) for i in range(len(self.levels))], none)
        repeats = F.col("later") | hit
        rows = rows.select("h", "c", *PLACE, "n", F.when(repeats, 0).when(F.col("others") | close, 1).otherwise(2).alias("state"))
        scanned = self._save(rows)                          # in the buckets of its array; no shuffle
        self._drop(array)
        scan = self.spark.table(scanned)
        scan.where("state = 0").select(*PLACE, "n").write.mode("append").parquet(self.covered)
        scan.where("state = 1").select("h", *PLACE, "n").write.mode("append").parquet(self.open)
        asked = scan.where("state = 1").select("h").distinct()
        for _, level in self.levels:
            self.spark.table(level).join(asked.hint("merge"), "h", "left_semi").select("h", *PLACE, "n").write.mode("append").parquet(self.open)
        level = self._save(scan.where("state > 0").drop("state"))
        self._drop(scanned)
        self.levels.append((1, level))

    def _merge(self) -> None:
        """The two smallest levels as one: a merge join of their buckets; no (h, c) is in both."""
        (size, b), (_, a) = self.levels.pop(), self.levels.pop()
        x, y = self.spark.table(a), self.spark.table(b)
        y = y.select("h", "c", *[F.col(v).alias(f"{v}2") for v in (*PLACE, "n")])
        both = x.join(y.hint("merge"), ["h", "c"], "full")
        table = self._save(both.select("h", "c", *[F.coalesce(v, f"{v}2").alias(v) for v in (*PLACE, "n")]))
        self._drop(a)
        self._drop(b)
        self.levels.append((2 * size, table))

    def close(self) -> None:
        self.spark.sql(f"DROP DATABASE {self.base} CASCADE")
        self.levels = []


def _ranges(folder: DataFrame, *more: str) -> DataFrame:
    """A row a document: doc, tie, at (sorted array of p, n), within one text."""
    return folder.groupBy("doc", "tie").agg(F.sort_array(F.collect_set(F.struct("p", "n", *more))).alias("at"))


def surroundings(docs: DataFrame, opened: DataFrame, length: int) -> DataFrame:
    """h, doc, tie, p, n, bytes of the suffixes in ``opened``: all bytes their strings cover."""
    def run(batches):
        for b in batches:
            for i in range(0, len(b), 256):
                rows = []
                part = b.slice(i, 256)
                for doc, tie, text, at in zip(*(part.column(c).to_pylist() for c in ("doc", "tie", "text", "at"))):
                    raw = text.encode()
                    rows += [(r["h"], doc, tie, r["p"], r["n"], raw[r["p"]:r["p"] + r["n"] + length - 1]) for r in at]
                for k in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows[k:k + 4096]), types)], names=["h", "doc", "tie", "p", "n", "bytes"])

    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return docs.join(_ranges(opened, "h"), ["doc", "tie"]).mapInArrow(run, "h long, doc long, tie int, p int, n int, bytes binary")


def compared(rows: DataFrame, length: int, group_rows: int = 20_000) -> DataFrame:
    """Strings of ``rows`` (surroundings) that start earlier as well: doc, tie, p, and repeats = true.

    Strings of groups over ``group_rows`` come with repeats null and their hashes x, y, for ``summed``.
    """
    def strings(table: pa.Table, one: RangeHash, two: RangeHash):
        column = table["bytes"].combine_chunks()
        size = pa.compute.binary_length(column).to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
        first, n = np.cumsum(size) - size, table["n"].to_numpy().astype(np.int64)
        s, row = ragged(first, n), np.repeat(np.arange(len(n)), n)
        one.load(data)
        two.load(data)
        place = table["p"].to_numpy()[row] + (s - first[row])
        return one.of(s, s + length), two.of(s, s + length), table["h"].to_numpy()[row], table["doc"].to_numpy()[row], table["tie"].to_numpy()[row], place

    def batch(x, y, doc, tie, p, repeats):
        for i in range(0, len(p), 1 << 16):
            j = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(x[j].view(np.int64)), pa.array(y[j].view(np.int64)), pa.array(doc[j]), pa.array(tie[j]), pa.array(p[j].astype(np.int32)),
                                              pa.array([repeats] * len(p[j]), pa.bool_())], names=["x", "y", "doc", "tie", "p", "repeats"])

    def run(batches):
        import pyarrow.compute  # noqa: F401
        one, two = RangeHash(47), RangeHash(53)

        def settle(table: pa.Table):
            """Whole groups: all but the first of each string."""
            for i, k in cuts(table["h"].to_numpy()):
                x, y, h, doc, tie, p = strings(table.slice(i, k), one, two)
                order = np.lexsort((p, tie, doc, y, x, h))
                same = np.zeros(len(order), bool)
                same[1:] = np.logical_and.reduce([v[order[1:]] == v[order[:-1]] for v in (h, x, y)])
                lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
                later = np.logical_or.reduce([v[order] != v[order[lead]] for v in (doc, tie, p)])
                pick = order[later]
                yield from batch(x[pick], y[pick], doc[pick], tie[pick], p[pick], True)

        def cuts(h: np.ndarray, rows_: int = 8192):
            """(from, how many) of runs of whole groups."""
            ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
            at = 0
            while at < len(h):
                end = int(ends[min(np.searchsorted(ends, at + rows_), len(ends) - 1)])
                yield at, end - at
                at = end

        held, large = None, None                           # rows of the last h; the h that is too large to hold
        for b in batches:
            table = pa.Table.from_batches([b])
            if large is not None:
                h = table["h"].to_numpy()
                k = int(np.searchsorted(h != large, True)) if (h != large).any() else len(h)
                for i in range(0, k, 8192):
                    x, y, _, doc, tie, p = strings(table.slice(i, min(8192, k - i)), one, two)
                    yield from batch(x, y, doc, tie, p, None)
                table = table.slice(k)
                if not len(table):
                    continue
                large = None
            table = table if held is None else pa.concat_tables([held, table])
            h = table["h"].to_numpy()
            k = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
            yield from settle(table.slice(0, k))
            held = table.slice(k)
            if len(held) > group_rows:
                large = int(h[-1])
                for i in range(0, len(held), 8192):
                    x, y, _, doc, tie, p = strings(held.slice(i, 8192), one, two)
                    yield from batch(x, y, doc, tie, p, None)
                held = None
        if held is not None and len(held):
            yield from settle(held)

    return rows.repartition(partitions(rows.sparkSession), "h").sortWithinPartitions("h").mapInArrow(
        run, "x long, y long, doc long, tie int, p int, repeats boolean")


def summed(strings: DataFrame) -> DataFrame:
    """doc, tie, p of all but the first of each string (x, y, doc, tie, p)."""
    first = strings.groupBy("x", "y").agg(F.min(F.struct(*PLACE)).alias("first"))
    return strings.join(first, ["x", "y"]).where(F.struct(*PLACE) > F.col("first")).select(*PLACE)


def kept_bytes(text: bytes, ranges, length: int) -> tuple[bytes, int]:
    """(what stays, number of removed runs) of a text, given ranges (p, n) of repeated starts."""
    if not ranges:
        return text, 0
    out, end, runs, at = [], -1, 0, 0
    for r in ranges:                                       # sorted by p
        p, stop = r["p"], r["p"] + r["n"] + length - 1
        if p > end:
            runs += 1
            out.append(text[at:p])
        end = max(end, stop)
        at = max(at, stop)
    return b"".join(out) + text[at:], runs


def deduplicated(docs: DataFrame, length: int = 100, batches: int = 4, with_text: bool = False, group_rows: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept (bytes)] of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    plain = keyed(docs)
    family = SuffixFamily(spark, length)
    borders = plain.where(F.col("doc") != NO_ID).approxQuantile("doc", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    borders = sorted({int(b) for b in borders or []})
    for low, high in zip([None, *borders], [*borders, None]):
        part = plain if low is None else plain.where(F.col("doc") > low)
        family.add(part if high is None else part.where(F.col("doc") <= high))
    family.close()
    place = "doc long, tie int, p int, n int"
    opened, covered = spark.read.schema(f"h long, {place}").parquet(family.open), spark.read.schema(place).parquet(family.covered)
    folder = new_folder(spark, "strings")
    compared(surroundings(plain, opened, length), length, group_rows).write.parquet(folder)
    strings = spark.read.schema("x long, y long, doc long, tie int, p int, repeats boolean").parquet(folder)
    single = strings.where("repeats").select(*PLACE).union(summed(strings.where("repeats IS NULL")))
    every = _ranges(covered.union(single.withColumn("n", F.lit(1))))

    def finish(batches_):
        for b in batches_:
            for i in range(0, len(b), 64):
                rows = []
                part = b.slice(i, 64)
                for doc, text, at in zip(*(part.column(c).to_pylist() for c in ("doc", "text", "at"))):
                    raw = text.encode()
                    kept, runs = kept_bytes(raw, at, length)
                    rows.append((None if doc == NO_ID else doc, len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)

    types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    return plain.join(every, ["doc", "tie"], "left").mapInArrow(
        finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
