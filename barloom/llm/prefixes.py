"""Prefix trie of conversations by collapse of whole sequences.

A node is the sequence of the first turns (role, text) of a conversation.  Every turn is a digest; a node's key is
the digest of its parent's key and its turn's digest, made along each conversation in a sorted stream.  Identical
conversations are collapsed to one weighted sequence with the list of its ends; only sequences go on, each by its
smallest conversation.  A sequence whose key is some other's inner node is a proper prefix and is dropped by an
anti-join; the others are the leaves.  Prefixes of sequences are then summed by key with their weights.

Sums over subtrees need no pairs of node and descendant.  Over the members of a node, words from its depth on are
a difference of running sums of a sequence, times its weight.  Each node once: a node belongs to its smallest
member, and what a member owns is the end of its sequence, so that is a difference of running sums too.

The list of ends goes to SHA-256 in ascending order: ids are dealt out by ranges, joined to strings of some
thousand ids, and only those strings meet in the task of their node.  Key digests are 126 bits of a SHA-256; two
sequences that share one would be taken as equal.  The rows of one conversation are chained in one task, as
digests (a digest depends on the one before), in memory that does not grow with it.

Nulls: a null role or text is empty; null turns come first; rows without conv_id belong to no conversation and are
left out.  Rows that share a turn go by their digest.  Repeated rows are turns of their own.  An empty table gives an
empty one.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, partitions

ROOT = (0, 0)
PATH = "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, words long, before long, last boolean"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, n (1, 2, ... by turn), digest, words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), words.cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.select("conv_id", F.row_number().over(order).alias("n"), "digest", "words")


def heads(conv: Column) -> Column:
    """Turns that a conversation takes over from the first of its twenty."""
    return F.crc32(conv.cast("string").cast("binary")) % 4


def rebuilt(rows: DataFrame) -> DataFrame:
    """PATH: every rebuilt conversation's nodes with keys, words of the last turn, words before it; ``last`` at its end."""
    group = lambda c: c - c % 20
    first = rows.where((F.col("conv_id") % 20 == 0) & (F.col("n") <= 3)).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("n", "digest", "words"))).alias("taken")).withColumnRenamed("conv_id", "base")          # three at most
    start = rows.where("n = 1").select("conv_id", group(F.col("conv_id")).alias("base")).join(first, "base", "left").select(
        "conv_id", F.lit(0).alias("n"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"),
        F.filter("taken", lambda t: t["n"] <= heads(F.col("conv_id"))).alias("taken"))
    own = rows.where(F.col("n") > heads(F.col("conv_id"))).withColumn("taken", F.lit(None).cast(start.schema["taken"].dataType))
    return start.unionByName(own).repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "n").mapInArrow(_chained, PATH)


def _chained(batches):
    names = [c.split()[0] for c in PATH.split(", ")]
    types = [pa.int64()] * 8 + [pa.bool_()]
    rows, wait = [], None

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, types)], names=names)

    key = ROOT
    depth = before = 0
    for batch in batches:
        for conv, digest, words, taken in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "digest", "words", "taken"))):
            if digest is None:                                   # a conversation begins
                if wait:
                    rows.append((*wait, True))
                key, depth, before = ROOT, 0, 0
                wait = (conv, 0, *ROOT, None, None, 0, 0)
                steps = [(t["digest"], t["words"]) for t in taken or []]
            else:
                steps = [(digest, words)]
            for d, w in steps:
                rows.append((*wait, False))
                parent, depth = key, depth + 1
                h = hashlib.sha256(parent[0].to_bytes(8, "little") + parent[1].to_bytes(8, "little") + d).digest()
                key = int.from_bytes(h[:8], "little") >> 1, int.from_bytes(h[8:16], "little") >> 1
                wait = (conv, depth, *key, *parent, w, before)
                before += w
            if len(rows) >= 10_000:
                yield out()
                rows = []
    if wait:
        rows.append((*wait, True))
    yield out()


def end_hashes(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of (k1, k2, conv_id): SHA-256 of the ids of each key, ascending, joined by commas."""
    tasks = partitions(ends.sparkSession)

    def runs(batch, columns):
        cols = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in columns]
        if not len(cols[0]):
            return cols, []
        border = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
        return cols, zip([0, *border.tolist()], [*border.tolist(), len(cols[0])])

    def joined(batches):
        for batch in batches:
            (k1, k2, conv), parts = runs(batch, ("k1", "k2", "conv_id"))
            got = [(k1[a], k2[a], conv[a], ",".join(map(str, conv[a:b].tolist()))) for a, b in parts]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                             names=["k1", "k2", "conv_id", "ids"])

    def hashed(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for k1, k2, ids in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k1", "k2", "ids"))):
                if (k1, k2) == key:
                    state.update(("," + ids).encode())
                    continue
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(ids.encode())
            yield out(done)
        if key:
            yield out([(*key, state.hexdigest())])

    def out(done):
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "ends_sha256"])

    strings = ends.repartitionByRange(tasks, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(joined, "k1 long, k2 long, conv_id long, ids string")
    return strings.repartition(tasks, "k1", "k2").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = cut(rebuilt(cut(turns(conversations))))
    ends = paths.where("last").select("k1", "k2", "conv_id", (F.col("before") + F.col("words")).alias("total"))
    sequences = ends.groupBy("k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.max("total").alias("total"))
    chosen = paths.join(sequences.select("conv_id", "weight", "total"), "conv_id")                  # one conversation of each sequence
    chosen = cut(chosen)
    inner = chosen.where("p1 is not null").select(F.col("p1").alias("k1"), F.col("p2").alias("k2")).distinct()
    leaves = sequences.join(inner, ["k1", "k2"], "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    rest = F.col("total") - F.col("before")                                                         # words from this turn to the end
    rows = chosen.join(leaves, "conv_id", "left")
    nodes = cut(rows.groupBy("k1", "k2", "p1", "p2", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.sum(F.col("weight") * rest).alias("every")))
    own = nodes.groupBy("conv_id").agg(F.min("depth").alias("from"))
    # words of nodes owned, from this depth on: all of them where the sequence owns this node, else those behind its first own one
    begin = chosen.join(own, (chosen["conv_id"] == own["conv_id"]) & (chosen["depth"] == own["from"])).select(chosen["conv_id"], "from", rest.alias("owned"))
    once = chosen.join(begin, "conv_id").groupBy("k1", "k2").agg(F.sum(F.when(F.col("depth") >= F.col("from"), rest).otherwise(F.col("owned"))).alias("once"))
    children = nodes.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    # a node that isn't the first its conversation owns has its parent there too: only first ones ask
    nodes = nodes.join(own, "conv_id")
    asked = nodes.where("depth = from and p1 is not null").select("k1", "k2", "p1", "p2", (F.col("k1") % 64).alias("salt"))
    # a parent that very many ask is fetched once for each salt, and its askers meet in as many tasks
    asked = asked.join(asked.select("p1", "p2", "salt").distinct().join(parents, ["p1", "p2"]), ["p1", "p2", "salt"]).select("k1", "k2", "parent_conv_id")
    out = nodes.join(once, ["k1", "k2"], "left").join(children, ["k1", "k2"], "left").join(asked, ["k1", "k2"], "left") \
        .join(end_hashes(ends.select("k1", "k2", "conv_id")), ["k1", "k2"], "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        (F.col("every") - F.coalesce("once", F.lit(0))).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
