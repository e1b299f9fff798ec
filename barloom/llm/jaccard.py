"""Exact Jaccard join of word n-gram sets: rare n-grams find candidates, a prefix tree joins them.

1. Each text's set gets a 64-bit key; texts with one key (and size) are one class.  From here on classes are joined.
2. A global order of n-grams: some of them (by hash) first, the rare before the common, then the rest by hash.
   Two sets with similarity ``percent`` share one of their first n - ceil(percent n) + 1 in any such order.
   Most texts have enough n-grams that no other class has, so nothing of them is left here.  A quarter of all
   n-grams is enough to count for sets of over ``SMALL``; smaller sets have an order of their own, which counts
   all of theirs, and sets of a size that both kinds can be like are in both.
3. Classes that share such an n-gram form a candidate group (``components`` over stars, never pairs).  A passage
   that many texts hold chains them to groups that grow with the table, so groups are narrowed: what two sets
   share is at most what they share of the counted n-grams and all that the smaller rest could add.  Pairs for
   which that is too little are left out, by the n-grams that step 2 has kept and without the texts; what the
   other pairs join is a group.  A group too large for a task is cut into chunks here, each to meet each.
4. A group's sets, common n-grams first, go into a prefix tree.  A set walks down the tree; what it shares with
   a path is counted once for all sets below; a subtree is left when its lengths, or what remains of the set or
   of the path, cannot reach the overlap needed, or when all below is already known to be in its component.
5. A group larger than a task should hold is cut by hash into chunks; each meets chunk 0, and then only classes
   outside the group's largest component meet all others.  Links that join nothing new are not looked for.

Nulls: a null or empty text, or one without words, has an empty set and links with nothing.  A null doc_id never
names a component unless all of it is null.  Equal rows, or rows that share a doc_id, each get a row.  Long
texts are used whole.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import RangeHash, chunks, lower, mix, words
from .links import components
from .shared import cut, partitions, release

U = np.uint64
MULTIPLIERS = np.random.default_rng(29).integers(1, 2**62, 16, U) * U(2) + U(1)
NO_ID = 2**63 - 1
SHARE = 4            #: in the order of large sets, one in so many n-grams comes first and is counted
SMALL = 160          #: sets of up to so many n-grams meet in an order of their own


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int, hasher: RangeHash):
    """(text, hash) of the different n-grams of each text, by text, then hash; and the sets' sizes."""
    n = len(offsets) - 1
    start, end, doc = words(data, offsets)
    h = hasher.load(lower(data)).of(start, end)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    full = len(h) - width + 1
    grams, owner = np.zeros(0, U), np.zeros(0, np.int64)
    if full > 0:
        inside = doc[:full] == doc[width - 1:]
        total = sum(h[i:i + full] * MULTIPLIERS[i] for i in range(width))
        grams, owner = mix(total[inside]), doc[:full][inside]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        grams = np.concatenate([grams, [mix(np.array([sum((int(h[first[d] + i]) * int(MULTIPLIERS[i]) for i in range(count[d])), int(count[d])) % 2**64], U))[0]
                                        for d in short]]).astype(U)
        owner = np.concatenate([owner, short])
    order = np.argsort(grams)
    order = order[np.argsort(owner[order], kind="stable")]
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return owner, grams, np.bincount(owner, minlength=n)


def set_keys(owner: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A key for each set, the same for equal sets."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(grams ^ U(0x9E3779B97F4A7C15)), dtype=U)])
    ends = np.cumsum(sizes)
    return mix(sums[ends] - sums[ends - sizes] + sizes.astype(U)).view(np.int64)


def _keyed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n, counted (n-grams that the order of large sets counts), key of each text."""
    def run(batches):
        hasher = RangeHash(17)
        for b in batches:
            for row, data, offsets in chunks(b["text"]):
                owner, grams, sizes = shingle_sets(data, offsets, width, hasher)
                k = len(sizes)
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(row, k), b["text_hash"].slice(row, k), pa.array(sizes),
                                                  pa.array(np.bincount(owner[grams % U(SHARE) == 0], minlength=k)), pa.array(set_keys(owner, grams, sizes))],
                                                 names=["doc_id", "text_hash", "n", "counted", "key"])
    return docs.mapInArrow(run, "doc_id long, text_hash long, n long, counted long, key long")


def _leading(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """token, key, small, late: each class's counted n-grams, and (late) as many others as its prefix lacks."""
    def run(batches):
        hasher, seen = RangeHash(17), np.zeros(0, np.int64)
        for b in batches:
            for _, data, offsets in chunks(b["text"]):
                owner, grams, sizes = shingle_sets(data, offsets, width, hasher)
                keys = set_keys(owner, grams, sizes)
                _, where = np.unique(keys, return_index=True)
                once = np.zeros(len(keys), bool)
                once[where] = True
                once &= ~np.isin(keys, seen)                       # copies within the task add nothing
                seen = np.concatenate([seen, keys[once]])
                prefix = sizes - -(-percent * sizes // 100) + 1
                is_small = once & (sizes <= SMALL)
                is_large = once & (100 * sizes > percent * SMALL)
                counted = grams % U(SHARE) == 0
                n_counted = np.bincount(owner[counted], minlength=len(sizes))
                rest = np.flatnonzero(~counted)
                place = np.arange(len(rest)) - np.searchsorted(owner[rest], np.arange(len(sizes)))[owner[rest]]   # rank by hash in its set
                late = rest[(place < (prefix - n_counted)[owner[rest]]) & is_large[owner[rest]]]
                for pick, small, is_late in ((np.flatnonzero(is_small[owner]), True, False), (np.flatnonzero(counted & is_large[owner]), False, False), (late, False, True)):
                    for i in range(0, len(pick), 1 << 16):
                        p = pick[i:i + (1 << 16)]
                        token = grams[p] * U(3) + U(1) if small else grams[p]      # the two orders have nothing in common
                        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(keys[owner[p]]), pa.array(np.full(len(p), small)),
                                                          pa.array(np.full(len(p), is_late))], names=["token", "key", "small", "late"])
    return docs.select("text").mapInArrow(run, "token long, key long, small boolean, late boolean")


class Tree:
    """Prefix tree over sets given as rising arrays of small numbers."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        order = sorted((i for i in range(len(sets))), key=lambda i: sets[i].astype(">i4").tobytes())
        self.node: list[list] = []     # [from depth, to depth, a set below, children, leaves, least size, largest size, all one component]
        self.root = self._build(order)

    def _shared(self, a: int, b: int) -> int:
        x, y = self.sets[a], self.sets[b]
        k = min(len(x), len(y))
        differ = x[:k] != y[:k]
        at = int(differ.argmax()) if k else 0
        return at if k and differ[at] else k

    def _new(self, start: int, end: int, member: int) -> int:
        self.node.append([start, end, member, [], [], len(self.sets[member]), len(self.sets[member]), False])
        return len(self.node) - 1

    def _build(self, order: list[int]) -> int:
        root = self._new(0, 0, order[0])
        path, last = [root], None
        for i in order:
            depth = self._shared(last, i) if last is not None else 0
            child = None
            while self.node[path[-1]][1] > depth:
                child = path.pop()
            top = path[-1]
            if child is not None and self.node[top][1] < depth:      # cut the edge above child
                middle = self._new(self.node[top][1], depth, self.node[child][2])
                self.node[top][3][-1] = middle
                self.node[middle][3].append(child)
                self.node[child][0] = depth
                path.append(middle)
                top = middle
            if len(self.sets[i]) > self.node[top][1]:
                leaf = self._new(self.node[top][1], len(self.sets[i]), i)
                self.node[top][3].append(leaf)
                path.append(leaf)
                top = leaf
            self.node[top][4].append(i)
            last = i
        for k in self._after(root):
            node = self.node[k]
            sizes = [self.node[c][5] for c in node[3]] + [self.node[c][6] for c in node[3]] + [len(self.sets[i]) for i in node[4]]
            node[5], node[6] = min(sizes), max(sizes)
        return root

    def _after(self, root: int) -> list[int]:
        out, stack = [], [root]
        while stack:
            k = stack.pop()
            out.append(k)
            stack += self.node[k][3]
        return out[::-1]

    def join(self, sets: list[np.ndarray], ids: list[int], mine: list[int], n_tokens: int, percent: int, find, unite) -> None:
        """Unite ids of ``sets`` with ids ``mine`` of the tree's sets where they are similar enough."""
        held = np.zeros(n_tokens, bool)
        for x, me in zip(sets, ids):
            held[x] = True
            n = len(x)
            stack = [(self.root, 0)]
            while stack:
                k, shared = stack.pop()
                start, end, member, children, leaves, least, largest, one = self.node[k]
                if one and find(mine[self._any(k)]) == find(me):
                    continue
                if 100 * largest < percent * n or percent * least > 100 * n:
                    continue
                if end > start:
                    edge = self.sets[member][start:end]
                    shared += int(np.count_nonzero(held[edge]))
                    left = n - int(np.searchsorted(x, edge[-1], "right"))
                    need = -(-percent * (n + least) // (100 + percent))
                    if shared + min(left, largest - end) < need:
                        continue
                for i in leaves:
                    if 100 * shared >= percent * (n + len(self.sets[i]) - shared):
                        unite(me, mine[i])
                if not one and all(self.node[c][7] for c in children):
                    found = {find(mine[self._any(c)]) for c in children} | {find(mine[i]) for i in leaves}
                    self.node[k][7] = len(found) == 1
                stack += [(c, shared) for c in children]
            held[x] = False

    def _any(self, k: int) -> int:
        return self.node[k][2]


def join_group(keys: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between ``left`` and ``right`` members (flags; a member may be both), enough to join what is linked."""
    values, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(values), np.int32)
    place[np.argsort(-count, kind="stable")] = np.arange(len(values))
    ends = np.cumsum([len(s) for s in sets])
    coded = [np.sort(c) for c in np.split(place[which], ends[:-1])]
    parent = list(range(len(sets)))
    made: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def unite(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            parent[a] = b
            made.append((int(keys[i]), int(keys[j])))

    inner, outer = np.flatnonzero(right).tolist(), np.flatnonzero(left).tolist()
    if inner and outer:
        Tree([coded[i] for i in inner]).join([coded[i] for i in outer], outer, inner, len(values), percent, find, unite)
    return made


def _joined(rows: DataFrame, percent: int) -> DataFrame:
    """a, b of links.  ``rows``: group, task, key, left, right, grams."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("key")
        made = join_group(pdf["key"].to_numpy(), [np.frombuffer(g, U) for g in pdf["grams"]], pdf["left"].to_numpy(bool), pdf["right"].to_numpy(bool), percent)
        return pd.DataFrame(made, columns=["a", "b"], dtype="int64")
    # a group's tasks go to different places, also where the rows come dealt out by group
    return rows.repartition(partitions(rows.sparkSession), "group", "task").groupBy("group", "task").applyInPandas(run, "a long, b long")


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, task_grams: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Two texts link when 100 * intersection >= percent * union of their sets of ``width``-word n-grams.
    """
    keyed, named = _named(docs, width, percent, task_grams)
    return keyed.where("n > 0").join(named, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id") \
        .union(keyed.where("n = 0").select("doc_id", "n", "doc_id"))


def _named(docs: DataFrame, width: int, percent: int, task_grams: int) -> tuple[DataFrame, DataFrame]:
    """(a row a document: doc_id, text_hash, key, n; a row a set: key, whole (one number a component), component_id)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    keyed = cut(_keyed(plain, width))
    filled = keyed.where("n > 0")
    classes = cut(filled.groupBy("key").agg(F.max("n").alias("n"), F.max("counted").alias("counted"), F.min("doc_id").alias("least"),
                                            F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text_hash")).alias("one")))

    # n-grams that two classes have, and of those the ones in a class's prefix
    rows = _leading(plain.where("text IS NOT NULL"), width, percent).repartition("token")
    known = rows.groupBy("token").agg(F.count(F.lit(1)).alias("times"), F.min("key").alias("k0"), F.max("key").alias("k1"),
                                      F.min("small").alias("f0"), F.min("late").alias("f1"))
    # asking for the flags too lets the sum and the join read one shuffle
    shared = rows.join(known.where("k0 <> k1 AND f0 IS NOT NULL AND f1 IS NOT NULL").select("token", "times"), "token").dropDuplicates(["token", "key"])
    shared = cut(shared)
    del rows, known
    release(docs.sparkSession)
    prefixes = _prefixes(shared, classes, percent)

    # candidate groups
    first = prefixes.groupBy("token").agg(F.min("key").alias("first"))
    groups = components(prefixes.join(first, "token").select(F.col("key").alias("a"), F.col("first").alias("b"))) \
        .select(F.col("node").alias("key"), F.col("component").alias("group"))
    groups = components(cut(_near(_units(shared, groups, classes), percent, -(-task_grams // SHARE)))).select(F.col("node").alias("key"), F.col("component").alias("group"))
    del shared, prefixes, first
    release(docs.sparkSession)

    # their sets, from one text a class
    wanted = cut(groups.join(classes, "key").select("key", "group", "n", F.col("one.id").alias("_id"), F.col("one.text_hash").alias("text_hash")))
    chunks_of = wanted.groupBy("group").agg(F.ceil(F.sum("n") / task_grams).alias("chunks"))
    wanted = cut(wanted.join(chunks_of, "group").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks"))))
    texts = plain.withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID))).join(wanted, ["_id", "text_hash"])
    members = cut(_sets(texts.select("key", "group", "chunk", "chunks", "text"), width))
    del texts
    release(docs.sparkSession)
    links = _grouped_links(members, wanted, percent, task_grams)

    parts = components(links).select(F.col("node").alias("key"), F.col("component").alias("whole"))
    named = classes.join(parts, "key", "left").select("key", "least", F.coalesce("whole", "key").alias("whole"))
    names = named.groupBy("whole").agg(F.min("least").alias("component_id"))
    return keyed, named.join(names, "whole").select("key", "whole", "component_id")


def _prefixes(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """token, key of shared n-grams that stand in the class's prefix; those no other class has come before them."""
    one_class = Window.partitionBy("key", "small")                 # within one set
    early = shared.where(~F.col("late")).withColumn("rank", F.row_number().over(one_class.orderBy("times", "token"))) \
        .withColumn("n_shared", F.count(F.lit(1)).over(one_class)).join(classes.select("key", "n", "counted"), "key")
    prefix = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    return early.where(F.when(F.col("small"), F.col("n")).otherwise(F.col("counted")) - F.col("n_shared") + F.col("rank") <= prefix).select("token", "key") \
        .union(shared.where("late").select("token", "key"))


def _units(shared: DataFrame, groups: DataFrame, classes: DataFrame) -> DataFrame:
    """group, key, n, spare (n-grams that are not counted), tokens (shared ones) of each class in each order it is in."""
    small = F.col("small")
    of = groups.join(classes, "key").select("key", "group", "n", "counted")
    return shared.join(of, "key").groupBy("key", "small", "group", "n", "counted").agg(F.collect_list("token").alias("tokens")) \
        .select(F.when(small, F.bitwise_not("group")).otherwise(F.col("group")).alias("group"), "key", "n",
                F.when(small, 0).otherwise(F.col("n") - F.col("counted")).alias("spare"), "tokens")


def near_pairs(keys: np.ndarray, sets: list[np.ndarray], n: np.ndarray, spare: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of ``left`` and ``right`` members that may be similar enough, enough to join what such pairs join.

    ``sets``: counted n-grams of each member, of ``n`` that it has; ``spare`` of those are not counted.
    """
    inner = np.flatnonzero(right)
    tokens = np.concatenate([sets[i] for i in inner]) if len(inner) else np.zeros(0, np.int64)
    owner = np.repeat(inner, [len(sets[i]) for i in inner])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    part = np.arange(len(keys))
    made: list[tuple[int, int]] = []
    for i in np.flatnonzero(left).tolist():
        start = np.searchsorted(tokens, sets[i], "left")
        count = np.searchsorted(tokens, sets[i], "right") - start
        place = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
        common = np.bincount(owner[place], minlength=len(keys))
        j = np.flatnonzero(common)
        need = -(-percent * (n[i] + n[j]) // (100 + percent)) - np.minimum(spare[i], spare[j])
        j = j[(common[j] >= need) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (part[j] != part[i])]
        for k in j.tolist():
            if part[k] != part[i]:
                part[part == part[k]] = part[i]
                made.append((int(keys[i]), int(keys[k])))
    return made


def _near(units: DataFrame, percent: int, task_tokens: int) -> DataFrame:
    """a, b of pairs that join all members of a group between which a link can be."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = near_pairs(pdf["key"].to_numpy(), [np.asarray(t) for t in pdf["tokens"]], pdf["n"].to_numpy(), pdf["spare"].to_numpy(),
                          pdf["left"].to_numpy(bool), pdf["right"].to_numpy(bool), percent)
        return pd.DataFrame(made, columns=["a", "b"], dtype="int64")
    units = cut(units)
    chunks_of = units.groupBy("group").agg(F.ceil(F.sum(F.size("tokens")) / task_tokens).alias("chunks"))
    dealt = units.join(chunks_of, "group").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks"))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    rows = dealt.select("group", (low * F.col("chunks") + high).alias("task"), "key", "n", "spare", (F.col("chunk") == low).alias("left"),
                        (F.col("chunk") == high).alias("right"), "tokens")
    return rows.repartition(partitions(rows.sparkSession), "group", "task").groupBy("group", "task").applyInPandas(run, "a long, b long")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """key, group, chunk, chunks, grams (64-bit hashes, packed) of texts that have the key of their class."""
    def run(batches):
        hasher = RangeHash(17)
        for b in batches:
            for row, data, offsets in chunks(b["text"]):
                owner, grams, sizes = shingle_sets(data, offsets, width, hasher)
                ends, same = np.cumsum(sizes), set_keys(owner, grams, sizes) == b["key"].slice(row, len(sizes)).to_numpy()
                packed = [grams[e - k:e].tobytes() for e, k in zip(ends.tolist(), sizes.tolist())]
                names = ["key", "group", "chunk", "chunks"]
                out = pa.RecordBatch.from_arrays([*(b[c].slice(row, len(sizes)) for c in names), pa.array(packed, pa.binary())], names=[*names, "grams"])
                yield out.filter(pa.array(same))
    return texts.mapInArrow(run, "key long, group long, chunk long, chunks long, grams binary")


def _grouped_links(rows: DataFrame, wanted: DataFrame, percent: int, task_grams: int) -> DataFrame:
    """Links (a, b) that join all that is linked within each group of ``rows``; ``wanted`` is the same without sets."""
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    first = rows.withColumn("task", F.explode(F.when(F.col("chunk") == 0, everywhere).otherwise(F.array("chunk"))))
    flags = [(F.col("chunk") == F.col("task")).alias("left"), F.lit(True).alias("right")]
    links = cut(_joined(first.select("group", "task", "key", *flags, "grams"), percent))

    large = rows.where("chunks > 1")
    parts = components(links).withColumnRenamed("node", "key")
    whole = wanted.where("chunks > 1").select("group", "key", "chunk", "n").join(parts, "key", "left").withColumn("component", F.coalesce("component", "key"))
    sizes = whole.groupBy("group", "component").agg(F.count(F.lit(1)).alias("size"))
    most = sizes.groupBy("group").agg(F.max(F.struct("size", "component")).alias("m")).select("group", F.col("m.component").alias("most"))
    rest = cut(whole.join(most, "group").where("component <> most").select("group", "key", "chunk", "n"))
    if rest.isEmpty():
        return links
    slices = rest.groupBy("group").agg(F.ceil(F.sum("n") / task_grams).alias("slices"))
    mine = rest.join(slices, "group").select("key", F.pmod(F.xxhash64("key", F.lit(1)), F.col("slices")).alias("slice"))
    every = large.join(slices, "group").join(mine, "key", "left")
    # a task is (slice, chunk): the slice's rows as left, the chunk's as right; a row of both is sent once
    as_right = every.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).select(
        "group", (F.col("s") * F.col("chunks") + F.col("chunk")).alias("task"), "key",
        F.coalesce(F.col("slice") == F.col("s"), F.lit(False)).alias("left"), F.lit(True).alias("right"), "grams")
    as_left = every.where("slice IS NOT NULL").withColumn("c", F.explode(everywhere)).where("c <> chunk").select(
        "group", (F.col("slice") * F.col("chunks") + F.col("c")).alias("task"), "key", F.lit(True).alias("left"), F.lit(False).alias("right"), "grams")
    return links.union(cut(_joined(as_right.union(as_left), percent)))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, task_grams: int = 1_000_000) -> DataFrame:
    """One row of each component of ``docs``, with all its columns; rows without words all stay.

    The row with the least doc_id stays (nulls last), of several the one with the least hash of the text, of equal
    ones any one.
    """
    keyed, named = _named(docs, width, percent, task_grams)
    counts = cut(keyed.where("n > 0").groupBy("key", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies")).join(named.select("key", "whole"), "key"))
    del keyed, named
    release(docs.sparkSession)
    first = counts.groupBy("whole").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one"))
    stays = (F.col("one.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("one.text_hash") == F.col("text_hash"))
    # what happens to rows: 0 they go, 1 one of several equal ones stays; others are not in this table
    fates = counts.join(first, "whole").withColumn("fate", F.when(~stays, 0).when(F.col("copies") > 1, 1)).where("fate IS NOT NULL") \
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.max("fate").alias("_fate"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").cast("long").alias("_id0"), F.xxhash64("text").alias("_hash0"))
    rows = rows.join(fates, F.col("_id0").eqNullSafe(F.col("_id")) & (F.col("_hash0") == F.col("_hash")), "left")
    kept = rows.where("_fate IS NULL").select("_doc").union(rows.where("_fate = 1").groupBy("_id0", "_hash0").agg(F.first("_doc").alias("_doc")).select("_doc"))
    return kept.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
