"""Mix sources to target weights, with DataFrame functions only.

The words of a source stand one after another, in an order drawn from doc_id, cut into blocks of ``block``
words.  A source gets so many slots of the output that its words come to its target; the slots of all sources
are dealt out to output shards by one pseudorandom permutation, so the sources' counts of a shard are
multinomial draws, given that the totals are kept.  Slot k of a source is block p(k mod n) of its n blocks,
where p is a permutation of its own for every pass k div n.  So a block is taken equally often, or once more,
and never over ``limit`` times.  Blocks meet slots by a join on (source, block).

Permutations are computed for an index alone ("swap or not": a few rounds that exchange x with key - x or
don't, by a hash of the larger), so no source is sorted or gathered.  A source's running count of words is
made in buckets of doc_id first, then over the buckets; a source with a third of all rows is many groups.

Nulls: a null text has no words; a null source is a source, the last; doc_id may be null.  Equal rows each
count.  No rows give no rows; sources without words have target 0.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, partitions

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 8


def permuted(index: Column, n: Column, *seed: Column) -> Column:
    """A pseudorandom permutation of 0 to n - 1 at ``index``; another one for each seed."""
    def exchange(x: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(i, *seed), n) - x, n)
        swap = F.xxhash64(F.lit("swap"), i, F.greatest(x, other), *seed).bitwiseAND(1) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), index, exchange)


def targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), limit: float = 3) -> DataFrame:
    """A row a source: _s, source_size, target.  ``sized`` has _s, source, size.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes; what is over
    ``limit`` times a source's size is shared anew, until none is above.  That ends at the level x where
    min(x * weight, limit * size) adds up to the sum, found by one pass over sources in order of limit / weight.
    """
    sums = sized.groupBy("_s").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())            # a row a source
    ranked = sums.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.lit(float(limit)) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    # from the first source on whose limit is not reached, the level is that source's
    ranked = ranked.withColumn("_level", level).withColumn("_free", F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")))
    settled = F.first("_free", ignorenulls=True).over(Window.orderBy("_ratio", F.col("source").asc_nulls_last())
                                                      .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.select("_s", "source_size", F.coalesce(F.least(settled * F.col("_w"), "_cap"), "_cap").alias("target"))


def streams(docs: DataFrame, rows_per_bucket: int = 20_000) -> DataFrame:
    """Documents with ``size`` and ``first``, the place of their first word in their source's stream.

    Columns: _row (monotonically_increasing_id of ``docs``), doc_id, source, _s, size, first.
    """
    sized = cut(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                            F.xxhash64("doc_id", "text").alias("_tie"), F.monotonically_increasing_id().alias("_row")))
    sized = sized.withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")))
    buckets = max(1, -(-sized.count() // rows_per_bucket))
    sized = sized.withColumn("_b", F.pmod("_tie", F.lit(buckets)))
    base = sized.groupBy("_s", "_b").agg(F.sum("size").alias("_n"))
    base = base.select("_s", "_b", F.coalesce(F.sum("_n").over(
        Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_s", "_b").orderBy("_tie", "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base, ["_s", "_b"])
    return placed.withColumn("first", F.col("_base") + F.col("_inner")).drop("_b", "_tie", "_base", "_inner")


def slots(sources: DataFrame, block: int = 32, limit: int = 3, shard_slots: int = 65_536) -> DataFrame:
    """The mix: a row a slot with _s, shard, position in it, and the source's block there."""
    counted = sources.where("source_size > 0").withColumn("_n", F.ceil(F.col("source_size") / block)) \
        .withColumn("_slots", F.least(F.round(F.col("target") / F.col("source_size") * F.col("_n")).cast("long"), F.col("_n") * limit))
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = counted.withColumn("_base", F.coalesce(F.sum("_slots").over(before), F.lit(0))).withColumn("_all", F.sum("_slots").over(every)).where("_slots > 0")
    step = 4096
    made = counted.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_slots") - 1) / step)))) \
        .repartition(partitions(sources.sparkSession), "_s", "_c") \
        .withColumn("_k", F.explode(F.sequence(F.col("_c") * step, F.least((F.col("_c") + 1) * step, "_slots") - 1)))
    made = made.withColumn("block", permuted(F.pmod("_k", F.col("_n")), F.col("_n"), F.col("_s"), F.floor(F.col("_k") / F.col("_n")))) \
        .withColumn("_at", permuted(F.col("_base") + F.col("_k"), F.col("_all"), F.lit("shards")))
    return made.select("_s", F.floor(F.col("_at") / shard_slots).alias("shard"), F.pmod("_at", F.lit(shard_slots)).alias("position"), "block")


def shares(placed: DataFrame, block: int = 32) -> DataFrame:
    """A row for each document and block of its words: _row, _s, size, block, from, n_words (places within the document)."""
    last = F.floor((F.col("first") + F.col("size") - 1) / block)
    rows = placed.where("size > 0").select("_row", "_s", "first", "size",
                                           F.explode(F.sequence(F.floor(F.col("first") / block), last)).alias("block"))
    start = F.greatest(F.col("block") * block, "first")
    return rows.select("_row", "_s", "size", "block", (start - F.col("first")).alias("from"),
                       (F.least((F.col("block") + 1) * block, F.col("first") + F.col("size")) - start).alias("n_words"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), limit: int = 3, block: int = 32) -> DataFrame:
    """``docs`` (doc_id, source, text) with doc_id, size, source_size, target, taken."""
    placed = streams(docs)
    sources = targets(placed, weights, limit)
    times = slots(sources, block, limit).groupBy("_s", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = shares(placed, block).join(times, ["_s", "block"]).groupBy("_row").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
    return placed.join(sources, "_s").join(taken, "_row", "left") \
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), limit: int = 3, block: int = 32) -> DataFrame:
    """The mix as documents, with all columns of ``docs``: copy c holds the words taken c times or more.

    A document whose words are all taken equally often is repeated as it is; one without a taken word goes.
    ``n_chars`` follows the text, where there is such a column.  Texts meet what is taken of them by their row
    number, so ``docs`` must be a table read from files, whose rows come in the same order each time.
    """
    placed = streams(docs)
    sources = targets(placed, weights, limit)
    times = slots(sources, block, limit).groupBy("_s", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = shares(placed, block).join(times, ["_s", "block"]).groupBy("_row").agg(
        F.sum("n_words").alias("_some"), F.max("size").alias("_size"), F.min("times").alias("_least"), F.max("times").alias("_most"),
        F.sort_array(F.collect_list(F.struct("from", "n_words", "times"))).alias("_shares"))     # within one text
    even = (F.col("_some") == F.col("_size")) & (F.col("_least") == F.col("_most"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.monotonically_increasing_id().alias("_row")) \
        .join(taken, "_row").withColumn("_words", F.when(~even, F.regexp_extract_all("_doc.text", F.lit(WORD), F.lit(0)))) \
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_most")))
    part = F.array_join(F.flatten(F.transform(F.filter("_shares", lambda x: x["times"] >= F.col("_copy")),
                                              lambda x: F.slice("_words", (x["from"] + 1).cast("int"), x["n_words"].cast("int")))), " ")
    whole = (F.col("_some") == F.col("_size")) & (F.col("_least") >= F.col("_copy"))
    rows = rows.withColumn("_text", F.when(whole, F.col("_doc.text")).otherwise(part))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])
