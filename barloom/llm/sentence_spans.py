"""Repeated runs of sentences: every run of ``span`` neighbouring sentences is hashed, equal runs meet in one
join, and sentences covered by a run that is not the first of its kind go.

A sentence ends at a stop, an exclamation or question mark, a line feed, or after ``words`` words, so that a long
sentence is several.  Sentences are compared without the white space around them.  The first of equal runs is
that of the smallest doc_id, then the smallest place.  What stays is joined as it stood.

Pieces of a sentence of over ``words`` words are counted from its start, so a passage inside such sentences meets its
equal only at the same offset, and text without stops and blanks is one piece a line.  ``loose`` finds these passages
too (see loose_spans) and removes them, in part of a sentence if need be.  The SQL does not have it.

Nulls: a null text is empty; a null doc_id comes last.  A text with fewer sentences than ``span`` has no run and
stays.  Rows that share doc_id are ordered by a hash of their texts, rows that share both count as one document
and each gets its result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .loose_spans import loose_repeats
from .suffix_family import NO_ID, keyed

WHITE = r"[ \t\n\r\f\x0B]"


def sentence_pattern(words: int) -> str:
    """Up to ``words`` words, of which only the last may end a sentence or a line; white space before the first and behind."""
    solid, blank = r"[^ \t\n\r\f\x0B]", r"[ \t]+"
    return rf"{WHITE}*(?:{solid}*[^ \t\n\r\f\x0B.!?]{blank}){{0,{words - 1}}}{solid}+{WHITE}*"


def runs(docs: DataFrame, span: int, words: int) -> DataFrame:
    """doc, tie, lengths (of the sentences, in characters), i (from 0), x, y: a row a run."""
    split = docs.select("doc", "tie", F.explode(F.array(F.regexp_extract_all("text", F.lit(sentence_pattern(words)), F.lit(0)))).alias("s"))
    hashed = split.where(F.size("s") >= span).select("doc", "tie", F.explode(F.array(F.transform(
        "s", lambda t: F.xxhash64(F.regexp_replace(t, rf"^{WHITE}+|{WHITE}+$", ""))))).alias("h"))
    pick = lambda i: [F.element_at("h", (i + k).cast("int")) for k in range(1, span + 1)]
    return hashed.select("doc", "tie", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("h") - span), lambda i: F.struct(
        F.xxhash64(*pick(i)).alias("x"), F.xxhash64(F.lit("y"), *pick(i)).alias("y")))).alias("i", "r")).select("doc", "tie", "i", "r.x", "r.y")


def repeated(docs: DataFrame, span: int = 3, words: int = 12) -> DataFrame:
    """doc, tie, i of all runs but the first of each kind.  One shuffle serves the sum and the join."""
    every = runs(docs, span, words).repartition("x")
    first = every.groupBy("x", "y").agg(F.min(F.struct("doc", "tie", "i")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return every.join(first, ["x", "y"]).where(F.struct("doc", "tie", "i") > F.col("first")).select("doc", "tie", "i")


def without_repeats(docs: DataFrame, span: int = 3, words: int = 12, loose: bool = False) -> DataFrame:
    """doc_id, n_sentences, n_removed, kept_sha256, kept of every row of ``docs`` (doc_id, text).

    With ``loose``, n_removed counts sentences that lose anything.
    """
    plain = keyed(docs)
    found = repeated(plain, span, words)
    if loose:
        found = found.select("doc", "tie", "i", F.lit(None).cast("int").alias("end")).unionByName(
            loose_repeats(plain, span, words).withColumnRenamed("start", "i"))
    gone = found.groupBy("doc", "tie").agg(                                                         # within one text
        F.array_sort(F.collect_set(F.when(F.col("end").isNull(), F.col("i")) if loose else F.col("i"))).alias("runs"),
        *([F.collect_set(F.when(F.col("end").isNotNull(), F.struct("i", "end"))).alias("loose")] if loose else []))

    def finish(batches):
        for b in batches:
            for at in range(0, len(b), 256):
                rows = []
                part = b.slice(at, 256)
                for doc, text, lengths, starts, *more in zip(*(part.column(c).to_pylist() for c in columns)):
                    kept, removed = text, 0
                    if more and more[0]:
                        kept, removed = without(text, lengths, {i + k for i in starts for k in range(span)}, more[0])
                    elif starts:
                        drop = {i + k for i in starts for k in range(span)}
                        pieces, place = [], 0
                        for i, n in enumerate(lengths):
                            if i not in drop:
                                pieces.append(text[place:place + n])
                            place += n
                        kept, removed = "".join(pieces), len(drop)
                    rows.append((None if doc == NO_ID else doc, len(lengths), removed, hashlib.sha256(kept.encode()).hexdigest(), kept))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)

    columns = ["doc", "text", "lengths", "runs", *(["loose"] if loose else [])]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_sentences", "n_removed", "kept_sha256", "kept"]
    lengths = F.transform(F.regexp_extract_all("text", F.lit(sentence_pattern(words)), F.lit(0)), lambda t: F.length(t))
    return plain.join(gone, ["doc", "tie"], "left").withColumn("lengths", lengths).select(*columns).mapInArrow(
        finish, "doc_id long, n_sentences long, n_removed long, kept_sha256 string, kept string")


def without(text: str, lengths: list[int], drop: set[int], ranges: list[dict]) -> tuple[str, int]:
    """(text without the sentences ``drop`` and the byte ranges, number of sentences that lose anything)."""
    stay = np.ones(len(text.encode()), bool)
    for r in ranges:
        stay[r["i"]:r["end"]] = False
    raw = np.frombuffer(text.encode(), np.uint8)
    stay = stay[(raw & 0xC0) != 0x80]                      # by character
    place = np.concatenate([[0], np.cumsum(lengths)])
    for i in drop:
        stay[place[i]:place[i + 1]] = False
    lost = np.concatenate([[0], np.cumsum(~stay)])[place]
    border = np.flatnonzero(np.diff(np.concatenate([[False], stay, [False]]).astype(np.int8)))
    return "".join(text[a:b] for a, b in zip(border[::2].tolist(), border[1::2].tolist())), int((np.diff(lost) > 0).sum())


def spans_sql(span: int = 3, words: int = 12) -> str:
    """The same over ``documents`` in SQL, for texts that begin with a sentence and doc_ids that do not repeat."""
    pattern = sentence_pattern(words).replace("'", "''")
    run = " || chr(1) || ".join(f"regexp_replace(s[i + {k}], '^{WHITE}+|{WHITE}+$', '', 'g')" for k in range(span))
    return f"""
WITH split AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{pattern}') AS s FROM documents),
runs AS (SELECT doc_id, i, {run} AS k FROM (SELECT doc_id, s, unnest(range(1, len(s) - {span - 2})) AS i FROM split)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM runs) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, (SELECT unnest(range({span})) AS k)),
pieces AS (SELECT split.doc_id, i, s[i] AS t FROM split, unnest(range(1, len(s) + 1)) AS u(i)),
kept AS (SELECT doc_id, string_agg(t, '' ORDER BY i) AS kept FROM pieces ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
count_gone AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN coalesce(n, 0) = 0 THEN coalesce(text, '') ELSE coalesce(kept, '') END) AS kept_sha256,
  CASE WHEN coalesce(n, 0) = 0 THEN coalesce(text, '') ELSE coalesce(kept, '') END AS kept
FROM split LEFT JOIN kept USING (doc_id) LEFT JOIN count_gone USING (doc_id)"""
