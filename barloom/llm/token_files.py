"""Token ids in Arrow stream-format files of equal-length sequences and masks.

A file holds the texts of one range of doc_id.  Their ids stand one after another, cut into sequences of
``length`` ids; a batch is two fixed-size-list columns, ``ids`` and ``mask`` (false: padding, only behind a
file's last id).  So sequence i of a file lies at a known place, and a mapped file gives it as a numpy view
without a copy.  A second stream beside it, the index, has (doc_id, start, n_tokens) in the file's own count.
The global place of an id is the file's first id, from the table of files, plus its place there.

Files are written under a name of the attempt and then renamed, so a repeated or lost task leaves whole
files only, with the same content.

Nulls: a null text is empty and has the end id alone; a null doc_id comes last.  Rows that share a doc_id
follow each other in the order of a hash of their texts.  An empty table gives no files and no rows.  Other columns are
not read.  Texts are never cut: a long one runs over as many sequences as it needs.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, new_folder, partitions
from .tokens import encoder

FILES = T.StructType([T.StructField("file", T.StringType()), T.StructField("index", T.StringType()),
                      T.StructField("part", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])


def _place(path: str):
    """(file system, path in it) of a path or URI; each executor opens it with its own libraries."""
    import pyarrow.fs
    if ":" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def _write(filesystem, path: str, schema: pa.Schema, batches) -> None:
    """Write a stream under a name of this attempt, then give it its own."""
    draft = f"{path}.{uuid.uuid4().hex[:8]}"
    with filesystem.open_output_stream(draft) as out, pa.ipc.new_stream(out, schema) as stream:
        for batch in batches:
            stream.write_batch(batch)
    filesystem.move(draft, path)


def sequences(ids: np.ndarray, length: int, kind: pa.DataType) -> pa.RecordBatch:
    """Ids as a batch of equal-length sequences and masks; the last one is padded with 0."""
    full = np.zeros(-(-len(ids) // length) * length, kind.to_pandas_dtype())
    full[:len(ids)] = ids
    mask = np.arange(len(full)) < len(ids)
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(full, kind), length),
                                       pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], names=["ids", "mask"])


def token_files(docs: DataFrame, folder: str, vocabulary: str, length: int = 1024, end_id: int = 2,
                batch: int = 1024, small_ids: bool = True) -> DataFrame:
    """Write ``docs`` (doc_id, text) and return the table of files: file, index, part, n_docs, n_tokens, first.

    ``small_ids``: 16 bits an id, for vocabularies below 65,536; ``batch``: sequences in a batch.
    """
    spark = docs.sparkSession
    kind = pa.uint16() if small_ids else pa.int32()
    schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
    index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        filesystem, base = _place(folder)
        filesystem.create_dir(base, recursive=True)
        known = encoder(vocabulary)
        index, total = [], 0

        def stream():
            nonlocal total
            held, n_held = [], 0
            for b in batches:
                doc_id = b.column(0)
                for row, ids, borders in known.encode_column(b.column(1)):
                    n = len(borders) - 1
                    borders = borders + np.arange(n + 1)              # one end id after each text
                    full = np.full(borders[-1], end_id, ids.dtype)
                    inner = np.ones(len(full), bool)
                    inner[borders[1:] - 1] = False
                    full[inner] = ids
                    index.append(pa.RecordBatch.from_arrays(
                        [doc_id.slice(row, n), pa.array(borders[:-1] + total), pa.array(np.diff(borders))], schema=index_schema))
                    total += len(full)
                    held.append(full)
                    n_held += len(full)
                    while n_held >= length * batch:
                        all_ids = np.concatenate(held)
                        yield sequences(all_ids[:length * batch], length, kind)
                        held = [all_ids[length * batch:]]
                        n_held = len(held[0])
            if n_held:
                yield sequences(np.concatenate(held), length, kind)

        name = f"{base}/part-{part:06d}"
        _write(filesystem, f"{name}.arrows", schema, stream())
        _write(filesystem, f"{name}.index.arrows", index_schema, index)
        if index:
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/part-{part:06d}.arrows"], "index": [f"{folder}/part-{part:06d}.index.arrows"],
                                              "part": [part], "n_docs": [sum(map(len, index))], "n_tokens": [total]})

    ordered = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    dealt = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
             .repartitionByRange(partitions(spark), *ordered).sortWithinPartitions(*ordered))
    files = cut(dealt.mapInArrow(write, FILES))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)       # a row a file
    return files.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Sequences:
    """Random access to one file: ``ids(i)`` and ``mask(i)``, ``span(a, b)`` for ids a to b of the file.

    A local path is mapped, and ids are views of the map; other stores are read into memory once.
    """

    def __init__(self, path: str):
        filesystem, inner = _place(path)
        source = pa.memory_map(inner) if filesystem.type_name == "local" else pa.BufferReader(filesystem.open_input_file(inner).read())
        self.batches = list(pa.ipc.open_stream(source))
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 0
        self.first = np.concatenate([[0], np.cumsum([len(b) for b in self.batches])])

    def __len__(self) -> int:
        return int(self.first[-1])

    def _at(self, i: int) -> tuple[pa.RecordBatch, int]:
        k = int(np.searchsorted(self.first, i, "right")) - 1
        return self.batches[k], i - int(self.first[k])

    def ids(self, i: int) -> np.ndarray:
        batch, j = self._at(i)
        return batch["ids"].values.to_numpy(zero_copy_only=True)[j * self.length:(j + 1) * self.length]

    def mask(self, i: int) -> np.ndarray:
        batch, j = self._at(i)
        return batch["mask"].values[j * self.length:(j + 1) * self.length].to_numpy(zero_copy_only=False)

    def span(self, start: int, end: int) -> np.ndarray:
        step = self.length * len(self.batches[0]) if self.batches else 1   # all batches but the last are of one size
        pieces = [b["ids"].values.to_numpy(zero_copy_only=True)[max(0, start - k * step):max(0, end - k * step)]
                  for k, b in list(enumerate(self.batches))[start // step:max(start, end - 1) // step + 1]]
        return pieces[0] if len(pieces) == 1 else np.concatenate(pieces)


def read_documents(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of its ids as 32-bit integers)."""

    def read(batches):
        for b in batches:
            for file, index, first in zip(*(b.column(c).to_pylist() for c in ("file", "index", "first"))):
                ids = Sequences(file)
                filesystem, inner = _place(index)
                with filesystem.open_input_stream(inner) as source:
                    for docs in pa.ipc.open_stream(source):
                        start, n = docs["start"].to_numpy(), docs["n_tokens"].to_numpy()
                        crc = [zlib.crc32(ids.span(s, s + k).astype("<u4").tobytes()) for s, k in zip(start.tolist(), n.tolist())]
                        yield pa.RecordBatch.from_arrays([docs["doc_id"], pa.array(start + first), docs["n_tokens"], pa.array(crc, pa.int64())],
                                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = files.sparkSession
    return (files.repartition(partitions(spark), "part")
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def encode_and_read(spark: SparkSession, docs: DataFrame, vocabulary: str, length: int = 1024) -> DataFrame:
    """Write the files into a new shared folder and read the documents back."""
    return read_documents(token_files(docs, new_folder(spark, "tokens"), vocabulary, length))
