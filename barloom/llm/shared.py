"""Shared folder, checkpoints and numbering of rows for the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a session that names none (tests) gets a folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return folder or context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Compute once and keep in the shared folder, where a lost executor does not matter."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that nothing uses any more.

    Its cleaner does that when the driver collects garbage, by itself every ``spark.cleaner.periodicGC.interval``;
    here a large shuffle is over and the next one is about to be written.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in ``order`` over the whole table, without one task or one key for all rows.

    Rows are dealt out by ranges of the order, kept, and counted; only one count a partition meets in one place.
    """
    spark = df.sparkSession
    kept = cut(df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
               .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted(tuple(r) for r in kept.groupBy(part.alias("p")).count().collect())   # a row a partition
    before, starts = 0, {}
    for p, n in counts:
        starts[p], before = before, before + n
    if not starts:
        return kept.withColumn(name, F.lit(0).cast("long")).drop("_at")
    table = F.create_map(*[F.lit(x).cast("long") for kv in starts.items() for x in kv])
    return kept.withColumn(name, F.element_at(table, part) + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")
