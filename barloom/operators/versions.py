"""Result tables under versions: several tables change together or not at all, and loads touch only what they hold.

A cell is what one partition value (a day, say) or one hash bucket of the key holds of a table.  A load writes the
cells that it changes to a new folder and then publishes the next manifest, which names the folders of every cell of
every table with their row counts.  Until then readers see the last version, so a load that fails leaves all tables
as they were, and one that is tried again is the same load.  Coverage, retention and differences between two
versions are answered by manifests: they list cells (a row for each), rows are read only in cells that changed.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import merge_fill_blanks, merge_upsert, missing_rows

MANIFEST = "table_name string, cell string, folder string, n_rows long"
CELL = "_cell"


def by_days(column: str) -> Column:
    """Cells of a table that is replaced and kept by day (or any other partition value)."""
    return F.coalesce(F.col(column).cast("string"), F.lit("none"))


def by_key(keys: Sequence[str], buckets: int = 16) -> Column:
    """Cells of a table that is merged by key."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")


class Conflict(RuntimeError):
    """Another load has published this version."""


class Versions:
    """The tables below ``root`` at their newest version, or at ``version``."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root = spark, root
        self.version = max(self._published(), default=0) if version is None else version

    # ------------------------------------------------------------ files
    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _published(self) -> list[int]:
        path, fs = self._path("manifests")
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]

    def manifest(self) -> DataFrame:
        """A row for each folder of each cell; its size is that of a partition list."""
        if not self.version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/v{self.version:08d}")

    def _read(self, folders: DataFrame, schema: T.StructType) -> DataFrame:
        """Rows in ``folders`` of the manifest, with their cell."""
        full = T.StructType([*schema.fields, T.StructField(CELL, T.StringType())])
        paths = sorted(f"{self.root}/data/{r.folder}/{CELL}={r.cell}" for r in folders.select("folder", "cell").distinct().collect())
        if not paths:
            return self.spark.createDataFrame([], full)
        cell = F.regexp_extract(F.col("_metadata.file_path"), f"/{CELL}=([^/]*)/", 1)
        return self.spark.read.schema(schema).parquet(*paths).withColumn(CELL, cell)

    def table(self, name: str, schema: T.StructType) -> DataFrame:
        """The whole table at this version."""
        return self._read(self.manifest().where(F.col("table_name") == name), schema).drop(CELL)

    def load(self) -> Load:
        return Load(self)

    # ------------------------------------------------------------ what manifests answer
    def coverage(self) -> DataFrame:
        """table_name, cell, n_rows: no row of a table is read."""
        return self.manifest().groupBy("table_name", "cell").agg(F.sum("n_rows").alias("n_rows"))

    def changes(self, other: int, name: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
        """Rows that differ between version ``other`` and this one: change, keys, before, after.

        Only folders that one of the two has and the other hasn't are read.  Keys are unique in both.
        """
        old, new = Versions(self.spark, self.root, other), self
        a, b = (v.manifest().where(F.col("table_name") == name) for v in (old, new))
        gone, come = (x.join(y, ["cell", "folder"], "left_anti") for x, y in ((a, b), (b, a)))
        row = F.struct(*[F.col(c) for c in schema.names])
        before = self._read(gone, schema).select(*keys, row.alias("before"))
        after = self._read(come, schema).select(*keys, row.alias("after"))
        change = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
        return (before.join(after, list(keys), "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
                .select(change.alias("change"), *keys, "before", "after"))


class Load:
    """Changes to tables that are published together by ``commit``."""

    def __init__(self, base: Versions):
        self.base, self.spark = base, base.spark
        self.id = uuid.uuid4().hex[:12]
        self.dropped: dict[str, DataFrame] = {}
        self.added: list[str] = []

    def _write(self, name: str, rows: DataFrame, cell: Column) -> None:
        folder = f"{name}/{self.id}-{len(self.added)}"
        # small cells share a task, a cell that is too large for one is split
        rows.withColumn(CELL, cell).hint("rebalance", CELL).write.partitionBy(CELL).parquet(f"{self.base.root}/data/{folder}")
        self.added.append(folder)

    def _drop(self, name: str, cells: DataFrame) -> None:
        if name in self.dropped:
            raise ValueError(f"{name} is changed twice in one load")
        self.dropped[name] = cells.select("cell").distinct()

    def replace_days(self, name: str, rows: DataFrame, day: str, days: Sequence | None = None) -> None:
        """The days in ``rows`` (or ``days``, which also empties days without rows) hold exactly ``rows``."""
        cell = by_days(day)
        cells = rows.select(cell.alias("cell")) if days is None else self.spark.createDataFrame([(str(d),) for d in days], "cell string")
        self._drop(name, cells)
        self._write(name, rows if days is None else rows.where(cell.isin([str(d) for d in days])), cell)

    def replace_table(self, name: str, rows: DataFrame, cell: Column) -> None:
        self._drop(name, self.base.manifest().where(F.col("table_name") == name))
        self._write(name, rows, cell)

    def _merged(self, name: str, rows: DataFrame, keys: Sequence[str], buckets: int, merge) -> None:
        """Cells that hold a key of ``rows`` are read, merged and written again; others are not looked at."""
        from ..session import cut_lineage
        rows, cell = cut_lineage(rows), by_key(keys, buckets)
        cells = cut_lineage(rows.select(cell.alias("cell")).distinct())                 # ``buckets`` at most
        here = self.base.manifest().where(F.col("table_name") == name).join(cells, "cell", "left_semi")
        stored = self.base._read(here, rows.schema).drop(CELL)
        self._drop(name, cells)
        self._write(name, merge(stored, rows), cell)

    def upsert(self, name: str, rows: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int = 16) -> None:
        """Last writer wins: of rows of one key in the load the one that is last by ``order``, over the stored one."""
        self._merged(name, last_by(rows, keys, order), keys, buckets, lambda old, new: merge_upsert(old, new, keys))

    def fill_blanks(self, name: str, rows: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str], buckets: int = 16) -> None:
        """Stored fields stay unless they are empty; of several rows of a key the last by ``order`` fills."""
        self._merged(name, last_by(rows, keys, order).select(*keys, *columns), keys, buckets, lambda old, new: merge_fill_blanks(old, new, keys, columns))

    def insert_missing(self, name: str, rows: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int = 16) -> None:
        """Keys that are not stored yet; a second row of a key in the load is not inserted either."""
        self._merged(name, last_by(rows, keys, order), keys, buckets, lambda old, new: old.unionByName(missing_rows(old, new, keys)))

    def retain(self, name: str, days: int, today: Column) -> None:
        """Forget days before ``today`` less ``days``; no row is read or written."""
        old = self.base.manifest().where((F.col("table_name") == name) & (F.col("cell").try_cast("date") < F.date_sub(today, days)))
        self._drop(name, old)

    def commit(self) -> Versions:
        """Publish the next version; ``Conflict`` if another load was faster (this one can be made again)."""
        kept = self.base.manifest()
        for name, cells in self.dropped.items():
            kept = kept.join(cells.withColumn("table_name", F.lit(name)), ["table_name", "cell"], "left_anti")
        rows = kept.select("table_name", "cell", "folder", "n_rows")
        for folder in self.added:
            files = self.spark.read.schema("none int").option("recursiveFileLookup", True).parquet(f"{self.base.root}/data/{folder}")
            cell = F.regexp_extract(F.col("_metadata.file_path"), f"/{CELL}=([^/]*)/", 1)
            counts = files.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n_rows"))
            rows = rows.unionByName(counts.select(F.lit(folder.split("/")[0]).alias("table_name"), "cell", F.lit(folder).alias("folder"), "n_rows"))
        version = self.base.version + 1
        draft, fs = self.base._path(f"manifests/draft-{self.id}")
        final, _ = self.base._path(f"manifests/v{version:08d}")
        rows.coalesce(1).write.parquet(f"{self.base.root}/manifests/draft-{self.id}")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, True)
            raise Conflict(f"version {version} of {self.base.root} exists")
        return Versions(self.spark, self.base.root, version)


def last_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: the last by ``order``; rows that share that too go by all their columns."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("_r")))
    return rows.groupBy(*keys).agg(best.alias("_b")).select(*[F.col(c) if c in keys else F.col(f"_b._r.{c}").alias(c) for c in rows.columns])


def pending(store: Versions, wanted: dict[str, DataFrame], day: str, share: float = 0.95) -> DataFrame:
    """Days of a batch that are not covered: some table lacks ``share`` of the rows that the batch has for the day, or has none.

    The batch is counted by day, the store answers from its manifest.
    """
    counts = None
    for name, rows in wanted.items():
        one = rows.groupBy(by_days(day).alias("cell")).agg(F.count(F.lit(1)).alias("want")).withColumn("table_name", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    have = store.coverage()
    return (counts.join(have, ["table_name", "cell"], "left")
            .groupBy("cell").agg(F.bool_and(F.coalesce("n_rows", F.lit(0)) >= F.greatest(F.floor(F.col("want") * share), F.lit(1))).alias("done"))
            .where(~F.col("done")).select("cell"))


def store_run(store: Versions, growing: dict[str, DataFrame], replaced: dict[str, DataFrame], day: str, keys: Sequence[str]) -> Versions:
    """Store an analysis: of the days not covered yet, missing rows of ``growing`` tables and all of ``replaced`` ones.

    Days that are covered are skipped; all tables change in one version.
    """
    from ..session import cut_lineage
    todo = cut_lineage(pending(store, growing, day))
    if todo.isEmpty():
        return store
    load = store.load()
    cell = by_days(day)

    def mine(rows):
        return rows.withColumn("_c", cell).join(todo.withColumnRenamed("cell", "_c"), "_c", "left_semi").select(*rows.columns)

    for name, rows in growing.items():
        here = store.manifest().where(F.col("table_name") == name).join(todo, "cell", "left_semi")
        old = store._read(here, rows.schema).drop(CELL)
        load._drop(name, todo)
        load._write(name, old.unionByName(missing_rows(old, mine(rows), keys)), cell)
    for name, rows in replaced.items():
        load._drop(name, todo)
        load._write(name, mine(rows), cell)
    return load.commit()
