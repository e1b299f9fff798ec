"""Result tables: idempotent loads, upserts, audits, coverage and serving queries.

A table is a folder of Parquet files partitioned by one or more columns.  Every write
replaces whole partitions (dynamic partition overwrite), so a task that is retried or a
load that is repeated leaves the same table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- pure merges (frames in, frame out)


def merge_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows whose key is not in the source, plus the source."""
    return target.join(source.select(*keys).distinct(), list(keys), "left_anti").select(*target.columns).unionByName(
        source.select(*target.columns))


def merge_fill_blanks(target: DataFrame, source: DataFrame, keys: Sequence[str],
                      columns: Sequence[str]) -> DataFrame:
    """Stored non-empty fields win; blanks are filled from the source; new keys are added."""
    t = target.select(*keys, *[F.col(c).alias(f"t_{c}") for c in columns])
    s = source.select(*keys, *[F.col(c).alias(f"s_{c}") for c in columns])
    blank = F.lit("")
    return (t.join(s, list(keys), "full_outer").select(*keys, *[
        F.coalesce(F.nullif(F.col(f"t_{c}"), blank), F.nullif(F.col(f"s_{c}"), blank), blank).alias(c)
        for c in columns]))


def missing_rows(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows whose key is not stored yet (typed comparison, not text)."""
    return source.join(target.select(*keys), list(keys), "left_anti")


def clear_days(table: DataFrame, days: Sequence, column: str = "date_analyzed") -> DataFrame:
    return table.filter(~F.col(column).isin(*days))


def retained(table: DataFrame, days: int, today: Column | None = None, column: str = "date_analyzed") -> DataFrame:
    """Rows not older than ``days`` before today."""
    return table.filter(F.col(column) >= F.date_sub(today if today is not None else F.current_date(), days))


# ---------------------------------------------------------------- loads


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table, or an empty frame before its first load."""
    if _exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def replace_partition(df: DataFrame, path: str, by: Sequence[str] = ("snapshot_date",)) -> None:
    """Replace exactly the partitions present in ``df``; running it twice changes nothing."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def replace_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def _touched(df: DataFrame, target: DataFrame, by: Sequence[str]) -> DataFrame:
    return target.join(df.select(*by).distinct(), list(by), "left_semi")


def upsert(spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str],
           by: Sequence[str] = ("snapshot_date",)) -> None:
    """Last writer wins on ``keys``; only the partitions the source touches are rewritten.

    The merged rows are checkpointed before the overwrite because the plan reads the
    files it is about to replace.
    """
    from ..session import cut_lineage
    if not _exists(spark, path):
        return replace_partition(source, path, by)
    stored = spark.read.schema(source.schema).parquet(path)
    merged = merge_upsert(_touched(source, stored, by), source, keys)
    replace_partition(cut_lineage(merged), path, by)


def upsert_fill_blanks(spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str],
                       columns: Sequence[str], by: Sequence[str]) -> None:
    from ..session import cut_lineage
    if not _exists(spark, path):
        return replace_partition(source, path, by)
    stored = spark.read.schema(source.schema).parquet(path)
    merged = merge_fill_blanks(_touched(source, stored, by), source, keys, columns)
    replace_partition(cut_lineage(merged.select(*source.columns)), path, by)


def insert_missing(spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str],
                   by: Sequence[str]) -> None:
    """Append only keys not stored yet; the partition filter prunes the lookup."""
    if _exists(spark, path):
        stored = spark.read.schema(source.schema).parquet(path)
        source = missing_rows(_touched(source, stored, by), source, keys)
    source.write.mode("append").partitionBy(*by).parquet(path)


def upsert_daily(spark: SparkSession, path: str, source: DataFrame) -> None:
    """One summary row a day, replaced when the day is loaded again."""
    replace_partition(source.withColumn("created_day", F.to_date("created_at")), path, ("created_day",))


def apply_retention(spark: SparkSession, path: str, days: int, today: Column | None = None,
                    column: str = "date_analyzed") -> list[str]:
    """Drop partition folders older than ``days``; data files are never rewritten."""
    table = spark.read.parquet(path)
    limit = F.date_sub(today if today is not None else F.current_date(), days)
    # one row a partition value
    old = table.select(F.col(column).cast("string").alias("d"), (F.col(column) < limit).alias("old")).distinct()
    gone = [r.d for r in old.filter("old").collect()]
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    for d in gone:
        folder = jpath(f"{path}/{column}={d}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return sorted(gone)


def incremental_store(spark: SparkSession, root: str, trend: DataFrame, equity: DataFrame, trades: DataFrame,
                      summary: DataFrame) -> None:
    """Store one analysis run: missing trend and equity rows, replaced trades, summary.

    A (timeframe, day) whose stored trend and equity rows reach 95 percent of the batch
    and that has a summary is skipped.
    """
    by = ("date_analyzed", "timeframe")
    todo = pending(spark, root, trend, equity, summary)
    for name, df in (("ai_trend_data", trend), ("equity_curve", equity)):
        insert_missing(spark, f"{root}/{name}", df.join(todo, list(by), "left_semi"),
                       ("symbol", "timeframe", "ts", "date_analyzed"), by)
    replace_partition(trades.join(todo, list(by), "left_semi"), f"{root}/transaction_records", by)
    upsert(spark, f"{root}/performance_summary", summary, ("symbol", "timeframe", "date_analyzed"), by)


def pending(spark: SparkSession, root: str, trend: DataFrame, equity: DataFrame, summary: DataFrame) -> DataFrame:
    """(date_analyzed, timeframe) pairs of the batch that are not complete in the store."""
    by = ["date_analyzed", "timeframe"]
    out = trend.groupBy(*by).agg(F.count("*").alias("_want"))
    for name, like in (("ai_trend_data", trend), ("equity_curve", equity), ("performance_summary", summary)):
        have = read_table(spark, f"{root}/{name}", like.schema).groupBy(*by).agg(F.count("*").alias(f"_{name}"))
        out = out.join(have, by, "left")
    enough = F.floor(F.col("_want") * 0.95)
    done = ((F.col("_ai_trend_data") >= enough) & (F.col("_equity_curve") >= enough)
            & (F.col("_performance_summary") > 0))
    # materialised now: the loads that follow change what it reads
    from ..session import cut_lineage
    return cut_lineage(out.filter(~F.coalesce(done, F.lit(False))).select(*by))


# ---------------------------------------------------------------- audits


def audit_duplicates(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows against distinct keys per table; counting goes over grouped keys, so it combines."""
    def one(name, df, keys):
        per_key = df.groupBy(*keys).agg(F.count("*").alias("_n"))
        return per_key.agg(F.lit(name).alias("table_name"), F.sum("_n").alias("n_rows"),
                           F.count("*").alias("n_keys"), F.count_if(F.col("_n") > 1).alias("n_repeated"),
                           (F.sum("_n") - F.count("*")).alias("n_excess"))
    return reduce(DataFrame.unionByName, [one(n, df, k) for n, (df, k) in tables.items()])


def repeated_keys(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """Keys stored more than once with their count and first and last id."""
    return (df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(row_id).alias("first_id"),
                                  F.max(row_id).alias("last_id")).filter(F.col("n") > 1))


def repeated_key_ids(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """The rows of repeated keys, one a line with its place; long groups stay spread out."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    return df.join(repeated, list(keys)).select(*keys, "n", row_id)


def enforce_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    from .assets import keep_latest
    return keep_latest(df, keys, order)


def coverage(tables: dict[str, DataFrame], by: Sequence[str], expected: DataFrame, ts: str = "ts") -> DataFrame:
    """Stored rows, first and last time per table and group, complete from 95 percent on.

    ``expected`` has the group columns and ``expected_rows``.
    """
    parts = [df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
             .withColumn("table_name", F.lit(n)) for n, df in tables.items()]
    found = reduce(DataFrame.unionByName, parts)
    names = F.explode(F.array(*[F.lit(n) for n in tables]))
    want = expected.withColumn("table_name", names)
    out = want.join(found, [*by, "table_name"], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return out.withColumn("is_complete", F.col("n_rows") >= F.floor(F.col("expected_rows") * 0.95))


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-empty counts and percentages per column, one row a column, in one pass."""
    aggs = [F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(f"c{i}")
            for i, c in enumerate(columns)]
    one = df.agg(F.count("*").alias("total"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n_filled"))
                     for i, c in enumerate(columns)])
    return (one.select("total", F.explode(rows).alias("r")).select("r.*", "total")
            .withColumn("filled_pct", F.try_divide(F.col("n_filled") * 100.0, F.col("total"))))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL, NaN, infinite and zero counts and the range of the valid values per column."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        inf = F.abs(x) == float("inf")
        ok = x.isNotNull() & ~F.isnan(x) & ~inf
        aggs += [F.count_if(x.isNull()).alias(f"n{i}"), F.count_if(F.isnan(x)).alias(f"a{i}"),
                 F.count_if(inf).alias(f"i{i}"), F.count_if(x == 0).alias(f"z{i}"),
                 F.min(F.when(ok, x)).alias(f"l{i}"), F.max(F.when(ok, x)).alias(f"h{i}")]
    names = (("n", "n_null"), ("a", "n_nan"), ("i", "n_infinite"), ("z", "n_zero"), ("l", "min_value"), ("h", "max_value"))
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{p}{i}").alias(n) for p, n in names])
                     for i, c in enumerate(columns)])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def profile_rows(df: DataFrame) -> DataFrame:
    """Rows, time range, distinct symbols and timeframes; distinct goes over grouped keys."""
    per = df.groupBy("symbol", "timeframe").agg(F.count("*").alias("_n"), F.min("ts").alias("_a"),
                                                F.max("ts").alias("_b"))
    return per.agg(F.sum("_n").alias("n_rows"), F.min("_a").alias("first_ts"), F.max("_b").alias("last_ts"),
                   F.countDistinct("symbol").alias("n_symbols"), F.countDistinct("timeframe").alias("n_timeframes"))


# ---------------------------------------------------------------- serving


def newest(df: DataFrame, column: str) -> DataFrame:
    """Rows of the newest value of a column, as a scalar subquery join on one row."""
    top = df.agg(F.max(column).alias("_m"))
    return df.join(F.broadcast(top), F.col(column) == F.col("_m")).drop("_m")


def recent(df: DataFrame, days: int, today: Column, column: str = "ts") -> DataFrame:
    return df.filter(F.col(column) >= today - F.make_dt_interval(F.lit(days)))


def chart_data(df: DataFrame, timeframe: str, limit: int) -> DataFrame:
    return df.filter(F.col("timeframe") == timeframe).orderBy(F.col("ts").desc(), "symbol").limit(limit)


def flagged(df: DataFrame, column: str = "signal_type") -> DataFrame:
    return df.filter(F.col(column) != 0)


def signal_history(exc: DataFrame, n: int) -> DataFrame:
    """Newest signals, formatted."""
    reach = F.when(F.col("signal_type") == "BUY", F.col("max_gain_pct")).otherwise(F.col("max_drop_pct"))
    return (exc.orderBy(F.col("entry_time").desc(), "symbol").limit(n).select(
        "symbol", "signal_type", F.date_format("entry_time", "yyyy-MM-dd HH:mm").alias("entry_text"),
        F.round("entry_price", 2).alias("entry_price"), F.round("exit_price", 2).alias("exit_price"),
        F.round(reach, 2).alias("extreme_pct"), F.round("final_return_pct", 2).alias("return_pct")))


def clean_import(df: DataFrame, times: Sequence[str], integers: Sequence[str],
                 zero_is_null: bool = True) -> DataFrame:
    """Times as text, integers coerced; a zero becomes NULL unless told otherwise."""
    out = {c: F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd HH:mm:ss") for c in times}
    for c in integers:
        n = F.col(c).try_cast("double").try_cast("int")
        out[c] = F.nullif(n, F.lit(0)) if zero_is_null else n
    return df.withColumns(out)


def create_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Temporary views of the result tables for the named queries."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
