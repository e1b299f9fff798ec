"""Structured Streaming forms of the bar, ratio, alert and store operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import store
from ..operators.indicators import span_alpha


def with_policy(ticks: DataFrame, delay: str = "10 minutes", keys=("symbol", "tick_id")) -> DataFrame:
    """Watermark plus removal of repeated ticks; both bound the state."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def stream_bars(ticks: DataFrame, rule: str, timeframe: str, tie: str = "tick_id") -> DataFrame:
    """Bars from a watermarked tick stream; the same aggregate as the batch operator."""
    at = F.struct("ts", tie)
    return (ticks.groupBy("symbol", F.window("ts", rule))
            .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
                 F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
            .select("symbol", F.lit(timeframe).alias("timeframe"), F.col("window.start").alias("ts"),
                    "open", "high", "low", "close", "volume"))


def stream_ratio(ticks: DataFrame, a: str, b: str, rule: str = "1 minute", tie: str = "tick_id") -> DataFrame:
    """Last price of two symbols per window and their ratio; windows lacking one are dropped."""
    def last(name):
        return F.max_by("price", F.when(F.col("symbol") == name, F.struct("ts", tie)))
    return (ticks.filter(F.col("symbol").isin(a, b)).groupBy(F.window("ts", rule))
            .agg(last(a).alias("a_price"), last(b).alias("b_price"))
            .select(F.col("window.start").alias("ts"), "a_price", "b_price",
                    F.try_divide("a_price", "b_price").alias("ratio"))
            .filter(F.col("ratio").isNotNull()))


ALERT_SCHEMA = "symbol string, timeframe string, ts timestamp, close double, signal_type int"
_STATE = "last_ts timestamp, n long, fast double, slow double, smooth double, wf double, ws double, wg double, gap double"


def stream_alerts(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD crossings at bar close; state is nine numbers a series.

    Input is bars (a few rows a series and batch), already in time order across batches.
    """
    af, as_, ag = (span_alpha(x) for x in (fast, slow, signal))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            last, n, f, s, g, wf, ws, wg, gap = state.get
        else:
            last, n, f, s, g, wf, ws, wg, gap = None, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
        out = []
        rows = pd.concat(list(batches)).sort_values("ts")
        for ts, close in zip(rows["ts"], rows["close"]):
            f, wf = f * (1 - af) + close, wf * (1 - af) + 1
            s, ws = s * (1 - as_) + close, ws * (1 - as_) + 1
            line = f / wf - s / ws
            g, wg = g * (1 - ag) + line, wg * (1 - ag) + 1
            now = line - g / wg
            side = (1 if now > 0 and gap <= 0 else -1 if now < 0 and gap >= 0 else 0) if n else 0
            if side:
                out.append((*key, ts, close, side))
            n, gap, last = n + 1, now, ts
        state.update((last, n, f, s, g, wf, ws, wg, gap))
        yield pd.DataFrame(out, columns=["symbol", "timeframe", "ts", "close", "signal_type"])
    return (bars.select("symbol", "timeframe", "ts", "close").groupBy("symbol", "timeframe")
            .applyInPandasWithState(step, ALERT_SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout))


def stream_changes(spark: SparkSession, path: str, schema, handle: Callable[[DataFrame, int], None],
                   checkpoint: str):
    """Call ``handle`` with the rows of every file newly added to a result table."""
    return (spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(handle)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def store_stream(stream: DataFrame, path: str, keys, by, checkpoint: str):
    """Write a stream into a result table; a replayed batch adds no row twice."""
    def write(batch: DataFrame, _: int) -> None:
        store.insert_missing(batch.sparkSession, path, batch.dropDuplicates(list(keys)), keys, by)
    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def split_late(stream: DataFrame, root: str, delay: str, checkpoint: str, arrival: str = "tick_id", key: str = "symbol",
               keys=("symbol", "tick_id")):
    """On-time ticks to ``root/on_time``, late ones to ``root/late``, repeats dropped; batches may be replayed.

    A tick is late if it is older than the newest tick of its symbol that arrived before it, less the delay, whatever
    the cuts between batches: within a batch that is a running maximum in order of ``arrival``, across batches a mark
    a symbol.  Every batch writes a folder of its own and overwrites it when it is replayed; its marks continue
    those of the batch before, so one folder of a row a symbol is read, never the stored ticks.  A tick is a repeat if
    an earlier batch stored it; only days that the batch holds are looked through.  Where no tick was late there is no
    file below ``root/late``: ``read_split`` reads both.
    """
    def write(batch: DataFrame, number: int) -> None:
        from ..operators.series import running
        from ..session import cut_lineage
        spark = batch.sparkSession
        columns = batch.columns
        batch = cut_lineage(batch.groupBy(*keys).agg(F.min_by(F.struct(*columns), arrival).alias("_r")).select("_r.*"))
        before = store.read_table(spark, f"{root}/marks/batch={number - 1}", f"{key} string, _mark timestamp")
        seen = number_arrivals(batch, key, arrival)
        seen = running(seen, {"_newest": ("max", F.col("ts"))}, (key,), before=True)
        seen = seen.join(before, key, "left").withColumn("_limit", F.greatest("_newest", "_mark") - F.expr(f"interval {delay}"))
        seen = cut_lineage(seen.withColumn("_late", F.coalesce(F.col("ts") < F.col("_limit"), F.lit(False))).withColumn("_day", F.to_date("ts")))
        full = T.StructType([*batch.schema.fields, T.StructField("_day", T.DateType()), T.StructField("batch", T.LongType())])
        stored = store.read_table(spark, f"{root}/on_time", full).unionByName(store.read_table(spark, f"{root}/late", full)).where(F.col("batch") < number)
        known = cut_lineage(stored.join(seen.select("_day").distinct(), "_day", "left_semi").select(*keys))
        for name, rows in (("on_time", seen.where("NOT _late")), ("late", seen.where("_late"))):
            # days share tasks, so a day is one file of the batch unless it is too large for one
            rows.join(known, list(keys), "left_anti").select(*columns, "_day").withColumn("batch", F.lit(number)).hint("rebalance", "_day") \
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "_day").parquet(f"{root}/{name}")
        now = batch.groupBy(key).agg(F.max("ts").alias("_mark"))
        now.unionByName(before.select(key, "_mark")).groupBy(key).agg(F.max("_mark").alias("_mark")) \
            .write.mode("overwrite").parquet(f"{root}/marks/batch={number}")
    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_split(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The ticks that ``split_late`` stored, with ``late``; either table may have no file yet."""
    parts = [store.read_table(spark, f"{root}/{name}", schema).select(*schema.names).withColumn("late", F.lit(late))
             for name, late in (("on_time", False), ("late", True))]
    return parts[0].unionByName(parts[1])


def number_arrivals(batch: DataFrame, key: str, arrival: str) -> DataFrame:
    """``bar_no`` by arrival within a key: the layout that running values are made in."""
    from ..operators.series import number_bars
    return number_bars(batch, (key,), order=arrival)
