"""Streams over the driver tables, run to their end and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import streams as W
from .inputs import SQL_1H, SQL_4H, bars_1h, sql_event_bars, sql_macd
from .registry import query


def _folder(spark) -> str:
    """A new folder beside the checkpoints of the session."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"


def tick_stream(read) -> DataFrame:
    """Events as a stream of ticks."""
    schema = read("events").schema
    events = read.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(read.folder)
    return events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
                         F.lit(1.0).alias("volume"), F.col("event_id").alias("tick_id"))


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """Run a bounded stream to its end; executors write the result table that is read back."""
    spark, out = stream.sparkSession, _folder(stream.sparkSession)

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{out}/data")
    q = (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def whole(stream: DataFrame, same: DataFrame, keys: list[str]) -> DataFrame:
    """Windows that the stream has written, and those that its watermark leaves open from the batch form ``same``."""
    closed = finished(stream, "append")
    rest = same.withColumn("ts", F.col("ts").cast("timestamp_ntz")).join(closed.select(*keys), keys, "left_anti")
    return closed.unionByName(rest)


def tick_table(read) -> DataFrame:
    """The same ticks as a table."""
    return read("events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
                                 F.lit(1.0).alias("volume"), F.col("event_id").alias("tick_id")).dropDuplicates(["symbol", "tick_id"])


@query("r2_stream_bars", f"WITH {sql_event_bars(4)} SELECT * FROM bars", r6="open high low close")
def _(read):
    """Live ticks, repeats removed, to bars; a bar is written once, when the watermark has passed it; open ones come last."""
    return whole(W.stream_bars(W.with_policy(tick_stream(read)), "4 hours", "4h"), W.stream_bars(tick_table(read), "4 hours", "4h"), ["symbol", "ts"])


@query("r1_stream_ratio", f"""{SQL_1H}, m AS (SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, last(value ORDER BY ts, event_id) AS price FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2)
SELECT a.ts, a.price AS a_price, v.price AS b_price, a.price / v.price AS ratio FROM m a JOIN m v ON v.ts = a.ts AND v.symbol = 'view' WHERE a.symbol = 'click'""",
       r6="a_price b_price ratio")
def _(read):
    ticks = tick_stream(read).filter(F.col("symbol").isin("click", "view"))
    return whole(W.stream_ratio(W.with_policy(ticks), "click", "view", "1 hour"), W.stream_ratio(tick_table(read), "click", "view", "1 hour"), ["ts"])


@query("r7_late_ticks", """WITH a AS (SELECT event_type AS symbol, ts, value AS price, CASE WHEN event_id % 13 = 0 THEN 2 * event_id + 401 ELSE 2 * event_id END AS tick_id FROM events),
n AS (SELECT *, max(ts) OVER (PARTITION BY symbol ORDER BY tick_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a)
SELECT symbol, ts, price, tick_id, coalesce(ts < newest - INTERVAL 10 MINUTE, FALSE) AS late FROM n""", r6="price")
def _(read):
    """Ticks that arrive out of order and again in three loads; the last batch is run twice, as after a failure."""
    spark, root = read.spark, _folder(read.spark)
    tick = F.when(F.col("event_id") % 13 == 0, 2 * F.col("event_id") + 401).otherwise(2 * F.col("event_id"))
    ticks = read("events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), tick.alias("tick_id"))
    most = ticks.agg(F.max("tick_id")).first()[0] or 0
    third = F.floor(F.col("tick_id") * 3 / (most + 1))

    def run():
        stream = spark.readStream.schema(ticks.schema).parquet(f"{root}/in")
        W.split_late(stream, root, "10 minutes", f"{root}/state").awaitTermination()
    for i in range(3):
        again = ticks.where((third < i) & (F.col("tick_id") % 17 == 0))
        ticks.where(third == i).unionByName(again).write.mode("append").parquet(f"{root}/in")
        run()
    noted = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/state/commits/2")
    noted.getFileSystem(spark._jsc.hadoopConfiguration()).delete(noted, False)
    run()
    return W.read_split(spark, root, ticks.schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("r3_stream_alerts", f"{SQL_1H}, {sql_macd()} SELECT symbol, timeframe, ts, close, signal_type FROM macd WHERE signal_type <> 0", r6="close")
def _(read):
    """Crossings found bar by bar from keyed state, as the batch operator finds them."""
    bars, src = bars_1h(read), _folder(read.spark)
    bars.withColumn("ts", F.col("ts").cast("timestamp")).select("symbol", "timeframe", "ts", "close").write.parquet(f"{src}/bars")
    stream = read.spark.readStream.schema("symbol string, timeframe string, ts timestamp, close double").parquet(f"{src}/bars")
    return finished(W.stream_alerts(stream), "append")
