"""Bar construction and shaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import KEYS, epoch_seconds

OHLCV = ("open", "high", "low", "close", "volume")


def ticks_to_bars(ticks: DataFrame, rule: str, timeframe: str, tie: str | None = "tick_id") -> DataFrame:
    """Ticks (symbol, ts, price, volume, tie) to OHLCV bars.

    One aggregate with map-side combine: a hot symbol reaches the shuffle as one
    partial row per task and bucket.  ``tie`` orders ticks of the same time; where times
    are unique per symbol, None lets Spark use a hash aggregate, about three times as fast.
    """
    at = F.struct("ts", tie) if tie else F.col("ts")
    return (ticks.groupBy("symbol", _bucket(rule).alias("_w"))
            .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"),
                 F.min("price").alias("low"), F.max_by("price", at).alias("close"),
                 F.sum("volume").alias("volume"))
            .select("symbol", F.lit(timeframe).alias("timeframe"), F.col("_w").alias("ts"), *OHLCV))


def _bucket(rule: str, ts: str = "ts") -> Column:
    """Start of the bucket of ``ts``: a fixed width such as '4 hours', or week/month/year."""
    if rule in ("week", "month", "quarter", "year"):
        return F.date_trunc(rule, ts)
    return F.window(ts, rule).start


def resample(bars: DataFrame, rule: str, timeframe: str, as_reference: bool = False) -> DataFrame:
    """Coarser bars: first/max/min/last/sum per bucket; empty buckets do not appear.

    ``as_reference`` keeps daily bars as they are, which is what the 4-hour rule
    does to daily input anyway.
    """
    if as_reference:
        return bars.withColumn("timeframe", F.lit(timeframe))
    return (bars.groupBy("symbol", _bucket(rule).alias("_w"))
            .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"),
                 F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
                 F.sum("volume").alias("volume"))
            .select("symbol", F.lit(timeframe).alias("timeframe"), F.col("_w").alias("ts"), *OHLCV))


def dedupe_bars(bars: DataFrame, keep: str = "first", seq: str = "ingest_seq",
                keys: Sequence[str] = KEYS) -> DataFrame:
    """One bar per (keys, ts) out of overlapping chunks; first or last ingested wins.

    An aggregate, not a row_number window, so copies of a hot bar combine map-side.
    """
    pick = F.min_by if keep == "first" else F.max_by
    rest = [c for c in bars.columns if c not in (*keys, "ts")]
    return (bars.groupBy(*keys, "ts").agg(pick(F.struct(*rest), F.col(seq)).alias("_r"))
            .select(*keys, "ts", *[F.col(f"_r.{c}").alias(c) for c in rest]))


def clip(bars: DataFrame, start=None, end=None) -> DataFrame:
    """Keep bars inside [start, end]; reaches the scan as a pushed filter.

    Bar numbers are dropped, the clipped series starts a new count.
    """
    bars = bars.drop("bar_no")
    if start is not None:
        bars = bars.filter(F.col("ts") >= F.lit(start))
    if end is not None:
        bars = bars.filter(F.col("ts") <= F.lit(end))
    return bars


def last_per(df: DataFrame, unit: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Last row per day/week/month of each key."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys, F.date_trunc(unit, "ts").alias("period"))
            .agg(F.max_by(F.struct(*rest), "ts").alias("_r"))
            .select(*keys, "period", *[F.col(f"_r.{c}").alias(c) for c in rest]))


def month_end(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Last row per month labelled with the last day of the month."""
    return (last_per(df, "month", keys)
            .withColumn("month_end", F.last_day(F.col("period"))).drop("period"))


def detect_frequency(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Name the spacing of a series from its mean gap in whole days over rows-1."""
    gap = F.try_divide(F.floor((epoch_seconds(F.col("last_ts")) - epoch_seconds(F.col("first_ts"))) / 86400),
                       F.col("n_rows") - 1)
    return (df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"),
                                  F.max("ts").alias("last_ts"))
            .withColumn("avg_days", gap)
            .withColumn("frequency", F.when(F.col("n_rows") < 2, "Unknown")
                        .when(F.col("avg_days") <= 1.5, "Daily")
                        .when(F.col("avg_days") <= 7.5, "Weekly")
                        .when(F.col("avg_days") <= 35, "Monthly").otherwise("Other")))


def expand_daily_4h(bars: DataFrame) -> DataFrame:
    """Six 4-hour rows per daily bar along a straight open-close path.

    A projection: no shuffle, the volume of a day is shared equally.
    """
    hour = F.col("hour")
    move = F.col("close") - F.col("open")
    o = (F.when(hour == 0, F.col("open"))
         .when(hour == 20, F.col("open") + move * 0.833)
         .otherwise(F.col("open") + move * (hour / 20.0 - 0.167)))
    c = (F.when(hour == 0, F.col("open") + move * 0.167)
         .when(hour == 20, F.col("close"))
         .otherwise(F.col("open") + move * (hour / 20.0 + 0.167)))
    return (bars.withColumn("hour", F.explode(F.array(*[F.lit(h) for h in range(0, 24, 4)])))
            .withColumns({"_o": o, "_c": c})
            .select("symbol", F.lit("4h").alias("timeframe"),
                    (F.col("ts") + F.make_dt_interval(F.lit(0), hour)).alias("ts"),
                    F.col("_o").alias("open"),
                    F.least(F.col("high"), F.greatest("_o", "_c") * 1.001).alias("high"),
                    F.greatest(F.col("low"), F.least("_o", "_c") * 0.999).alias("low"),
                    F.col("_c").alias("close"), (F.col("volume") / 6).alias("volume")))


def higher_timeframe(low: DataFrame, high: DataFrame, rule: str) -> DataFrame:
    """Attach the close of the last finished higher-timeframe bucket to each low bar."""
    shifted = high.select("symbol", (F.col("ts") + F.expr(f"interval {rule}")).alias("_w"),
                          F.col("close").alias("htf_close"))
    return (low.withColumn("_w", _bucket(rule)).join(shifted, ["symbol", "_w"], "left").drop("_w"))
