"""Series layout: ordered work on bars without one task per series.

A window partitioned by symbol alone puts a whole series on one task, and one
symbol may own a third of the table.  Everything ordered in this package runs on
*blocks* of a series instead:

``number_bars``  gives every bar its position in the series, by counting inside
                 calendar spans and adding up the (small) table of span counts.
``windowed``     cuts the numbered series into blocks of equal length, hands each
                 block the few bars before (after) it that its windows look back
                 (ahead) on, and runs the windows per block.
``running``      carries unbounded running values (sum, product, last, max, min,
                 first) over block borders through a table with one row a block.

A block holds at most ``BLOCK_BARS`` bars plus its lead-in, whatever the series.
Input rule: one row per (keys, ts), see ``bars.dedupe_bars`` and ``bars.resample``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("symbol", "timeframe")
BLOCK_BARS = 65_536

# seconds per unit letter of a timeframe such as 15m, 4h, 1d, 1w, 1M
_UNIT_SECONDS = (("s", 1), ("m", 60), ("h", 3600), ("H", 3600), ("d", 86400), ("D", 86400),
                 ("w", 604800), ("W", 604800), ("M", 2592000))


class Over:
    """Windows over one block of a series, ordered by bar number."""

    def __init__(self, keys: Sequence[str]):
        self.keys = (*keys, "_blk")
        self.ordered = Window.partitionBy(*self.keys).orderBy("bar_no")
        self.so_far = self.ordered.rowsBetween(Window.unboundedPreceding, 0)
        self.before = self.ordered.rowsBetween(Window.unboundedPreceding, -1)

    def last(self, n: int) -> WindowSpec:
        """The current bar and the n-1 bars before it."""
        return self.ordered.rowsBetween(-(n - 1), 0)

    def rows(self, start: int, end: int) -> WindowSpec:
        return self.ordered.rowsBetween(start, end)

    def within(self, *extra: str) -> WindowSpec:
        """Running window restarted whenever one of ``extra`` changes."""
        return (Window.partitionBy(*self.keys, *extra).orderBy("bar_no")
                .rowsBetween(Window.unboundedPreceding, 0))


def timeframe_seconds(timeframe: Column) -> Column:
    count = F.coalesce(F.regexp_extract(timeframe, r"^(\d+)", 1).try_cast("long"), F.lit(1))
    unit = F.regexp_extract(timeframe, r"([A-Za-z])$", 1)
    seconds = F.lit(1)
    for letter, size in _UNIT_SECONDS:
        seconds = F.when(unit == letter, F.lit(size)).otherwise(seconds)
    return F.greatest(count * seconds, F.lit(1)).cast("long")


def epoch_seconds(ts: str | Column) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def _span(bars: DataFrame, size: int, order: str) -> Column:
    if order != "ts":
        return F.floor(F.col(order) / size)
    # without a (known) timeframe a span is as many seconds; coarser bars then fill spans less, and there are
    # never more spans than bars, nor than the calendar has
    step = timeframe_seconds(F.col("timeframe")) if "timeframe" in bars.columns else F.lit(1).cast("long")
    return F.floor(epoch_seconds("ts") / (step * F.lit(size)))


def number_bars(bars: DataFrame, keys: Sequence[str] = KEYS, size: int = BLOCK_BARS,
                order: str = "ts") -> DataFrame:
    """Add ``bar_no``, the zero-based position of a row in its series.

    ``order`` is the time of a bar or any whole number unique within the keys.
    """
    spanned = bars.withColumn("_span", _span(bars, size, order))
    counts = spanned.groupBy(*keys, "_span").agg(F.count("*").alias("_n"))
    earlier = (Window.partitionBy(*keys).orderBy("_span")
               .rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*keys, "_span",
                           F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_span").orderBy(order))
    return (spanned.withColumn("_in", inside)
            .join(starts, [*keys, "_span"])
            .withColumn("bar_no", F.col("_start") + F.col("_in") - 1)
            .drop("_span", "_in", "_start"))


def windowed(bars: DataFrame, fn: Callable[[DataFrame, Over], DataFrame], lookback: int,
             lookahead: int = 0, keys: Sequence[str] = KEYS, size: int = BLOCK_BARS,
             keep_block: bool = False) -> DataFrame:
    """Run ``fn(df, over)`` per block; ``fn`` must not drop or add rows.

    ``lookback``/``lookahead`` are the bars before/after a bar its result depends on.
    """
    if "bar_no" not in bars.columns:
        bars = number_bars(bars, keys, size)
    home = F.floor(F.col("bar_no") / size)
    first = F.greatest(F.floor((F.col("bar_no") - lookahead) / size), F.lit(0))
    last = F.floor((F.col("bar_no") + lookback) / size)
    spread = (bars.withColumn("_home", home)
              .withColumn("_blk", F.explode(F.sequence(first, last))))
    out = fn(spread, Over(keys)).filter(F.col("_blk") == F.col("_home")).drop("_home")
    return out if keep_block else out.drop("_blk")


def blocked(bars: DataFrame, keys: Sequence[str] = KEYS, size: int = BLOCK_BARS) -> DataFrame:
    """Add ``_blk`` without lead-in, as ``running`` needs it."""
    if "_blk" in bars.columns:
        return bars
    if "bar_no" not in bars.columns:
        bars = number_bars(bars, keys, size)
    return bars.withColumn("_blk", F.floor(F.col("bar_no") / size))


_LOCAL = {"sum": F.sum, "prod": F.product, "max": F.max, "min": F.min,
          "last": lambda c: F.last(c, ignorenulls=True),
          "first": lambda c: F.first(c, ignorenulls=True)}
_TOTAL = {"sum": F.sum, "prod": F.product, "max": F.max, "min": F.min,
          "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("bar_no"))),
          "first": lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("bar_no")))}
_JOIN = {"sum": lambda c, x: F.coalesce(c + x, c, x),
         "prod": lambda c, x: F.coalesce(c * x, c, x),
         "max": lambda c, x: F.greatest(c, x),
         "min": lambda c, x: F.least(c, x),
         "last": lambda c, x: F.coalesce(x, c),
         "first": lambda c, x: F.coalesce(c, x)}


def running(bars: DataFrame, specs: dict[str, tuple[str, Column]], keys: Sequence[str] = KEYS,
            size: int = BLOCK_BARS, before: bool = False, keep_block: bool = False) -> DataFrame:
    """Add running values from the start of the series up to each bar.

    ``specs`` maps an output name to (kind, column); with ``before`` the current bar
    is left out.
    """
    df = blocked(bars, keys, size)
    over = Over(keys)
    frame = over.before if before else over.so_far
    local = df.withColumns({f"_l_{out}": _LOCAL[kind](col).over(frame)
                            for out, (kind, col) in specs.items()})
    totals = df.groupBy(*keys, "_blk").agg(*[_TOTAL[kind](col).alias(f"_t_{out}")
                                             for out, (kind, col) in specs.items()])
    earlier = (Window.partitionBy(*keys).orderBy("_blk")
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = totals.select(*keys, "_blk", *[
        _LOCAL[kind](F.col(f"_t_{out}")).over(earlier).alias(f"_c_{out}")
        for out, (kind, _) in specs.items()])
    joined = local.join(carry, [*keys, "_blk"]).withColumns({
        out: _JOIN[kind](F.col(f"_c_{out}"), F.col(f"_l_{out}"))
        for out, (kind, _) in specs.items()})
    drop = [f"_{p}_{out}" for out in specs for p in ("l", "c")]
    return joined.drop(*drop) if keep_block else joined.drop(*drop, "_blk")
