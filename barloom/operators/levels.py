"""Pivot points and support/resistance channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import BLOCK_BARS, KEYS, running, windowed


def pivots(bars: DataFrame, p: int = 10, source: str = "high_low", size: int = BLOCK_BARS) -> DataFrame:
    """Bars whose high (low) is strictly above (below) those of p bars on either side.

    ``known_at`` is the bar number at which the pivot is known, p bars later.
    """
    def fn(df, o):
        if source == "high_low":
            hi, lo = F.col("high"), F.col("low")
        else:
            hi, lo = F.greatest("open", "close"), F.least("open", "close")
        before, after = o.rows(-p, -1), o.rows(1, p)
        full = (F.count(F.lit(1)).over(before) == p) & (F.count(F.lit(1)).over(after) == p)
        df = df.withColumns({
            "pivot_high": F.when(full & (hi > F.max(hi).over(before)) & (hi > F.max(hi).over(after)), hi),
            "pivot_low": F.when(full & (lo < F.min(lo).over(before)) & (lo < F.min(lo).over(after)), lo)})
        return df.withColumn("known_at", F.col("bar_no") + p)
    return windowed(bars, fn, p, lookahead=p, size=size)


def channel_sets(bars: DataFrame, p: int = 10, loopback: int = 290, width_pct: float = 5.0, min_strength: int = 1,
                 most: int = 10, range_bars: int = 300, source: str = "high_low", size: int = BLOCK_BARS,
                 newest: bool = False) -> DataFrame:
    """Support/resistance channels as of each bar at which a pivot becomes known: keys, as_of, sets (array, may be empty).

    A channel grows from a pivot over the pivots of the look-back that keep it within
    the width; strength is 20 a pivot plus the bars touching it.  The strongest free
    channel is taken first and switches off the channels it overlaps, up to ``most``.
    A set sees the bars of its look-back only, so arrays are bounded by ``loopback``, whatever the length of
    the series.  ``newest``: the last set of each series alone.
    """
    marked = pivots(bars, p, source, size)
    is_pivot = F.col("pivot_high").isNotNull() | F.col("pivot_low").isNotNull()
    stops = marked.filter(is_pivot).select(*KEYS, F.col("known_at").alias("as_of"))
    stops = stops.groupBy(*KEYS).agg(F.max("as_of").alias("as_of")) if newest else stops.distinct()
    back = max(loopback + p, range_bars - 1)
    seen_bars = stops.withColumn("bar_no", F.explode(F.sequence(F.greatest(F.col("as_of") - back, F.lit(0)), F.col("as_of"))))
    window = marked.join(seen_bars, [*KEYS, "bar_no"])
    seen = is_pivot & (F.col("known_at").between(F.col("as_of") - loopback, F.col("as_of")))
    level = F.coalesce("pivot_high", "pivot_low")
    in_range = F.col("bar_no") > F.col("as_of") - range_bars
    per = window.groupBy(*KEYS, "as_of").agg(
        (F.max(F.when(in_range, F.col("high"))) - F.min(F.when(in_range, F.col("low")))).alias("_range"),
        # newest pivot first
        F.sort_array(F.collect_list(F.when(seen, F.struct(F.col("known_at").alias("at"), level.alias("v")))), False)
        .alias("_p"),
        F.collect_list(F.when(F.col("bar_no") >= F.col("as_of") - loopback,
                              F.struct("high", "low"))).alias("_bars"))
    per = per.withColumn("_w", F.col("_range") * width_pct / 100)
    w, pv, rows = F.col("_w"), F.col("_p"), F.col("_bars")

    def grow(seed: Column) -> Column:
        start = F.struct(seed["v"].alias("lo"), seed["v"].alias("hi"), F.lit(0).alias("n"))

        def step(c, x):
            below = x["v"] <= c["hi"]
            gap = F.when(below, c["hi"] - x["v"]).otherwise(x["v"] - c["lo"])
            fits = gap <= w
            return F.struct(
                F.when(fits & below, F.least(c["lo"], x["v"])).otherwise(c["lo"]).alias("lo"),
                F.when(fits & ~below, F.greatest(c["hi"], x["v"])).otherwise(c["hi"]).alias("hi"),
                F.when(fits, c["n"] + 20).otherwise(c["n"]).alias("n"))
        return F.aggregate(pv, start, step)

    def strength(c: Column) -> Column:
        touch = F.filter(rows, lambda b: b["high"].between(c["lo"], c["hi"]) | b["low"].between(c["lo"], c["hi"]))
        return c["n"] + F.size(touch)
    per = per.withColumn("_c", F.transform(pv, grow))
    per = per.withColumn("_c", F.transform("_c", lambda c, i: F.struct(
        strength(c).alias("s"), (-i).alias("first"), c["hi"].alias("hi"), c["lo"].alias("lo"))))
    kind = "array<struct<s:int,first:int,hi:double,lo:double>>"
    start = F.struct(F.col("_c").cast(kind).alias("left"), F.array().cast(kind).alias("out"))

    def take(acc, _):
        best = F.array_max(F.filter(acc["left"], lambda c: c["s"] >= min_strength * 20))
        rest = F.filter(acc["left"], lambda c: ~(c["hi"].between(best["lo"], best["hi"])
                                                 | c["lo"].between(best["lo"], best["hi"])))
        return F.struct(F.when(best.isNull(), acc["left"]).otherwise(rest).alias("left"),
                        F.when(best.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(best)))
                        .alias("out"))
    per = per.withColumn("_out", F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, take)["out"])
    return per.select(*KEYS, "as_of", F.transform("_out", lambda k: F.struct(
        k["hi"].alias("top"), k["lo"].alias("bottom"), k["s"].alias("strength"))).alias("sets"))


def channels(bars: DataFrame, p: int = 10, loopback: int = 290, width_pct: float = 5.0, min_strength: int = 1,
             most: int = 10, range_bars: int = 300, source: str = "high_low", size: int = BLOCK_BARS) -> DataFrame:
    """Channels of each series as of its newest known pivot, however long ago that was."""
    sets = channel_sets(bars, p, loopback, width_pct, min_strength, most, range_bars, source, size, newest=True)
    return sets.select(*KEYS, "as_of", F.posexplode("sets").alias("channel_no", "_k")).select(
        *KEYS, "as_of", "channel_no", "_k.top", "_k.bottom", "_k.strength")


def channel_breaks(bars: DataFrame, sets: DataFrame, size: int = BLOCK_BARS) -> DataFrame:
    """Bars that closed outside every channel after crossing a top or a bottom, by the channels valid on that bar.

    A set of ``sets`` (see ``channel_sets``) is valid from its own bar to the bar before the next one.
    """
    df = windowed(bars, lambda d, o: d.withColumn("_prev", F.lag("close", 1).over(o.ordered)), 1, size=size)
    df = df.join(sets.select(*KEYS, F.col("as_of").alias("bar_no"), F.col("as_of").alias("_new")), [*KEYS, "bar_no"], "left")
    df = running(df, {"as_of": ("last", F.col("_new"))}, size=size).drop("_new")
    df = df.join(sets.withColumnRenamed("sets", "_ch"), [*KEYS, "as_of"], "left").withColumn("_ch", F.coalesce(
        F.col("_ch"), F.array().cast("array<struct<top:double,bottom:double,strength:int>>")))
    c, prev = F.col("close"), F.col("_prev")
    outside = ~F.exists("_ch", lambda k: c.between(k["bottom"], k["top"]))
    up = F.exists("_ch", lambda k: (prev <= k["top"]) & (c > k["top"]))
    down = F.exists("_ch", lambda k: (prev >= k["bottom"]) & (c < k["bottom"]))
    return df.withColumns({"resistance_broken": F.coalesce(outside & up, F.lit(False)),
                           "support_broken": F.coalesce(outside & down, F.lit(False))}).drop("_prev", "_ch")
