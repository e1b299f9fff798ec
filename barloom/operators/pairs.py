"""Aligning and comparing two series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bars import last_per
from .series import BLOCK_BARS, KEYS, running


def _sides(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return (a.select("ts", *[F.col(c).alias(f"a_{c}") for c in cols]),
            b.select("ts", *[F.col(c).alias(f"b_{c}") for c in cols]))


def add_ratio(df: DataFrame) -> DataFrame:
    """a over b for every shared column."""
    names = [c[2:] for c in df.columns if c.startswith("a_") and f"b_{c[2:]}" in df.columns]
    return df.withColumns({f"{c}_ratio": F.try_divide(f"a_{c}", f"b_{c}") for c in names})


def align_exact(a: DataFrame, b: DataFrame, cols: Sequence[str] = ("close",)) -> DataFrame:
    """Rows whose timestamps exist on both sides, with ratios."""
    left, right = _sides(a, b, cols)
    return add_ratio(left.join(right, "ts", "inner"))


def align_asof(a: DataFrame, b: DataFrame, cols: Sequence[str] = ("close",),
               size: int = BLOCK_BARS) -> DataFrame:
    """Union of the timestamps, both sides carried forward, from the first time both exist.

    The carry is a blocked running value, so a long pair is not one task.
    """
    left, right = _sides(a, b, cols)
    names = [c for c in (*left.columns, *right.columns) if c != "ts"]
    both = (left.unionByName(right, allowMissingColumns=True).groupBy("ts")
            .agg(*[F.max(c).alias(c) for c in names]).withColumn("pair", F.lit(1)))
    filled = running(both, {f"_{c}": ("last", F.col(c)) for c in names}, keys=("pair",), size=size)
    out = filled.select("ts", *[F.col(f"_{c}").alias(c) for c in names])
    first = cols[0]
    return add_ratio(out.filter(F.col(f"a_{first}").isNotNull() & F.col(f"b_{first}").isNotNull()))


def align_monthly(a: DataFrame, b: DataFrame, cols: Sequence[str] = ("close",)) -> DataFrame:
    """Last row per month on each side, joined on the month, left timestamp kept."""
    left, right = _sides(a, b, cols)
    left = last_per(left, "month", keys=())
    right = last_per(right, "month", keys=()).drop("ts")
    return add_ratio(left.join(right, "period")).drop("period")


def align_overlap(a: DataFrame, b: DataFrame, cols: Sequence[str] = ("close",)) -> DataFrame:
    """Daily alignment inside [later start, earlier end]; last row of a day counts."""
    left, right = _sides(a, b, cols)
    left, right = last_per(left, "day", keys=()), last_per(right, "day", keys=()).drop("ts")
    span = (left.agg(F.min("period").alias("la"), F.max("period").alias("lb"))
            .crossJoin(right.agg(F.min("period").alias("ra"), F.max("period").alias("rb")))
            .select(F.greatest("la", "ra").alias("_from"), F.least("lb", "rb").alias("_to")))
    # the span is one row by construction
    joined = left.join(right, "period").crossJoin(F.broadcast(span))
    return (add_ratio(joined.filter(F.col("period").between(F.col("_from"), F.col("_to"))))
            .drop("_from", "_to", "ts").withColumnRenamed("period", "ts"))


def align_auto(a: DataFrame, b: DataFrame, cols: Sequence[str] = ("close",)) -> DataFrame:
    """Exact alignment if both sides have as many rows, month-end alignment otherwise.

    The choice is a one-row condition inside the plan, not a driver-side count.
    """
    same = (a.agg(F.count("*").alias("_na")).crossJoin(b.agg(F.count("*").alias("_nb")))
            .select((F.col("_na") == F.col("_nb")).alias("_same")))
    exact = align_exact(a, b, cols).crossJoin(F.broadcast(same)).filter("_same").drop("_same")
    month = align_monthly(a, b, cols).crossJoin(F.broadcast(same)).filter("not _same").drop("_same")
    return exact.unionByName(month)


def ratio_stats(pairs: DataFrame, ratio: str = "close_ratio", keys: Sequence[str] = ("pair",)) -> DataFrame:
    """Current, first, mean and extreme ratio, growth of both sides and position labels."""
    agg = pairs.groupBy(*keys).agg(
        F.max_by(ratio, "ts").alias("current_ratio"), F.min_by(ratio, "ts").alias("start_ratio"),
        F.avg(ratio).alias("avg_ratio"), F.min(ratio).alias("min_ratio"), F.max(ratio).alias("max_ratio"),
        F.min_by("ts", F.struct(F.col(ratio), F.col("ts"))).alias("min_date"),
        F.min_by("ts", F.struct(-F.col(ratio), F.col("ts"))).alias("max_date"),
        F.max_by("a_close", "ts").alias("_a1"), F.min_by("a_close", "ts").alias("_a0"),
        F.max_by("b_close", "ts").alias("_b1"), F.min_by("b_close", "ts").alias("_b0"))
    cur, avg = F.col("current_ratio"), F.col("avg_ratio")
    return agg.withColumns({
        "change_pct": (F.try_divide("current_ratio", "start_ratio") - 1) * 100,
        "a_growth": (F.try_divide("_a1", "_a0") - 1) * 100, "b_growth": (F.try_divide("_b1", "_b0") - 1) * 100,
        "range_multiple": F.try_divide("max_ratio", "min_ratio"),
        "range_position": F.try_divide(cur - F.col("min_ratio"), F.col("max_ratio") - F.col("min_ratio")) * 100,
        "strength": F.when(cur > avg * 1.1, "STRONG").when(cur < avg * 0.9, "WEAK").otherwise("NEUTRAL"),
        "strength_5": F.when(cur > avg * 1.15, "VERY STRONG").when(cur > avg * 1.05, "STRONG")
        .when(cur < avg * 0.85, "WEAK").when(cur < avg * 0.95, "SLIGHTLY WEAK").otherwise("NEUTRAL")}
    ).drop("_a1", "_a0", "_b1", "_b0")


def _from_end(pairs: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Add ``back``: 0 for the last row of a pair, 1 for the one before, ..."""
    numbered = running(pairs, {"_rn": ("sum", F.lit(1))}, keys, size)
    ends = numbered.groupBy(*keys).agg(F.max("bar_no").alias("_end"))
    return (numbered.join(ends, list(keys)).withColumn("back", F.col("_end") - F.col("bar_no"))
            .drop("_rn"))


def ratio_trend(pairs: DataFrame, ratio: str = "close_ratio", n: int = 12,
                keys: Sequence[str] = ("pair",), size: int = BLOCK_BARS) -> DataFrame:
    """Mean of the last n rows against the n rows before (or the overall mean if short)."""
    df = _from_end(pairs, keys, size)
    agg = df.groupBy(*keys).agg(
        F.avg(F.when(F.col("back") < n, F.col(ratio))).alias("recent_avg"),
        F.when(F.count("*") >= 2 * n, F.avg(F.when(F.col("back").between(n, 2 * n - 1), F.col(ratio))))
        .otherwise(F.avg(ratio)).alias("older_avg"), F.count("*").alias("n_rows"))
    return (agg.filter(F.col("n_rows") >= n).withColumns({
        "direction": F.when(F.col("recent_avg") > F.col("older_avg"), "UP").otherwise("DOWN"),
        "change_pct": F.abs(F.try_divide(F.col("recent_avg") - F.col("older_avg"), F.col("older_avg"))) * 100}))


def ratio_trend_long(pairs: DataFrame, ratio: str = "close_ratio", short: int = 90, long: int = 365,
                     keys: Sequence[str] = ("pair",), size: int = BLOCK_BARS) -> DataFrame:
    """Last 90 rows against the last 365 with bands of 5 percent."""
    df = _from_end(pairs, keys, size)
    agg = df.groupBy(*keys).agg(
        F.avg(F.when(F.col("back") < short, F.col(ratio))).alias("recent_avg"),
        F.avg(F.when(F.col("back") < long, F.col(ratio))).alias("year_avg"), F.count("*").alias("n_rows"))
    return (agg.filter(F.col("n_rows") >= long).withColumn(
        "direction", F.when(F.col("recent_avg") > F.col("year_avg") * 1.05, "UPWARD")
        .when(F.col("recent_avg") < F.col("year_avg") * 0.95, "DOWNWARD").otherwise("SIDEWAYS")))


def yearly_extremes(pairs: DataFrame, ratio: str = "close_ratio", keys: Sequence[str] = ("pair",)) -> DataFrame:
    """Highest and lowest ratio with their times, per year and overall (year NULL)."""
    def agg(by):
        return pairs.groupBy(*keys, *by).agg(
            F.max(ratio).alias("max_ratio"), F.min_by("ts", F.struct(-F.col(ratio), F.col("ts"))).alias("max_ts"),
            F.min(ratio).alias("min_ratio"), F.min_by("ts", F.struct(F.col(ratio), F.col("ts"))).alias("min_ts"))
    yearly = agg([F.year("ts").alias("year")])
    return yearly.unionByName(agg([]).withColumn("year", F.lit(None).cast("int")))


def ratio_change_back(pairs: DataFrame, ratio: str = "close_ratio", keys: Sequence[str] = ("pair",),
                      back: Sequence[int] = (29, 364), size: int = BLOCK_BARS) -> DataFrame:
    """Change of the last ratio against the rows 29 and 364 before it."""
    df = _from_end(pairs, keys, size)
    now = F.max(F.when(F.col("back") == 0, F.col(ratio)))
    return df.groupBy(*keys).agg(now.alias("current_ratio"), *[
        ((F.try_divide(now, F.max(F.when(F.col("back") == n, F.col(ratio)))) - 1) * 100).alias(f"change_{n + 1}")
        for n in back])


def named_pair(snapshot: DataFrame, a: str, b: str) -> DataFrame:
    """Two named assets in one row per snapshot with the ratios of caps and prices."""
    def at(name, c):
        return F.max(F.when(F.col("ticker") == name, F.col(c)))
    out = (snapshot.filter(F.col("ticker").isin(a, b)).groupBy("snapshot_date").agg(
        at(a, "market_cap").alias("a_cap"), at(b, "market_cap").alias("b_cap"),
        at(a, "current_price").alias("a_price"), at(b, "current_price").alias("b_price")))
    return out.withColumns({"cap_ratio": F.try_divide("a_cap", "b_cap"),
                            "price_ratio": F.try_divide("a_price", "b_price")})


def overlap_profile(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row counts, ranges, shared days and shared months of two series, in one row."""
    def side(df, n):
        return df.agg(F.count("*").alias(f"{n}_rows"), F.min("ts").alias(f"{n}_first"),
                      F.max("ts").alias(f"{n}_last"))

    def shared(unit):
        x = a.select(F.date_trunc(unit, "ts").alias("u")).distinct()
        y = b.select(F.date_trunc(unit, "ts").alias("u")).distinct()
        return x.join(y, "u").agg(F.count("*").alias(f"common_{unit}s"))
    # four one-row frames
    return (side(a, "a").crossJoin(side(b, "b")).crossJoin(shared("day")).crossJoin(shared("month")))


def splice(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Old history only before the first row of the new history, then the new one."""
    starts = new.groupBy(*keys).agg(F.min("ts").alias("_start"))
    kept = (old.join(starts, list(keys), "left")
            .filter(F.col("_start").isNull() | (F.col("ts") < F.col("_start"))).drop("_start"))
    return kept.unionByName(new)
