"""Signals, positions, events, trades and excursions on blocked series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import add_regime, add_rsi, add_volume_features, add_macd, cross, macd_lookback, sma
from .series import BLOCK_BARS, KEYS, Over, blocked, number_bars, running, windowed


def sma_cross(bars: DataFrame, n: int, size: int = BLOCK_BARS, keep_block: bool = False) -> DataFrame:
    """Close against its simple mean: +1 / -1 / 0 in ``signal_type``."""
    def fn(df, o):
        df = df.withColumn("sma", sma(F.col("close"), n, o))
        return df.withColumn("signal_type", cross(F.col("close"), F.col("sma"), o))
    return windowed(bars, fn, n + 1, size=size, keep_block=keep_block)


def position(signals: DataFrame, keys: Sequence[str] = KEYS, size: int = BLOCK_BARS) -> DataFrame:
    """1 while the last non-zero signal is a buy, 0 before the first signal."""
    side = F.when(F.col("signal_type") != 0, F.col("signal_type"))
    out = running(signals, {"_side": ("last", side)}, keys, size)
    return out.withColumn("position", F.when(F.col("_side") > 0, 1).otherwise(0)).drop("_side")


def effective_events(signals: DataFrame, keys: Sequence[str] = KEYS, size: int = BLOCK_BARS) -> DataFrame:
    """``event``: a buy while flat or a sell while long; every other signal is dropped."""
    side = F.when(F.col("signal_type") != 0, F.col("signal_type"))
    out = running(signals, {"_was": ("last", side)}, keys, size, before=True)
    state = F.coalesce("_was", F.lit(-1))
    keep = (F.col("signal_type") != 0) & (F.col("signal_type") != state)
    return out.withColumn("event", F.when(keep, F.col("signal_type")).otherwise(0)).drop("_was")


def position_status(events: DataFrame) -> DataFrame:
    return events.withColumn("position_status", F.when(F.col("event") == 1, "BUY")
                             .when(F.col("event") == -1, "SELL").otherwise("HOLD"))


def equity_curve(signals: DataFrame, capital: float = 10_000.0, fee: float = 0.0,
                 keys: Sequence[str] = KEYS, size: int = BLOCK_BARS) -> DataFrame:
    """Per-bar position, event, trade number, equity, peak, drawdown and benchmark.

    Needs ``signal_type`` and ``close``.  A block does not know whether the series
    enters it long or flat, so both cases are worked out inside the block; one row a
    block then decides, multiplies and compares across blocks, and one join brings
    the entry state back.  The bars are shuffled once.
    """
    df = blocked(signals, keys, size)
    o = Over(keys)
    side = F.when(F.col("signal_type") != 0, F.col("signal_type"))
    df = df.withColumns({
        "_was": F.last(side, ignorenulls=True).over(o.before),
        "_prev_close": F.lag("close", 1).over(o.ordered)})
    # the first bar of a block takes its previous close from the block table
    edges = df.groupBy(*keys, "_blk").agg(
        F.max_by("close", "bar_no").alias("_end"), F.min_by("close", "bar_no").alias("_begin"),
        F.max_by(side, F.when(side.isNotNull(), F.col("bar_no"))).alias("_side"))
    by_block = Window.partitionBy(*keys).orderBy("_blk")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        *keys, "_blk", F.lag("_end", 1).over(by_block).alias("_prev_end"),
        F.first("_begin").over(by_block).alias("first_close"),
        (F.coalesce(F.last("_side", ignorenulls=True).over(before), F.lit(-1)) > 0).alias("_long_in"))
    df = df.join(edges, [*keys, "_blk"])
    was_long = F.coalesce(F.col("_was") > 0, F.col("_long_in"))
    change = F.coalesce(F.try_divide(F.col("close"), F.coalesce("_prev_close", "_prev_end")) - 1, F.lit(0.0))
    keep = (F.col("signal_type") != 0) & ((F.col("signal_type") > 0) != was_long)
    df = df.withColumns({"market_return": change,
                         "event": F.when(keep, F.col("signal_type")).otherwise(0),
                         "_held": was_long.cast("int")})
    df = df.withColumns({
        "position": F.when(F.col("signal_type") != 0, (F.col("signal_type") > 0).cast("int"))
        .otherwise(F.col("_held")),
        "strategy_return": F.col("_held") * F.col("market_return")})
    step = (1 + F.col("strategy_return")) * F.when(F.col("event") != 0, F.lit(1.0 - fee)).otherwise(1.0)
    df = df.withColumn("_step", step)
    df = df.withColumns({"_g": F.product("_step").over(o.so_far),
                         "_n": F.sum(F.when(F.col("event") == 1, 1).otherwise(0)).over(o.so_far)})
    df = df.withColumns({"_m": F.max("_g").over(o.so_far),
                         "_mb": F.max("close").over(o.so_far)})
    totals = df.groupBy(*keys, "_blk").agg(
        F.max_by("_g", "bar_no").alias("_tg"), F.max("_m").alias("_tm"), F.max("_n").alias("_tn"),
        F.max("_mb").alias("_tb"))
    totals = totals.select(*keys, "_blk", "_tm",
                           F.coalesce(F.product("_tg").over(before), F.lit(1.0)).alias("_g_in"),
                           F.coalesce(F.sum("_tn").over(before), F.lit(0)).alias("_n_in"),
                           F.max("_tb").over(before).alias("_b_in"))
    totals = totals.select(*keys, "_blk", "_g_in", "_n_in", "_b_in",
                           F.max(F.col("_g_in") * F.col("_tm")).over(before).alias("_m_in"))
    df = df.join(totals, [*keys, "_blk"])
    growth = F.col("_g_in") * F.col("_g")
    peak = F.greatest(F.col("_m_in"), F.col("_g_in") * F.col("_m"))
    hold_peak = F.greatest("_b_in", "_mb")
    df = df.withColumns({
        "equity": growth * capital,
        "drawdown": growth / peak - 1,
        "benchmark": F.col("close") / F.col("first_close") * capital,
        "benchmark_drawdown": F.col("close") / hold_peak - 1,
        "trade_no": F.col("_n_in") + F.col("_n")})
    return df.drop("_was", "_prev_close", "_prev_end", "_long_in", "_held", "_step", "_g", "_n", "_m",
                   "_mb", "_g_in", "_n_in", "_m_in", "_b_in", "first_close", "_blk")


def pair_trades(curve: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Entries with their exits, by trade number; an open trade has NULL exit columns."""
    events = curve.filter((F.col("event") != 0) & (F.col("trade_no") > 0))
    entry, exit_ = F.col("event") == 1, F.col("event") == -1

    def at(cond: Column, c: str) -> Column:
        return F.max(F.when(cond, F.col(c)))
    return (events.groupBy(*keys, "trade_no").agg(
        at(entry, "ts").alias("entry_ts"), at(exit_, "ts").alias("exit_ts"),
        at(entry, "close").alias("entry_price"), at(exit_, "close").alias("exit_price"),
        at(entry, "equity").alias("entry_equity"), at(exit_, "equity").alias("exit_equity"),
        (at(exit_, "bar_no") - at(entry, "bar_no")).alias("bars_held"))
        .withColumn("return_pct", (F.col("exit_price") / F.col("entry_price") - 1) * 100))


def transactions(trades: DataFrame, keys: Sequence[str] = KEYS, stake: float | None = None) -> DataFrame:
    """Two rows a closed trade (one while open) with quantity, profit and portfolio value.

    With ``stake`` every trade is entered with that fixed amount (the store form),
    otherwise with the equity at the entry.
    """
    if stake is not None:
        trades = trades.filter(F.col("exit_ts").isNotNull())
    cash = F.lit(stake) if stake is not None else F.col("entry_equity")
    qty = cash / F.col("entry_price")
    buy = F.struct(F.lit("BUY").alias("action"), F.col("entry_ts").alias("ts"),
                   F.col("entry_price").alias("price"), qty.alias("quantity"),
                   F.lit(None).cast("double").alias("profit"), F.lit(None).cast("double").alias("return_pct"),
                   cash.alias("portfolio_value"))
    sell = F.struct(F.lit("SELL").alias("action"), F.col("exit_ts").alias("ts"),
                    F.col("exit_price").alias("price"), qty.alias("quantity"),
                    ((F.col("exit_price") - F.col("entry_price")) * qty).alias("profit"),
                    F.col("return_pct"), (qty * F.col("exit_price")).alias("portfolio_value"))
    return (trades.select(*keys, "trade_no", F.explode(F.array(buy, sell)).alias("_t"))
            .select(*keys, "trade_no", "_t.*").filter(F.col("ts").isNotNull()))


def _runs(rows: DataFrame, flip: Column, keys: Sequence[str], size: int) -> DataFrame:
    """Add ``run``, the number of side changes so far, to rows numbered by ``bar_no``; ``flip`` may look one row back."""
    rows = windowed(rows.drop("_blk"), lambda df, o: df.withColumn("_flip", F.when(F.lag(flip, 1).over(o.ordered) != flip, 1).otherwise(0)),
                    1, keys=keys, size=size)
    return running(rows, {"run": ("sum", F.col("_flip"))}, keys, size).drop("_flip")


def next_opposite(signals: DataFrame, keys: Sequence[str] = KEYS, size: int = BLOCK_BARS) -> DataFrame:
    """Each non-zero signal with the first later signal of the other side (else NULL).

    Signals of one side in a row are a run; the first signal of the next run is the successor of them all, and
    comes by a join on the run's number.
    """
    s = signals.filter(F.col("signal_type") != 0).drop("_blk").withColumnRenamed("bar_no", "_at")
    s = _runs(number_bars(s, keys, size, order="_at"), F.col("signal_type"), keys, size)
    s = s.drop("bar_no").withColumnRenamed("_at", "bar_no")
    first = s.groupBy(*keys, (F.col("run") - 1).alias("run")).agg(F.min_by(F.struct("bar_no", "ts", "close"), "bar_no").alias("_nx"))
    return (s.join(first, [*keys, "run"], "left")
            .withColumns({"next_bar_no": F.col("_nx.bar_no"), "next_ts": F.col("_nx.ts"),
                          "next_close": F.col("_nx.close")}).drop("_nx", "run"))


def excursions(signals: DataFrame, keys: Sequence[str] = KEYS, size: int = BLOCK_BARS) -> DataFrame:
    """Best/worst price between a signal and the next opposite one.

    Bars are first reduced to one row per stretch between two signals (an aggregate
    with map-side combine); only those rows are looked at together.
    """
    fired = F.when(F.col("signal_type") != 0, 1).otherwise(0)
    df = running(signals, {"seg": ("sum", fired)}, keys, size)
    extra = [c for c in ("macd", "macd_signal", "histogram") if c in signals.columns]
    seg = df.filter(F.col("seg") > 0).groupBy(*keys, "seg").agg(
        F.min_by(F.struct("bar_no", "ts", "close", "signal_type", *extra), "bar_no").alias("s"),
        F.max(F.struct(F.col("close"), (-F.col("bar_no")).alias("at"))).alias("hi"),
        F.min(F.struct(F.col("close"), F.col("bar_no").alias("at"))).alias("lo"))
    side = F.col("s.signal_type")
    seg = _runs(seg.withColumn("bar_no", F.col("seg")), side, keys, size).drop("bar_no")
    # the bar that ends a run is the first bar of the next one
    ends = seg.groupBy(*keys, (F.col("run") - 1).alias("run")).agg(F.min_by("s", "seg").alias("_next"))
    rest = Window.partitionBy(*keys, "run").orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, 0)
    seg = seg.withColumns({"_hi": F.max("hi").over(rest), "_lo": F.min("lo").over(rest)}).join(ends, [*keys, "run"])
    x = F.col("_next")
    hi = F.greatest(F.col("_hi"), F.struct(x["close"].alias("close"), (-x["bar_no"]).alias("at")))
    lo = F.least(F.col("_lo"), F.struct(x["close"].alias("close"), x["bar_no"].alias("at")))
    buy = side == 1
    seg = seg.withColumns({"_h": hi, "_l": lo})
    p = F.col("s.close")
    held = x["bar_no"] - F.col("s.bar_no")
    return seg.select(
        *keys, F.when(buy, "BUY").otherwise("SELL").alias("signal_type"),
        F.col("s.ts").alias("entry_time"), x["ts"].alias("exit_time"),
        p.alias("entry_price"), x["close"].alias("exit_price"),
        F.when(buy, F.col("_h")["close"]).otherwise(F.col("_l")["close"]).alias("extreme_price"),
        F.when(buy, (F.col("_h")["close"] - p) / p * 100).alias("max_gain_pct"),
        F.when(~buy, F.abs((F.col("_l")["close"] - p) / p * 100)).alias("max_drop_pct"),
        (F.when(buy, x["close"] - p).otherwise(p - x["close"]) / p * 100).alias("final_return_pct"),
        (F.when(buy, -F.col("_h")["at"]).otherwise(F.col("_l")["at"]) - F.col("s.bar_no")
         ).alias("duration_to_extreme"),
        F.when(buy, held).alias("holding_period_duration"),
        F.when(~buy, held).alias("waiting_period_duration"),
        *[F.col(f"s.{c}").alias(c) for c in extra])


def signal_stats(exc: DataFrame, by: Sequence[str] = ("timeframe",)) -> DataFrame:
    """Quality of signals per side: excursion, result, hit rate and duration."""
    reach = F.coalesce("max_gain_pct", "max_drop_pct")
    bars = F.coalesce("holding_period_duration", "waiting_period_duration")
    r = F.col("final_return_pct")
    return (exc.groupBy(*by, "signal_type").agg(
        F.count("*").alias("n_signals"),
        F.avg(reach).alias("avg_excursion"), F.median(reach).alias("median_excursion"),
        F.max(reach).alias("best_excursion"), F.min(reach).alias("worst_excursion"),
        F.avg(r).alias("avg_result"), F.max(r).alias("best_result"), F.min(r).alias("worst_result"),
        F.count_if(r > 0).alias("positive_signals"),
        F.avg(bars).alias("avg_duration"), F.median(bars).alias("median_duration"))
        .withColumn("positive_rate", F.col("positive_signals") / F.col("n_signals") * 100))


# ---------------------------------------------------------------- composite volume signals


def volume_signals(bars: DataFrame, levels: DataFrame, size: int = BLOCK_BARS) -> DataFrame:
    """Twelve trading flags from volume features, trend, RSI and profile levels.

    ``levels`` has one row a series: poc_price, va_high, va_low.
    """
    def fn(df, o):
        df = add_volume_features(df, o)
        df = add_regime(df, o)
        df = add_macd(df, o, 12, 26, 9)
        return add_rsi(df, o, F.col("close"), "rsi", 14)
    df = windowed(bars, fn, macd_lookback(12, 26, 9) + 50, size=size)
    df = df.join(levels.select("symbol", "poc_price", "va_high", "va_low"), "symbol", "left")
    up, down, flat = (F.col("regime") == r for r in ("up", "down", "ranging"))
    vr, r, c = F.col("volume_ratio"), F.col("rsi"), F.col("close")
    # the change of the cumulative delta is the delta; the first bar has no change
    d = F.when(F.col("bar_no") > 0, F.col("volume_delta"))
    pm, vm = F.col("price_momentum"), F.col("volume_momentum")
    macd_up, macd_down = F.col("macd") > F.col("macd_signal"), F.col("macd") < F.col("macd_signal")
    flags = {
        "volume_breakout": vr > 2.5,
        "volume_confirmation": (vr > 1.5) & (vr < 3.0),
        "institutional": F.col("institutional_flow") > 0,
        "bullish_trend": up & macd_up & (r > 45) & (r < 75) & (d > 0),
        "bearish_trend": down & macd_down & (r < 55) & (r > 25) & (d < 0),
        "poc_support": (c <= F.col("poc_price") * 1.02) & (c >= F.col("poc_price") * 0.98) & up & (vr > 1.2),
        "va_breakout": ((c > F.col("va_high")) & up) | ((c < F.col("va_low")) & down),
        "oversold_reversal": flat & (r < 30) & (vr > 1.5) & (d > 0),
        "overbought_reversal": flat & (r > 70) & (vr > 1.5) & (d < 0),
        "bullish_divergence": (pm < -0.02) & (vm > 0.1) & (r < 40),
        "bearish_divergence": (pm > 0.02) & (vm < -0.1) & (r > 60),
        "profit_take": (r > 80) | (r < 20) | (vr < 0.5)}
    return df.withColumns({k: F.coalesce(v, F.lit(False)).cast("int") for k, v in flags.items()})


# fixed weights of the flags in the long and short score
LONG_WEIGHTS = (("bullish_trend", 3), ("poc_support", 2), ("oversold_reversal", 2),
                ("bullish_divergence", 2), ("volume_breakout", 1), ("institutional", 1))
SHORT_WEIGHTS = (("bearish_trend", 3), ("va_breakout", 2), ("overbought_reversal", 2),
                 ("bearish_divergence", 2))


def target_position(signals: DataFrame, max_position: float = 0.1,
                    keys: Sequence[str] = KEYS, fixed: bool = False) -> DataFrame:
    """Weighted long minus short score, each scaled by its series maximum.

    ``fixed`` scales by the sum of weights instead (11 and 9).
    """
    score = {"long_score": sum(F.col(c) * w for c, w in LONG_WEIGHTS),
             "short_score": sum(F.col(c) * w for c, w in SHORT_WEIGHTS)}
    df = signals.withColumns(score)
    if fixed:
        hi_l, hi_s = F.lit(float(sum(w for _, w in LONG_WEIGHTS))), F.lit(float(sum(w for _, w in SHORT_WEIGHTS)))
    else:
        peak = df.groupBy(*keys).agg(F.max("long_score").alias("_ml"), F.max("short_score").alias("_ms"))
        df = df.join(peak, list(keys))
        hi_l = F.when(F.col("_ml") > 0, F.col("_ml")).otherwise(1)
        hi_s = F.when(F.col("_ms") > 0, F.col("_ms")).otherwise(1)
    return df.withColumn("target_position", F.col("long_score") / hi_l * max_position
                         - F.col("short_score") / hi_s * max_position).drop("_ml", "_ms")
