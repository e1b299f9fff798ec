"""Parameter sweeps: shared sub-results per distinct setting, events instead of curves."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .indicators import ewm_lookback, span_alpha
from .performance import METRICS, finish_metrics
from .series import BLOCK_BARS, KEYS, Over, number_bars, running
from .signals import effective_events


# ---------------------------------------------------------------- simple mean


# what a stretch of a curve tells the stretches around it, for each state in which it may be entered
_PART = ("growth", "top", "low", "dip", "n", "mean", "m2", "up", "moved", "gain", "loss", "entries", "exits")
# the same of the prices alone
_HOLD = ("begin", "end", "c_top", "c_low", "c_dip", "c_n", "c_mean", "c_m2")


def _moments(r: np.ndarray) -> tuple[int, float, float]:
    mean = float(r.mean()) if len(r) else 0.0
    return len(r), mean, float(((r - mean) ** 2).sum())


def _hold(close: np.ndarray, change: np.ndarray) -> tuple:
    top = np.fmax.accumulate(close)
    return (close[0], close[-1], top[-1], np.fmin.reduce(close), np.fmin.reduce(close / top), *_moments(change))


def _part(side: np.ndarray, change: np.ndarray, first: bool, entered: bool) -> tuple:
    """Summary of a stretch entered long (or flat); ``first`` if it holds the first bar of the history."""
    at = np.maximum.accumulate(np.where(side != 0, np.arange(len(side)), -1))
    before = np.concatenate(([-1], at[:-1]))
    held = np.where(before >= 0, side[before] > 0, entered)
    r = np.where(held, change, 0.0)
    growth = np.cumprod(1 + r)
    top = np.maximum.accumulate(growth)
    acted = (side != 0) & ((side > 0) != held)
    r = r[int(first):]
    return (growth[-1], top[-1], growth.min(), (growth / top).min(), *_moments(r), int((r > 0).sum()), int((r != 0).sum()),
            float(r[r > 0].sum()), float(-r[r < 0].sum()), int((acted & (side > 0)).sum()), int((acted & (side < 0)).sum()))


def sweep_sma(bars: DataFrame, periods: Sequence[int] = range(100, 201), histories: Sequence[int] = (0,),
              capital: float = 10_000.0, spare: int = 50, size: int = BLOCK_BARS) -> DataFrame:
    """Metrics of the price/mean crossing per series, history length (days, 0 = all) and period.

    One running sum gives the mean of every period: (cs[t] - cs[t-n]) / n.  A history is the end of its series, so
    bars are numbered and summed once for all of them.  A block finds the crossings of a period and sums its curve up
    in one row for each state it may be entered in (growth, peak, trough, drawdown, moments, counts); a drawdown over a
    border is the least of that inside and of the trough against the peak before, x / max(a, b) = min(x / a, x / b).
    Only those rows leave a block: blocks x histories x periods, however many bars there are.  Prices are above 0 (or
    NULL, which makes no signal and no return); periods with fewer than ``spare`` bars beyond them are left out.
    """
    periods, histories = [int(p) for p in periods], [int(h) for h in histories]
    longest = max(periods)
    keyed = bars.select(*KEYS, "ts", "close")
    # a row a bar; read for the histories and for the blocks
    df = cut_lineage(running(keyed, {"_cs": ("sum", F.col("close"))}, KEYS, size))
    last = df.groupBy(*KEYS).agg(F.max("ts").alias("last_ts"), (F.max("bar_no") + 1).alias("_len"))

    def within(h: int):
        return F.lit(True) if h == 0 else F.col("ts") > F.col("last_ts") - F.make_dt_interval(F.lit(h))
    # one row a series: where each history starts
    facts = df.join(last, list(KEYS)).groupBy(*KEYS, "last_ts", "_len").agg(F.array(*[
        F.min(F.when(within(h), F.struct(F.col("bar_no").alias("start"), F.col("ts").alias("first_ts")))) for h in histories]).alias("_h"))
    spread = (df.withColumn("_blk", F.explode(F.sequence(F.floor(F.col("bar_no") / size),
                                                         F.floor((F.col("bar_no") + longest + 1) / size))))
              .join(facts.select(*KEYS, "_len", F.col("_h.start").alias("_starts")), list(KEYS))
              .select(*KEYS, "_blk", "bar_no", "close", "_cs", "_starts", "_len"))
    names = [f"{state}_{c}" for state in ("flat", "long") for c in _PART]
    fields = ", ".join(f"{c} double" for c in (*_HOLD, *names))

    def pieces(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_no", ignore_index=True)
        symbol, timeframe, blk, lead, length = (pdf[c].iat[0] for c in (*KEYS, "_blk", "bar_no", "_len"))
        close = pdf["close"].to_numpy(dtype=float)
        # before bar 0 the running sum is 0; elsewhere the lead-in is long enough
        sums = np.concatenate((np.zeros(longest + 2), pdf["_cs"].to_numpy(dtype=float)))
        found = []
        for history, start in zip(histories, pdf["_starts"].iat[0]):
            own = max(int(blk) * size, int(start)) - int(lead)
            usable = [n for n in periods if n + spare <= length - start]
            if own >= len(close) or not usable:
                continue
            first = own + lead == start
            c = close[own:]
            prev = np.concatenate(([np.nan], close))[own:-1]
            if first:
                prev[0] = np.nan
            change = np.divide(c, prev, out=np.ones_like(c), where=(prev != 0) & ~np.isnan(c) & ~np.isnan(prev)) - 1
            hold = _hold(c, change[int(first):])
            # bars of the history before the one at hand, from one bar earlier on
            at = np.arange(own - 1, len(close)) + lead - start
            for n in usable:
                end = longest + 2 + len(close)
                mean = np.where(at >= n - 1, (sums[longest + 1 + own:] - sums[longest + 1 + own - n:end - n]) / n, np.nan)
                now, then = mean[1:], mean[:-1]
                side = np.where((c > now) & (prev <= then), 1, np.where((c < now) & (prev >= then), -1, 0))
                hits = np.flatnonzero(side)
                found.append((symbol, timeframe, history, n, blk, len(hits), side[hits[-1]] if len(hits) else 0, *hold,
                              *_part(side, change, first, False), *_part(side, change, first, True)))
        return pd.DataFrame(found, columns=[*KEYS, "history", "sma_period", "_blk", "n_signals", "_side", *_HOLD, *names])
    parts = spread.groupBy(*KEYS, "_blk").applyInPandas(
        pieces, f"symbol string, timeframe string, history int, sma_period int, _blk bigint, n_signals bigint, _side int, {fields}")
    by = (*KEYS, "history", "sma_period")
    starts = facts.select(*KEYS, "last_ts", "_len", F.explode(F.arrays_zip(
        F.array(*[F.lit(h) for h in histories]).alias("history"), F.col("_h").alias("h"))).alias("_x"))
    starts = starts.select(*KEYS, F.col("_x.history").alias("history"), F.col("_x.h.first_ts").alias("first_ts"), "last_ts",
                           (F.col("_len") - F.col("_x.h.start")).alias("data_points"))
    return finish_metrics(_joined(parts, by, capital).join(starts, [*KEYS, "history"])).select(*by, *METRICS)


def _joined(parts: DataFrame, by: Sequence[str], capital: float) -> DataFrame:
    """One row a curve out of the summaries of its blocks; a block is entered as the last signal before it says."""
    before = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    side = F.when(F.col("_side") != 0, F.col("_side"))
    df = parts.withColumn("_long", F.coalesce(F.last(side, ignorenulls=True).over(before), F.lit(-1)) > 0)
    df = df.select(*by, "_blk", "n_signals", *_HOLD,
                   *[F.when(F.col("_long"), F.col(f"long_{c}")).otherwise(F.col(f"flat_{c}")).alias(c) for c in _PART])
    df = df.withColumns({"_g": F.coalesce(F.product("growth").over(before), F.lit(1.0)), "_c": F.max("c_top").over(before)})
    df = df.withColumn("_m", F.max(F.col("_g") * F.col("top")).over(before))

    def spread_of(n: str, mean: str, m2: str):
        """Sample deviation out of the moments of the parts."""
        count = F.sum(n)
        middle = F.try_divide(F.sum(F.col(n) * F.col(mean)), count)
        square = F.sum(m2) + F.sum(F.col(n) * F.col(mean) * F.col(mean)) - count * middle * middle
        return F.when(count > 1, F.sqrt(F.greatest(square, F.lit(0.0)) / (count - 1)))
    return df.groupBy(*by).agg(
        (F.product("growth") * capital).alias("final_value"), F.lit(capital).alias("_start"),
        (F.max_by("end", "_blk") / F.min_by("begin", "_blk") * capital).alias("benchmark_value"), F.lit(capital).alias("_bstart"),
        spread_of("n", "mean", "m2").alias("_sd"), spread_of("c_n", "c_mean", "c_m2").alias("_msd"),
        F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("mean_return"),
        (F.min(F.least("dip", F.col("_g") / F.col("_m") * F.col("low"))) - 1).alias("max_drawdown"),
        (F.min(F.least("c_dip", F.col("c_low") / F.col("_c"))) - 1).alias("benchmark_max_drawdown"),
        F.sum("up").alias("_up"), F.sum("moved").alias("_moved"), F.sum("gain").alias("_gain"), F.sum("loss").alias("_loss"),
        F.sum("n_signals").alias("n_signals"),
        F.sum("entries").cast("long").alias("n_entries"), F.sum("exits").cast("long").alias("n_exits"))


# ---------------------------------------------------------------- crossing events


def _event_trades(events: DataFrame, ends: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """Trades per parameter set out of signal rows (bar_no, close, signal_type) alone.

    Only the crossings leave a block, a few percent of bars x sets.  An open trade is
    closed at the last bar in ``is_open``.
    """
    # a few rows a series and set, read several times below
    events = cut_lineage(events)
    eff = effective_events(events, by, size).filter(F.col("event") != 0)
    entry = F.when(F.col("event") == 1, 1).otherwise(0)
    eff = running(eff, {"trade_no": ("sum", entry)}, by, size)
    pairs = eff.groupBy(*by, "trade_no").agg(
        F.max(F.when(F.col("event") == 1, F.col("close"))).alias("entry_price"),
        F.max(F.when(F.col("event") == -1, F.col("close"))).alias("exit_price"))
    return (pairs.join(ends, list(KEYS))
            .withColumns({"is_open": F.col("exit_price").isNull(),
                          "growth": F.coalesce("exit_price", "_end") / F.col("entry_price")})
            .withColumn("return_pct", F.when(~F.col("is_open"), (F.col("growth") - 1) * 100)).drop("_end"))


def _summarise(trades: DataFrame, by: Sequence[str], capital: float) -> DataFrame:
    r = F.col("return_pct")
    move = F.col("exit_price") - F.col("entry_price")
    agg = trades.groupBy(*by).agg(
        # a product as a sum of logarithms cannot overflow
        (F.exp(F.sum(F.log("growth"))) * capital).alias("final_capital"),
        F.count(r).alias("total_trades"), F.count_if(r > 0).alias("_wins"),
        F.avg(r).alias("_mean"), F.stddev_pop(r).alias("_sd"), F.stddev_pop(F.when(r < 0, r)).alias("_down"),
        F.sum(F.when(move > 0, move).otherwise(0.0)).alias("_won"),
        F.sum(F.when(move < 0, -move).otherwise(0.0)).alias("_lost"))
    down = F.coalesce(F.when(F.col("_down") > 0, F.col("_down")), F.lit(0.01))
    return agg.withColumns({
        "total_return": (F.col("final_capital") / capital - 1) * 100,
        "win_rate": F.coalesce(F.try_divide(F.col("_wins"), F.col("total_trades")) * 100, F.lit(0.0)),
        "sharpe": F.coalesce(F.try_divide("_mean", "_sd"), F.lit(0.0)),
        "sortino": F.col("_mean") / down * 252 ** 0.5,
        "profit_factor": F.try_divide("_won", "_lost")}).drop("_wins", "_mean", "_sd", "_down", "_won", "_lost")


def _ends(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*KEYS).agg(F.max_by("close", "ts").alias("_end"))


def _per_block(bars: DataFrame, lookback: int, slices: Sequence, fn, out_fields: str, size: int) -> DataFrame:
    """Run a numpy function per block, with its lead-in, and slice of the grid; it emits rows for own bars only.

    A slice sees the whole block, so one long series keeps as many tasks busy as it has blocks times slices.
    """
    numbered = bars if "bar_no" in bars.columns else number_bars(bars, KEYS, size)
    spread = (numbered.withColumn("_home", F.floor(F.col("bar_no") / size))
              .withColumn("_blk", F.explode(F.sequence(
                  F.floor(F.col("bar_no") / size), F.floor((F.col("bar_no") + lookback) / size))))
              .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(len(slices) - 1)))))
    schema = f"symbol string, timeframe string, bar_no bigint, close double, {out_fields}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values("bar_no", ignore_index=True), slices[int(pdf["_slice"].iat[0])])
    return spread.groupBy(*Over(KEYS).keys, "_slice").applyInPandas(run, schema)


def _ewm(x: np.ndarray, alphas: np.ndarray, first_no: int) -> np.ndarray:
    """Normalised exponential means of the columns of x, all smoothing factors at once."""
    columns = x.reshape(len(x), -1)
    q = np.maximum(1.0 - alphas, 1e-12)
    # inside a segment the weighted values are a running sum; the end of the one before is carried over
    step = int(min(64, max(1, 600 / -np.log(q.min()))))
    j = np.arange(step)[:, None]
    up, down = (q[None] ** -j)[:, None], (q[None] ** j)[:, None]
    out = np.empty((len(x), columns.shape[1], len(alphas)))
    carry = np.zeros(out.shape[1:])
    for at in range(0, len(x), step):
        part = columns[at:at + step, :, None]
        k = len(part)
        out[at:at + k] = (np.cumsum(part * up[:k], axis=0) + carry * q) * down[:k]
        carry = out[at + k - 1]
    out /= ((1 - q ** (np.arange(len(x))[:, None] + 1)) / (1 - q))[:, None]
    return out if x.ndim == 2 else out[:, 0]


def sweep_macd(bars: DataFrame, fast: Sequence[int] = range(5, 20), slow: Sequence[int] = range(20, 35),
               signal: Sequence[int] = range(5, 15), capital: float = 10_000.0,
               size: int = BLOCK_BARS, sets: Sequence[tuple[int, int, int]] | None = None) -> DataFrame:
    """Return, trades and win rate of every (fast, slow, signal) with fast below slow, or of those in ``sets``.

    The signal line is linear in its input, so it is the difference of two smoothed means
    that depend on one span each: 30 spans x 10 signals instead of 2,250 sets.  A block
    computes those with numpy, a task for each signal span, and emits only the crossings.
    """
    sets = [x for x in (product(fast, slow, signal) if sets is None else sets) if x[0] < x[1]]
    signal = sorted({g for _, _, g in sets})
    spans = sorted({n for f, s, _ in sets for n in (f, s)})
    col = {s: i for i, s in enumerate(spans)}
    pairs = {g: np.array([x[:2] for x in sets if x[2] == g], dtype=np.int64) for g in signal}
    back = 2 * max(ewm_lookback(span_alpha(s)) for s in (*spans, *signal)) + 1

    def fn(pdf: pd.DataFrame, signals: Sequence[int]) -> pd.DataFrame:
        close, no = pdf["close"].to_numpy(), pdf["bar_no"].to_numpy()
        mean = _ewm(close, np.array([span_alpha(s) for s in spans]), no[0])
        own = no // size == pdf["_blk"].to_numpy()
        found = []
        for g in signals:
            f, s = ([col[x] for x in side] for side in pairs[g].T)
            smooth = _ewm(mean, np.array([span_alpha(g)]), no[0])[:, :, 0]
            gap = mean[:, f] - mean[:, s] - (smooth[:, f] - smooth[:, s])
            up = (gap[1:] > 0) & (gap[:-1] <= 0)
            down = (gap[1:] < 0) & (gap[:-1] >= 0)
            hit = (up | down) & own[1:, None]
            at, which = np.nonzero(hit)
            found.append(pd.DataFrame({
                "symbol": pdf["symbol"].iat[0], "timeframe": pdf["timeframe"].iat[0], "bar_no": no[at + 1],
                "close": close[at + 1], "fast": pairs[g][which, 0].astype(np.int32),
                "slow": pairs[g][which, 1].astype(np.int32), "signal": np.int32(g),
                "signal_type": np.where(up[at, which], 1, -1).astype(np.int32)}))
        return pd.concat(found, ignore_index=True)
    by = (*KEYS, "fast", "slow", "signal")
    events = _per_block(bars.select(*KEYS, "ts", "close"), back, [[g] for g in signal], fn,
                        "fast int, slow int, signal int, signal_type int", size)
    return _summarise(_event_trades(events, _ends(bars), by, size), by, capital)


def sweep_knn(bars: DataFrame, ks: Sequence[int], windows: Sequence[int], ma_lens: Sequence[int],
              smoothings: Sequence[int] = (50,), capital: float = 10_000.0, size: int = BLOCK_BARS) -> DataFrame:
    """Trades of the nearest-value trend over a grid (zero-filled warm-up).

    Invalid sets (window below K, smoothing below 5, length below 2) are left out.  The
    smoothing length does not touch the signals, so results are computed per
    (K, window, length) and repeated for each smoothing; distances are sorted once per
    (window, length) and give every K as a prefix.
    """
    smoothings = [s for s in smoothings if s >= 5]
    grid = [(m, w, sorted(k for k in ks if k <= w)) for m, w in product(ma_lens, windows) if m >= 2]
    back = max(ewm_lookback(span_alpha(m)) for m, _, _ in grid) + max(windows) + max(ma_lens) + 10

    def fn(pdf: pd.DataFrame, cells: Sequence[tuple]) -> pd.DataFrame:
        no, close = pdf["bar_no"].to_numpy(), pdf["close"].to_numpy()
        hl2 = (pdf["high"].to_numpy() + pdf["low"].to_numpy()) / 2
        own = no // size == pdf["_blk"].to_numpy()
        found = []
        for m, w, k_list in cells:
            value = pd.Series(hl2).rolling(m, min_periods=1).mean().to_numpy()
            target = pd.Series(close).ewm(span=m, adjust=False).mean().to_numpy()
            if len(no) <= w or not k_list:
                continue
            past = np.lib.stride_tricks.sliding_window_view(value, w)[:-1][:, ::-1]
            gap = np.abs(past - target[w:, None])
            order = np.argsort(gap, axis=1, kind="stable")
            sums = np.cumsum(np.take_along_axis(past, order, axis=1), axis=1)
            for k in k_list:
                line = np.zeros(len(no))
                line[w:] = sums[:, k - 1] / k
                smooth = np.zeros(len(no))
                if len(no) >= 5:
                    smooth[4:] = np.lib.stride_tricks.sliding_window_view(line, 5) @ (np.arange(1, 6) / 15)
                trend = np.zeros(len(no), dtype=np.int8)
                trend[1:] = np.sign(smooth[1:] - smooth[:-1]) * (smooth[1:] > 0)
                hit = np.flatnonzero((trend[1:] * trend[:-1] < 0) & own[1:]) + 1
                found.append(pd.DataFrame({
                    "symbol": pdf["symbol"].iat[0], "timeframe": pdf["timeframe"].iat[0], "bar_no": no[hit],
                    "close": close[hit], "k": np.int32(k), "window": np.int32(w), "ma_len": np.int32(m),
                    "signal_type": trend[hit].astype(np.int32)}))
        if not found:
            return pd.DataFrame({"symbol": pd.Series([], dtype=object), "timeframe": pd.Series([], dtype=object),
                                 "bar_no": no[:0], "close": close[:0],
                                 **{c: np.empty(0, np.int32) for c in ("k", "window", "ma_len", "signal_type")}})
        return pd.concat(found, ignore_index=True)
    by = (*KEYS, "k", "window", "ma_len")
    events = _per_block(bars.select(*KEYS, "ts", "high", "low", "close"), back, [[cell] for cell in grid], fn,
                        "k int, window int, ma_len int, signal_type int", size)
    out = _summarise(_event_trades(events, _ends(bars), by, size), by, capital)
    return out.withColumn("smoothing", F.explode(F.array(*[F.lit(s) for s in smoothings])))


def sample_params(params: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Seeded sample of a grid, the same on every run and cluster."""
    rank = F.md5(F.concat_ws(",", *params.columns, F.lit(str(seed))))
    return params.orderBy(rank, *params.columns).limit(n)


def grid(spark, **axes: Sequence[int]) -> DataFrame:
    """Cartesian product of the axes as a table with a ``param_id``."""
    names = list(axes)
    rows = [(i, *row) for i, row in enumerate(product(*axes.values()))]
    return spark.createDataFrame(rows, "param_id int, " + ", ".join(f"{n} int" for n in names))


def with_best_params(bars: DataFrame, best: DataFrame, default: dict[str, int],
                     by: Sequence[str] = ("timeframe",)) -> DataFrame:
    """Parameters of the bar's timeframe, the default where none is known."""
    joined = bars.join(best, list(by), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in default.items()})


def timeframe_comparison(bars: DataFrame, fast, slow, signal, capital: float = 10_000.0,
                         size: int = BLOCK_BARS) -> DataFrame:
    """Best parameters per series and timeframe beside points, days and buy-and-hold."""
    from .performance import best_by
    from .series import epoch_seconds
    res = sweep_macd(bars, fast, slow, signal, capital, size).withColumn("total_return", F.round("total_return", 4))
    best = best_by(res, "total_return", KEYS, ("fast", "slow", "signal")).select(
        *KEYS, "fast", "slow", "signal", "total_return", "total_trades", "win_rate", "final_capital")
    span = (epoch_seconds(F.max("ts")) - epoch_seconds(F.min("ts"))) / 86400
    shape = bars.groupBy(*KEYS).agg(
        F.count("*").alias("data_points"), F.floor(span).alias("actual_days"),
        ((F.max_by("close", "ts") / F.min_by("close", "ts") - 1) * 100).alias("buy_hold_return"))
    return best.join(shape, list(KEYS))


def compare_benchmark(metrics: DataFrame) -> DataFrame:
    """Strategy beside its benchmark with difference columns."""
    return metrics.select(
        *KEYS, "total_return", "benchmark_return",
        (F.col("total_return") - F.col("benchmark_return")).alias("difference"),
        (F.col("max_drawdown") - F.col("benchmark_max_drawdown")).alias("drawdown_difference"))


def strategy_report(runs: dict[str, DataFrame]) -> DataFrame:
    """Rows per named run and its benchmark (the benchmark of the first run)."""
    rows = None
    for i, (name, m) in enumerate(runs.items()):
        parts = [m.select(F.lit(name).alias("series"), "symbol", "total_return", "max_drawdown")]
        if i == 0:
            parts.append(m.select(F.lit("benchmark").alias("series"), "symbol",
                                  F.col("benchmark_return").alias("total_return"),
                                  F.col("benchmark_max_drawdown").alias("max_drawdown")))
        for p in parts:
            rows = p if rows is None else rows.unionByName(p)
    return rows
