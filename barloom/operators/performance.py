"""Performance metrics: one row per series (and parameter set)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import BLOCK_BARS, KEYS, epoch_seconds, running

DAYS_PER_YEAR = 365.25
PERIODS_8H = 365 * 24 / 8


def curve_metrics(curve: DataFrame, keys: Sequence[str] = KEYS, periods: float = PERIODS_8H) -> DataFrame:
    """Return, annualised returns, volatility, Sharpe, drawdown, hit rate, trade counts.

    One aggregate over ``signals.equity_curve``; partial rows combine before the shuffle.
    """
    r = F.when(F.col("bar_no") > 0, F.col("strategy_return"))
    m = F.when(F.col("bar_no") > 0, F.col("market_return"))
    agg = curve.groupBy(*keys).agg(
        F.count("*").alias("data_points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.max_by("equity", "ts").alias("final_value"),
        F.min_by("equity", "ts").alias("_start"),
        F.max_by("benchmark", "ts").alias("benchmark_value"),
        F.min_by("benchmark", "ts").alias("_bstart"),
        F.stddev_samp(r).alias("_sd"), F.stddev_samp(m).alias("_msd"),
        F.avg(r).alias("mean_return"),
        F.min("drawdown").alias("max_drawdown"), F.min("benchmark_drawdown").alias("benchmark_max_drawdown"),
        F.count_if(r > 0).alias("_up"), F.count_if(r != 0).alias("_moved"),
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("_gain"),
        F.sum(F.when(r < 0, -r).otherwise(0.0)).alias("_loss"),
        F.count_if(F.col("signal_type") != 0).alias("n_signals"),
        F.count_if(F.col("event") == 1).alias("n_entries"),
        F.count_if(F.col("event") == -1).alias("n_exits"))
    return finish_metrics(agg, periods)


# columns of curve_metrics and sweeps
METRICS = ("data_points", "first_ts", "last_ts", "final_value", "benchmark_value", "mean_return", "max_drawdown",
           "benchmark_max_drawdown", "n_signals", "n_entries", "n_exits", "total_return", "benchmark_return",
           "outperformance", "annualized_periods", "annualized_rows", "annualized_days", "volatility",
           "benchmark_volatility", "volatility_252", "bar_win_rate", "bar_profit_factor", "sharpe_annual", "sharpe_252")


def finish_metrics(agg: DataFrame, periods: float = PERIODS_8H) -> DataFrame:
    """Ratios and annual rates out of the sums of a curve."""
    n = F.col("data_points") - 1
    total = F.col("final_value") / F.col("_start") - 1
    bench = F.col("benchmark_value") / F.col("_bstart") - 1
    agg = agg.withColumns({"total_return": total, "benchmark_return": bench})
    span = F.floor((epoch_seconds(F.col("last_ts")) - epoch_seconds(F.col("first_ts"))) / 86400)
    return agg.withColumns({
        "outperformance": F.col("total_return") - F.col("benchmark_return"),
        "annualized_periods": annualise(F.col("total_return"), F.try_divide(F.lit(periods), n)),
        "annualized_rows": annualise(F.col("total_return"), F.try_divide(F.lit(DAYS_PER_YEAR), F.col("data_points"))),
        "annualized_days": annualise(F.col("total_return"), F.try_divide(F.lit(DAYS_PER_YEAR), span)),
        "volatility": F.col("_sd") * periods ** 0.5,
        "benchmark_volatility": F.col("_msd") * periods ** 0.5,
        "volatility_252": F.col("_sd") * 252 ** 0.5,
        "bar_win_rate": F.coalesce(F.try_divide(F.col("_up"), F.col("_moved")), F.lit(0.0)),
        "bar_profit_factor": F.col("_gain") / F.when(F.col("_loss") > 0, F.col("_loss")).otherwise(0.01)}
    ).withColumns({
        "sharpe_annual": F.coalesce(F.try_divide("annualized_periods", "volatility"), F.lit(0.0)),
        "sharpe_252": F.coalesce(F.try_divide(F.col("mean_return") * 252, F.col("volatility_252")), F.lit(0.0))
    }).drop("_start", "_bstart", "_sd", "_msd", "_up", "_moved", "_gain", "_loss")


def annualise(total: Column, exponent: Column) -> Column:
    """(1 + total) to the given power, minus 1; NULL when the base is negative."""
    return F.when(1 + total >= 0, F.pow(1 + total, exponent)) - 1


def trade_metrics(trades: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Closed trades: counts, win rate, gains, losses, Sharpe, Sortino, profit factors."""
    closed = trades.filter(F.col("exit_ts").isNotNull())
    r = F.col("return_pct")
    move = F.col("exit_price") - F.col("entry_price")
    agg = closed.groupBy(*keys).agg(
        F.count("*").alias("total_trades"), F.count_if(r > 0).alias("winning_trades"),
        F.count_if(r < 0).alias("losing_trades"),
        F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_gain"),
        F.coalesce(F.avg(F.when(r < 0, r)), F.lit(0.0)).alias("avg_loss"),
        F.max(r).alias("max_gain"), F.min(r).alias("max_loss"),
        F.avg(r).alias("mean_return"), F.stddev_pop(r).alias("_sd"),
        F.stddev_pop(F.when(r < 0, r)).alias("_down"),
        F.sum(F.when(move > 0, move).otherwise(0.0)).alias("_won"),
        F.sum(F.when(move < 0, -move).otherwise(0.0)).alias("_lost"))
    down = F.coalesce(F.when(F.col("_down") > 0, F.col("_down")), F.lit(0.01))
    return agg.withColumns({
        "win_rate": F.col("winning_trades") / F.col("total_trades") * 100,
        "sharpe_trades": F.coalesce(F.try_divide("mean_return", "_sd"), F.lit(0.0)),
        "sortino": F.col("mean_return") / down * 252 ** 0.5,
        "profit_factor_price": F.try_divide("_won", "_lost"),
        "profit_factor_average": F.abs(F.try_divide(F.col("avg_gain") * F.col("winning_trades"),
                                                    F.col("avg_loss") * F.col("losing_trades")))
    }).drop("_sd", "_down", "_won", "_lost")


def drawdown(df: DataFrame, column: str, keys: Sequence[str] = KEYS, size: int = BLOCK_BARS) -> DataFrame:
    """Running maximum and relative drawdown of any positive column."""
    out = running(df, {"running_max": ("max", F.col(column))}, keys, size)
    return out.withColumn("drawdown", F.try_divide(F.col(column), F.col("running_max")) - 1)


def max_drawdown_period(curve: DataFrame, keys: Sequence[str] = KEYS, near_zero: float = -0.005,
                        size: int = BLOCK_BARS) -> DataFrame:
    """Time of the deepest drawdown and of the last earlier bar that was near its peak."""
    ok = F.when(F.col("drawdown") >= near_zero, F.col("ts"))
    df = running(curve, {"_start": ("last", ok)}, keys, size)
    return (df.groupBy(*keys)
            .agg(F.min_by(F.struct("ts", "drawdown", "_start"), F.struct("drawdown", "ts")).alias("_m"))
            .select(*keys, F.col("_m._start").alias("drawdown_start"), F.col("_m.ts").alias("drawdown_end"),
                    F.col("_m.drawdown").alias("max_drawdown")))


def drawdown_islands(curve: DataFrame, limit: float = -0.05, keys: Sequence[str] = KEYS,
                     size: int = BLOCK_BARS) -> DataFrame:
    """Runs of consecutive days whose worst drawdown is below ``limit``."""
    daily = (curve.groupBy(*keys, F.to_date("ts").alias("day"))
             .agg(F.min("drawdown").alias("drawdown")).filter(F.col("drawdown") < limit))
    numbered = running(daily.withColumn("ts", F.col("day").cast("timestamp_ntz")),
                       {"_rn": ("sum", F.lit(1))}, keys, size)
    island = F.date_sub(F.col("day"), F.col("_rn").cast("int"))
    return (numbered.groupBy(*keys, island.alias("_island"))
            .agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"),
                 F.count("*").alias("n_days"), F.min("drawdown").alias("worst")).drop("_island"))


def monthly_returns(curve: DataFrame, value: str = "equity", keys: Sequence[str] = KEYS) -> DataFrame:
    """Month-by-year table of percent changes of the last value of each month."""
    months = (curve.groupBy(*keys, F.date_trunc("month", "ts").alias("month_start"))
              .agg(F.max_by(value, "ts").alias("v")))
    prev = F.lag("v", 1).over(Window.partitionBy(*keys).orderBy("month_start"))
    rows = months.withColumns({"year": F.year("month_start"), "m": F.month("month_start"),
                               "r": (F.col("v") / prev - 1) * 100})
    return (rows.groupBy(*keys, "year").pivot("m", list(range(1, 13))).agg(F.first("r"))
            .withColumnsRenamed({str(i): f"m{i:02d}" for i in range(1, 13)}))


def equity_summary(curve: DataFrame, by: Sequence[str] = ("timeframe",)) -> DataFrame:
    """Per (timeframe, day): points, first and last value, best return, worst drawdown."""
    return (curve.groupBy(*by, F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n_points"), F.min_by("equity", "ts").alias("first_value"),
        F.max_by("equity", "ts").alias("last_value"), F.max("strategy_return").alias("max_return"),
        F.min("drawdown").alias("min_drawdown")))


def daily_portfolio(curve: DataFrame, by: Sequence[str] = ("timeframe",)) -> DataFrame:
    return (curve.groupBy(*by, F.to_date("ts").alias("day")).agg(
        F.min("equity").alias("min_value"), F.avg("equity").alias("avg_value"),
        F.max("equity").alias("max_value")))


def buy_side_summary(exc: DataFrame, by: Sequence[str] = ("timeframe",)) -> DataFrame:
    """Summary of the BUY side of the excursion table."""
    r = F.col("final_return_pct")
    return (exc.filter(F.col("signal_type") == "BUY").groupBy(*by).agg(
        F.count("*").alias("buy_signals"), (F.count_if(r > 0) * 100.0 / F.count("*")).alias("buy_win_rate"),
        F.avg(r).alias("avg_return"), F.avg("max_gain_pct").alias("avg_gain"),
        F.max("max_gain_pct").alias("best_gain"), F.avg("holding_period_duration").alias("avg_holding")))


def sell_side_summary(exc: DataFrame, by: Sequence[str] = ("timeframe",)) -> DataFrame:
    """Summary of the SELL side of the excursion table."""
    r = F.col("final_return_pct")
    return (exc.filter(F.col("signal_type") == "SELL").groupBy(*by).agg(
        F.count("*").alias("sell_signals"),
        (F.count_if(r > 0) * 100.0 / F.count("*")).alias("good_decision_rate"),
        F.avg(r).alias("avg_saved"), F.avg("max_drop_pct").alias("avg_drop"),
        F.max("max_drop_pct").alias("biggest_drop"), F.avg("waiting_period_duration").alias("avg_waiting")))


def signal_summary(exc: DataFrame, by: Sequence[str] = ("timeframe",)) -> DataFrame:
    """Both sides in one row with the accuracy over all signals (positives / all)."""
    good = F.count_if(F.col("final_return_pct") > 0)
    both = exc.groupBy(*by).agg(F.count("*").alias("all_signals"),
                                (good * 100.0 / F.count("*")).alias("combined_accuracy"))
    return (both.join(buy_side_summary(exc, by), list(by), "left")
            .join(sell_side_summary(exc, by), list(by), "left"))


def monthly_by_side(exc: DataFrame) -> DataFrame:
    return (exc.groupBy(F.date_trunc("month", "entry_time").alias("month"), "signal_type").agg(
        F.count("*").alias("n_signals"), F.avg("final_return_pct").alias("avg_return"),
        (F.count_if(F.col("final_return_pct") > 0) * 100.0 / F.count("*")).alias("win_rate")))


def trade_summary(tx: DataFrame, by: Sequence[str] = ("timeframe",)) -> DataFrame:
    """Counts by action, mean portfolio value and the time of the last trade."""
    return (tx.groupBy(*by).agg(
        F.count("*").alias("n_trades"), F.count_if(F.col("action") == "BUY").alias("n_buys"),
        F.count_if(F.col("action") == "SELL").alias("n_sells"),
        F.avg("portfolio_value").alias("avg_value"), F.max("ts").alias("last_trade")))


def best_by(results: DataFrame, metric: str, by: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """The row with the largest metric per group; ties take the smallest ``tie`` values."""
    rest = [c for c in results.columns if c not in by]
    rank = F.struct(F.col(metric), *[-F.col(t) for t in tie])
    return (results.groupBy(*by).agg(F.max_by(F.struct(*rest), rank).alias("_b"))
            .select(*by, *[F.col(f"_b.{c}").alias(c) for c in rest]))


def top_params(results: DataFrame, metric: str, n: int, by: Sequence[str] = (),
               tie: Sequence[str] = ()) -> DataFrame:
    """Top-n rows by metric, overall or per group (WindowGroupLimit prunes before the shuffle)."""
    order = [F.col(metric).desc_nulls_last(), *[F.col(t) for t in tie]]
    if not by:
        return results.orderBy(*order).limit(n)
    w = Window.partitionBy(*by).orderBy(*order)
    return (results.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n))


def best_per_metric(results: DataFrame, metrics: dict[str, str], label: str,
                    by: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """For each metric the label of its best row; ``metrics`` maps a name to 'max' or 'min'."""
    aggs = []
    for m, way in metrics.items():
        pick = F.max_by if way == "max" else F.min_by
        value = F.max if way == "max" else F.min
        t = F.col(tie or label)
        aggs += [pick(label, F.struct(F.col(m), -t if way == "max" else t)).alias(f"best_{m}_{label}"),
                 value(m).alias(f"best_{m}")]
    return (results.groupBy(*by) if by else results.groupBy()).agg(*aggs)


def default_vs_best(results: DataFrame, metric: str, is_default: Column, by: Sequence[str],
                    tie: Sequence[str] = ()) -> DataFrame:
    """Improvement of the best parameter set over the default one."""
    rank = F.struct(F.col(metric), *[-F.col(t) for t in tie])
    return (results.groupBy(*by).agg(
        F.max_by(metric, rank).alias("best_value"), F.max_by("param_id", rank).alias("best_param"),
        F.max(F.when(is_default, F.col(metric))).alias("default_value"))
        .withColumns({"improvement": F.col("best_value") - F.col("default_value"),
                      "factor": F.try_divide("best_value", "default_value")}))


def buy_hold(bars: DataFrame, capital: float = 10_000.0, keys: Sequence[str] = KEYS,
             size: int = BLOCK_BARS) -> DataFrame:
    """Final value, return and deepest drawdown of holding from the first bar on."""
    df = running(bars, {"_first": ("first", F.col("close")), "_peak": ("max", F.col("close"))}, keys, size)
    agg = df.groupBy(*keys).agg((F.max_by("close", "ts") / F.min_by("close", "ts") * capital).alias("final_value"),
                                F.min(F.col("close") / F.col("_peak") - 1).alias("max_drawdown"))
    return agg.withColumn("return_pct", (F.col("final_value") / capital - 1) * 100)
