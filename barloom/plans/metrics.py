"""Performance metrics, sweeps and strategy reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import performance as P
from ..operators import signals as S
from ..operators import sweep as G
from ..operators.series import KEYS
from ..session import cut_lineage
from .inputs import (SQL_1D, SQL_1H, SQL_4H, W, bars_1d, bars_1h, bars_4h, sql_curve, sql_macd, sql_sma_signal,
                     sql_trades)
from .market import EXC, SQL_EXC, _TX, excursion_frame
from .registry import query

N = 10
PPY = 365 * 24 / 8


def curve_frame(read):
    return S.equity_curve(S.sma_cross(bars_4h(read), N, keep_block=True))


SQL_CURVE = f"{SQL_4H}, {sql_sma_signal(N)}, {sql_curve()}"


def sql_metrics(by: str = "symbol, timeframe") -> str:
    """Statement: metrics per group of ``curve``."""
    r, m = "CASE WHEN bar_no > 0 THEN strategy_return END", "CASE WHEN bar_no > 0 THEN market_return END"
    return f"""SELECT *, total_return - benchmark_return AS outperformance,
  power(1 + total_return, {PPY}::DOUBLE / nullif(data_points - 1, 0)) - 1 AS annualized_periods, power(1 + total_return, 365.25::DOUBLE / data_points) - 1 AS annualized_rows,
  power(1 + total_return, 365.25::DOUBLE / nullif(floor((epoch(last_ts) - epoch(first_ts)) / 86400), 0)) - 1 AS annualized_days,
  coalesce((power(1 + total_return, {PPY}::DOUBLE / nullif(data_points - 1, 0)) - 1) / nullif(volatility, 0), 0.0) AS sharpe_annual,
  coalesce(mean_return * 252 / nullif(volatility_252, 0), 0.0) AS sharpe_252 FROM (
SELECT {by}, count(*) AS data_points, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(equity, ts) AS final_value, arg_max(benchmark, ts) AS benchmark_value,
  avg({r}) AS mean_return, min(drawdown) AS max_drawdown, min(benchmark_drawdown) AS benchmark_max_drawdown,
  count(*) FILTER (signal_type <> 0) AS n_signals, count(*) FILTER (event = 1) AS n_entries, count(*) FILTER (event = -1) AS n_exits,
  arg_max(equity, ts) / arg_min(equity, ts) - 1 AS total_return, arg_max(benchmark, ts) / arg_min(benchmark, ts) - 1 AS benchmark_return,
  stddev_samp({r}) * sqrt({PPY}) AS volatility, stddev_samp({m}) * sqrt({PPY}) AS benchmark_volatility, stddev_samp({r}) * sqrt(252) AS volatility_252,
  coalesce(count(*) FILTER (bar_no > 0 AND strategy_return > 0) / nullif(count(*) FILTER (bar_no > 0 AND strategy_return <> 0), 0), 0.0) AS bar_win_rate,
  sum(CASE WHEN bar_no > 0 AND strategy_return > 0 THEN strategy_return ELSE 0.0 END) / coalesce(nullif(sum(CASE WHEN bar_no > 0 AND strategy_return < 0 THEN -strategy_return ELSE 0.0 END), 0), 0.01) AS bar_profit_factor
  FROM curve GROUP BY {by})"""


# annualised figures of a month of 4-hour bars are powers of up to 12; six significant steps are kept below
METRICS_OUT = ("final_value", "benchmark_value", "mean_return", "max_drawdown", "benchmark_max_drawdown", "total_return",
               "benchmark_return", "volatility", "benchmark_volatility", "volatility_252", "bar_win_rate",
               "bar_profit_factor", "outperformance", "annualized_rows", "sharpe_252")
COUNTS_OUT = ("data_points", "first_ts", "last_ts", "n_signals", "n_entries", "n_exits")


@query("m_strategy_metrics", f"{SQL_CURVE} SELECT symbol, timeframe, {', '.join(COUNTS_OUT + METRICS_OUT)} FROM ({sql_metrics()})",
       r4=" ".join(METRICS_OUT))
def _(read):
    """M1, M3, M4, M6, M7, M8 over the mean-crossing strategy: the flagship query."""
    return P.curve_metrics(curve_frame(read)).select(*KEYS, *COUNTS_OUT, *METRICS_OUT)


@query("m2_annualised_returns", f"{SQL_CURVE} SELECT symbol, annualized_periods, annualized_rows, annualized_days, sharpe_annual FROM ({sql_metrics()})",
       r6="annualized_periods annualized_rows annualized_days sharpe_annual")
def _(read):
    return P.curve_metrics(curve_frame(read)).select("symbol", "annualized_periods", "annualized_rows", "annualized_days", "sharpe_annual")


SQL_TM = """SELECT symbol, timeframe, count(*) AS total_trades, count(*) FILTER (return_pct > 0) AS winning_trades, count(*) FILTER (return_pct < 0) AS losing_trades,
  coalesce(avg(return_pct) FILTER (return_pct > 0), 0.0) AS avg_gain, coalesce(avg(return_pct) FILTER (return_pct < 0), 0.0) AS avg_loss, max(return_pct) AS max_gain, min(return_pct) AS max_loss, avg(return_pct) AS mean_return,
  count(*) FILTER (return_pct > 0) / count(*) * 100 AS win_rate, coalesce(avg(return_pct) / nullif(stddev_pop(return_pct), 0), 0.0) AS sharpe_trades,
  avg(return_pct) / coalesce(nullif(stddev_pop(return_pct) FILTER (return_pct < 0), 0), 0.01) * sqrt(252) AS sortino,
  sum(greatest(exit_price - entry_price, 0)) / nullif(sum(greatest(entry_price - exit_price, 0)), 0) AS profit_factor_price,
  abs(coalesce(avg(return_pct) FILTER (return_pct > 0), 0.0) * count(*) FILTER (return_pct > 0) / nullif(coalesce(avg(return_pct) FILTER (return_pct < 0), 0.0) * count(*) FILTER (return_pct < 0), 0)) AS profit_factor_average
  FROM trades WHERE exit_ts IS NOT NULL GROUP BY 1, 2"""
TM = "avg_gain avg_loss max_gain max_loss mean_return win_rate sharpe_trades profit_factor_price profit_factor_average"


@query("a15_m5_trade_metrics", f"{SQL_CURVE}, {sql_trades()} {SQL_TM}", r6=TM, r4="sortino")
def _(read):
    return P.trade_metrics(S.pair_trades(curve_frame(read)))


@query("w15_drawdown", f"""{SQL_1H} SELECT symbol, ts, max(close) OVER w AS running_max, close / max(close) OVER w - 1 AS drawdown FROM b
WINDOW w AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", r6="running_max drawdown")
def _(read):
    return P.drawdown(bars_1h(read), "close").select("symbol", "ts", "running_max", "drawdown")


@query("w16_max_drawdown_period", f"""{SQL_CURVE}, p AS (SELECT *, last_value(CASE WHEN drawdown >= -0.005 THEN ts END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st FROM curve)
SELECT symbol, timeframe, arg_min(st, ROW(drawdown, ts)) AS drawdown_start, arg_min(ts, ROW(drawdown, ts)) AS drawdown_end, min(drawdown) AS max_drawdown FROM p GROUP BY 1, 2""", r6="max_drawdown")
def _(read):
    return P.max_drawdown_period(curve_frame(read))


@query("w17_drawdown_islands", f"""{SQL_1D}, c AS (SELECT *, close / max(close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM b),
d AS (SELECT symbol, timeframe, ts::DATE AS day, min(drawdown) AS drawdown FROM c GROUP BY ALL HAVING min(drawdown) < -0.5),
i AS (SELECT *, day - (row_number() OVER (PARTITION BY symbol ORDER BY day))::INT AS g FROM d)
SELECT symbol, timeframe, min(day)::TIMESTAMP AS first_day, max(day)::TIMESTAMP AS last_day, count(*) AS n_days, min(drawdown) AS worst FROM i GROUP BY symbol, timeframe, g""", r6="worst")
def _(read):
    return P.drawdown_islands(P.drawdown(bars_1d(read), "close"), -0.5)


@query("a26_monthly_returns_pivot", f"""{SQL_1D}, m AS (SELECT symbol, timeframe, date_trunc('month', ts) AS mo, arg_max(close, ts) AS v FROM b GROUP BY ALL),
r AS (SELECT *, (v / lag(v) OVER (PARTITION BY symbol ORDER BY mo) - 1) * 100 AS r FROM m)
SELECT symbol, timeframe, year(mo)::INT AS year, {', '.join(f"max(r) FILTER (month(mo) = {i}) AS m{i:02d}" for i in range(1, 13))} FROM r GROUP BY 1, 2, 3""",
       r6=" ".join(f"m{i:02d}" for i in range(1, 13)))
def _(read):
    return P.monthly_returns(bars_1d(read), "close")


@query("a36_equity_summary", f"""{SQL_CURVE} SELECT timeframe, date_trunc('day', ts)::TIMESTAMP AS day, symbol, count(*) AS n_points, arg_min(equity, ts) AS first_value, arg_max(equity, ts) AS last_value,
  max(strategy_return) AS max_return, min(drawdown) AS min_drawdown FROM curve GROUP BY ALL""", r4="first_value last_value", r6="max_return min_drawdown")
def _(read):
    return P.equity_summary(curve_frame(read), KEYS)


@query("a29_daily_portfolio", f"""{SQL_CURVE} SELECT timeframe, date_trunc('day', ts)::TIMESTAMP AS day, min(equity) AS min_value, avg(equity) AS avg_value, max(equity) AS max_value FROM curve GROUP BY ALL""",
       r4="min_value avg_value max_value")
def _(read):
    return P.daily_portfolio(curve_frame(read))


@query("a28_trade_summary", f"""{SQL_CURVE}, {sql_trades()}, {_TX} SELECT timeframe, count(*) AS n_trades, count(*) FILTER (action = 'BUY') AS n_buys, count(*) FILTER (action = 'SELL') AS n_sells,
  avg(portfolio_value) AS avg_value, max(ts) AS last_trade FROM tx GROUP BY 1""", r4="avg_value")
def _(read):
    return P.trade_summary(S.transactions(S.pair_trades(curve_frame(read))))


SQL_BUY = """buy AS (SELECT timeframe, count(*) AS buy_signals, count(*) FILTER (final_return_pct > 0) * 100.0 / count(*) AS buy_win_rate, avg(final_return_pct) AS avg_return,
  avg(max_gain_pct) AS avg_gain, max(max_gain_pct) AS best_gain, avg(holding_period_duration) AS avg_holding FROM exc WHERE signal_type = 'BUY' GROUP BY 1)"""
SQL_SELL = """sell AS (SELECT timeframe, count(*) AS sell_signals, count(*) FILTER (final_return_pct > 0) * 100.0 / count(*) AS good_decision_rate, avg(final_return_pct) AS avg_saved,
  avg(max_drop_pct) AS avg_drop, max(max_drop_pct) AS biggest_drop, avg(waiting_period_duration) AS avg_waiting FROM exc WHERE signal_type = 'SELL' GROUP BY 1)"""


@query("a23_buy_performance", f"{SQL_EXC}, {SQL_BUY} SELECT * FROM buy", r6="buy_win_rate avg_return avg_gain best_gain avg_holding")
def _(read):
    return P.buy_side_summary(excursion_frame(read))


@query("a23_sell_performance", f"{SQL_EXC}, {SQL_SELL} SELECT * FROM sell", r6="good_decision_rate avg_saved avg_drop biggest_drop avg_waiting")
def _(read):
    return P.sell_side_summary(excursion_frame(read))


@query("a24_signal_summary", f"""{SQL_EXC}, {SQL_BUY}, {SQL_SELL}, al AS (SELECT timeframe, count(*) AS all_signals, count(*) FILTER (final_return_pct > 0) * 100.0 / count(*) AS combined_accuracy FROM exc GROUP BY 1)
SELECT * FROM al LEFT JOIN buy USING (timeframe) LEFT JOIN sell USING (timeframe)""",
       r6="combined_accuracy buy_win_rate avg_return avg_gain best_gain avg_holding good_decision_rate avg_saved avg_drop biggest_drop avg_waiting")
def _(read):
    return P.signal_summary(cut_lineage(excursion_frame(read)))


@query("a24_best_timeframes", f"""{SQL_EXC} SELECT timeframe, symbol, count(*) FILTER (final_return_pct > 0) * 100.0 / count(*) AS combined_accuracy, count(*) AS all_signals FROM exc GROUP BY 1, 2
ORDER BY 3 DESC, 2""", r6="combined_accuracy")
def _(read):
    best = excursion_frame(read).groupBy("timeframe", "symbol").agg(
        (F.count_if(F.col("final_return_pct") > 0) * 100.0 / F.count("*")).alias("combined_accuracy"), F.count("*").alias("all_signals"))
    return best.orderBy(F.col("combined_accuracy").desc_nulls_last(), "symbol")


@query("a25_monthly_by_side", f"""{SQL_EXC} SELECT date_trunc('month', entry_time)::TIMESTAMP AS month, signal_type, count(*) AS n_signals, avg(final_return_pct) AS avg_return,
  count(*) FILTER (final_return_pct > 0) * 100.0 / count(*) AS win_rate FROM exc GROUP BY 1, 2""", r6="avg_return win_rate")
def _(read):
    return P.monthly_by_side(excursion_frame(read))


@query("m9_buy_sharpe", f"""{SQL_EXC} SELECT timeframe, avg(final_return_pct) / nullif(stddev_pop(final_return_pct), 0) AS buy_sharpe FROM exc WHERE signal_type = 'BUY' GROUP BY 1""", r6="buy_sharpe")
def _(read):
    r = F.col("final_return_pct")
    return (excursion_frame(read).filter(F.col("signal_type") == "BUY").groupBy("timeframe")
            .agg(F.try_divide(F.avg(r), F.stddev_pop(r)).alias("buy_sharpe")))


# ---------------------------------------------------------------- sweeps

PERIODS = tuple(range(100, 201))


def sma_sweep_frame(read):
    return G.sweep_sma(bars_1h(read), PERIODS, (0, 20))


SQL_SMA_SWEEP = f"""{SQL_1H}, ht AS (SELECT b.symbol, b.timeframe, b.ts, b.close, h.history, row_number() OVER (PARTITION BY b.symbol, h.history ORDER BY ts) - 1 AS bar_no
  FROM (SELECT *, max(ts) OVER (PARTITION BY symbol) AS e FROM b) b, (VALUES (0), (20)) h(history) WHERE history = 0 OR ts > e - history * INTERVAL '1 day'),
ln0 AS (SELECT *, sum(close) OVER (PARTITION BY symbol, history ORDER BY bar_no) AS cs, lag(close) OVER (PARTITION BY symbol, history ORDER BY bar_no) AS pc, count(*) OVER (PARTITION BY symbol, history) AS len FROM ht),
pr AS (SELECT a.*, p.n AS sma_period FROM ln0 a, range({PERIODS[0]}, {PERIODS[-1] + 1}) p(n) WHERE a.len >= p.n + 50),
sm AS (SELECT a.*, CASE WHEN a.bar_no >= sma_period - 1 THEN (a.cs - coalesce(z.cs, 0)) / sma_period END AS s FROM pr a
  LEFT JOIN ln0 z ON z.symbol = a.symbol AND z.history = a.history AND z.bar_no = a.bar_no - a.sma_period),
sg0 AS (SELECT *, lag(s) OVER (PARTITION BY symbol, history, sma_period ORDER BY bar_no) AS ps FROM sm),
sig AS (SELECT symbol || '|' || history || '|' || sma_period AS symbol, timeframe, ts, close, bar_no, CASE WHEN close > s AND pc <= ps THEN 1 WHEN close < s AND pc >= ps THEN -1 ELSE 0 END AS signal_type FROM sg0),
{sql_curve()}"""
SWEEP_OUT = ("total_return", "volatility", "max_drawdown", "bar_win_rate", "benchmark_return")


@query("g1_sweep_sma", f"""{SQL_SMA_SWEEP} SELECT split_part(symbol, '|', 1) AS symbol, split_part(symbol, '|', 2)::INT AS history, split_part(symbol, '|', 3)::INT AS sma_period, data_points, n_signals, {', '.join(SWEEP_OUT)}
FROM ({sql_metrics()})""", r6=" ".join(SWEEP_OUT))
def _(read):
    return sma_sweep_frame(read).select("symbol", "history", "sma_period", "data_points", "n_signals", *SWEEP_OUT)


FAST, SLOW, SIGNAL = range(5, 20), range(20, 35), range(5, 15)


def macd_sweep_frame(read, sets=None):
    return G.sweep_macd(bars_4h(read), FAST, SLOW, SIGNAL, sets=sets)


def sql_macd_sweep() -> str:
    """CTEs ending in ``res``: trades and return per parameter set, by recursion over bars."""
    spans = sorted(set(FAST) | set(SLOW))
    return f"""{SQL_4H}, sp AS (SELECT n AS span, 1 - 2.0::DOUBLE / (n + 1) AS q FROM range({spans[0]}, {spans[-1] + 1}) t(n)),
em AS (SELECT a.symbol, a.bar_no, sp.span, sum(power(q, a.bar_no - c.bar_no) * c.close) / sum(power(q, a.bar_no - c.bar_no)) AS e FROM b a JOIN b c ON c.symbol = a.symbol AND c.bar_no <= a.bar_no, sp GROUP BY ALL),
gs AS (SELECT n AS sg, 1 - 2.0::DOUBLE / (n + 1) AS q FROM range({SIGNAL[0]}, {SIGNAL[-1] + 1}) t(n)),
eg AS (SELECT a.symbol, a.bar_no, a.span, gs.sg, sum(power(q, a.bar_no - c.bar_no) * c.e) / sum(power(q, a.bar_no - c.bar_no)) AS g FROM em a JOIN em c ON c.symbol = a.symbol AND c.span = a.span AND c.bar_no <= a.bar_no, gs GROUP BY ALL),
gp AS (SELECT f.symbol, f.bar_no, f.span AS fast, s.span AS slow, fg.sg AS signal, (f.e - s.e) - (fg.g - sg2.g) AS gap FROM em f JOIN em s ON s.symbol = f.symbol AND s.bar_no = f.bar_no AND s.span BETWEEN {SLOW[0]} AND {SLOW[-1]}
  JOIN eg fg ON fg.symbol = f.symbol AND fg.bar_no = f.bar_no AND fg.span = f.span JOIN eg sg2 ON sg2.symbol = f.symbol AND sg2.bar_no = f.bar_no AND sg2.span = s.span AND sg2.sg = fg.sg WHERE f.span <= {FAST[-1]}),
cr AS (SELECT *, lag(gap) OVER (PARTITION BY symbol, fast, slow, signal ORDER BY bar_no) AS pg FROM gp),
ev AS (SELECT cr.symbol, fast, slow, signal, cr.bar_no, b.close, CASE WHEN gap > 0 THEN 1 ELSE -1 END AS side FROM cr JOIN b ON b.symbol = cr.symbol AND b.bar_no = cr.bar_no WHERE (gap > 0 AND pg <= 0) OR (gap < 0 AND pg >= 0)),
ef2 AS (SELECT *, coalesce(lag(side) OVER (PARTITION BY symbol, fast, slow, signal ORDER BY bar_no), -1) AS was FROM ev),
ee AS (SELECT *, lead(close) OVER (PARTITION BY symbol, fast, slow, signal ORDER BY bar_no) AS nx FROM ef2 WHERE side <> was),
en AS (SELECT symbol, arg_max(close, bar_no) AS endc FROM b GROUP BY 1),
res AS (SELECT symbol, '4h' AS timeframe, fast::INT AS fast, slow::INT AS slow, signal::INT AS signal, exp(sum(ln(coalesce(nx, endc) / close))) * 10000 AS final_capital, count(nx) AS total_trades,
  coalesce(count(*) FILTER (nx > close) / nullif(count(nx), 0) * 100, 0.0) AS win_rate, (exp(sum(ln(coalesce(nx, endc) / close))) - 1) * 100 AS total_return FROM ee JOIN en USING (symbol) WHERE side = 1 GROUP BY ALL)"""


@query("g2_sweep_macd", f"{sql_macd_sweep()} SELECT * FROM res", r4="final_capital win_rate total_return")
def _(read):
    """The whole grid of 2,250 parameter sets."""
    return macd_sweep_frame(read).drop("sharpe", "sortino", "profit_factor")


@query("t2_top_params", f"{sql_macd_sweep()} SELECT symbol, fast, slow, signal, total_return, place FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(total_return, 4) DESC, fast, slow, signal)::INT AS place FROM res) WHERE place <= 5",
       r4="total_return")
def _(read):
    res = macd_sweep_frame(read).withColumn("total_return", F.round("total_return", 4))
    return P.top_params(res, "total_return", 5, ("symbol",), ("fast", "slow", "signal")).select(
        "symbol", "fast", "slow", "signal", "total_return", "place")


@query("t3_best_by", f"""{sql_macd_sweep()} SELECT symbol, timeframe, arg_min(fast, k) AS fast, arg_min(slow, k) AS slow, arg_min(signal, k) AS signal, arg_min(rr, k) AS total_return, arg_min(total_trades, k) AS total_trades
FROM (SELECT *, round(total_return, 4) AS rr, ROW(-round(total_return, 4), fast, slow, signal) AS k FROM res) GROUP BY 1, 2""", r4="total_return")
def _(read):
    res = macd_sweep_frame(read).withColumn("total_return", F.round("total_return", 4))
    return P.best_by(res, "total_return", KEYS, ("fast", "slow", "signal")).select(
        *KEYS, "fast", "slow", "signal", "total_return", "total_trades")


@query("t4_best_per_metric", f"""{SQL_SMA_SWEEP}, ms AS (SELECT symbol, round(total_return, 6) AS total_return, round(volatility, 6) AS volatility, round(max_drawdown, 6) AS max_drawdown FROM ({sql_metrics()}) WHERE split_part(symbol, '|', 2) = '0'),
x AS (SELECT split_part(symbol, '|', 1) AS symbol, split_part(symbol, '|', 3)::INT AS sma_period, total_return, volatility, max_drawdown FROM ms)
SELECT symbol, arg_min(sma_period, ROW(-total_return, sma_period)) AS best_total_return_sma_period, max(total_return) AS best_total_return, arg_min(sma_period, ROW(volatility, sma_period)) AS best_volatility_sma_period, min(volatility) AS best_volatility,
  arg_min(sma_period, ROW(-max_drawdown, sma_period)) AS best_max_drawdown_sma_period, max(max_drawdown) AS best_max_drawdown FROM x GROUP BY 1""",
       r6="best_total_return best_volatility best_max_drawdown")
def _(read):
    m = sma_sweep_frame(read).filter(F.col("history") == 0)
    m = m.withColumns({c: F.round(c, 6) for c in ("total_return", "volatility", "max_drawdown")})
    return P.best_per_metric(m, {"total_return": "max", "volatility": "min", "max_drawdown": "max"}, "sma_period", ("symbol",))


@query("a27_best_pivot", f"""{SQL_SMA_SWEEP}, ms AS (SELECT split_part(symbol, '|', 1) AS s, split_part(symbol, '|', 2)::INT AS h, total_return FROM ({sql_metrics()}))
SELECT s AS symbol, coalesce(max(total_return) FILTER (h = 0), 0.0) AS all_days, coalesce(max(total_return) FILTER (h = 20), 0.0) AS last_20 FROM ms GROUP BY 1""", r6="all_days last_20")
def _(read):
    m = sma_sweep_frame(read)
    return (m.groupBy("symbol").pivot("history", [0, 20]).agg(F.max("total_return")).na.fill(0.0)
            .withColumnsRenamed({"0": "all_days", "20": "last_20"}))


@query("g3_sweep_knn")
def _(read):
    """625 sets, computed as 125 because the smoothing length does not touch the signals."""
    return G.sweep_knn(bars_4h(read), (3, 5, 8, 12, 20), (20, 30, 40, 50, 60), (2, 3, 5, 8, 10), (5, 10, 20, 50, 100))


@query("a35_default_vs_best", f"""{sql_macd_sweep()} SELECT symbol, max(rr) AS best_value, arg_min(fast * 10000 + slow * 100 + signal, ROW(-rr, fast * 10000 + slow * 100 + signal))::INT AS best_param,
  max(rr) FILTER (fast = 12 AND slow = 26 AND signal = 9) AS default_value, max(rr) - max(rr) FILTER (fast = 12 AND slow = 26 AND signal = 9) AS improvement,
  max(rr) / nullif(max(rr) FILTER (fast = 12 AND slow = 26 AND signal = 9), 0) AS factor FROM (SELECT *, round(total_return, 4) AS rr FROM res) GROUP BY 1""",
       r4="best_value default_value improvement factor")
def _(read):
    res = macd_sweep_frame(read).withColumns({
        "total_return": F.round("total_return", 4), "param_id": F.col("fast") * 10000 + F.col("slow") * 100 + F.col("signal")})
    default = (F.col("fast") == 12) & (F.col("slow") == 26) & (F.col("signal") == 9)
    return P.default_vs_best(res, "total_return", default, ("symbol",), ("param_id",))


@query("g5_timeframe_comparison", f"""{sql_macd_sweep()}, bp AS (SELECT symbol, timeframe, arg_min(fast, k) AS fast, arg_min(slow, k) AS slow, arg_min(signal, k) AS signal, arg_min(rr, k) AS total_return, arg_min(total_trades, k) AS total_trades, arg_min(win_rate, k) AS win_rate, arg_min(final_capital, k) AS final_capital
  FROM (SELECT *, round(total_return, 4) AS rr, ROW(-round(total_return, 4), fast, slow, signal) AS k FROM res) GROUP BY 1, 2),
pf AS (SELECT symbol, timeframe, count(*) AS data_points, floor((epoch(max(ts)) - epoch(min(ts))) / 86400)::BIGINT AS actual_days, (arg_max(close, ts) / arg_min(close, ts) - 1) * 100 AS buy_hold_return FROM b GROUP BY 1, 2)
SELECT * FROM bp JOIN pf USING (symbol, timeframe)""", r4="total_return win_rate final_capital buy_hold_return")
def _(read):
    return G.timeframe_comparison(bars_4h(read), FAST, SLOW, SIGNAL)


@query("j18_compare_benchmark", f"""{SQL_CURVE} SELECT symbol, timeframe, total_return, benchmark_return, total_return - benchmark_return AS difference, max_drawdown - benchmark_max_drawdown AS drawdown_difference FROM ({sql_metrics()})""",
       r6="total_return benchmark_return difference drawdown_difference")
def _(read):
    return G.compare_benchmark(P.curve_metrics(curve_frame(read)))


@query("w34_buy_hold", f"""{SQL_1D}, h AS (SELECT symbol, timeframe, bar_no, close / first_value(close) OVER ({W}) * 10000 AS value FROM b),
d AS (SELECT *, value / max(value) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM h)
SELECT symbol, timeframe, arg_max(value, bar_no) AS final_value, (arg_max(value, bar_no) / 10000 - 1) * 100 AS return_pct, min(dd) AS max_drawdown FROM d GROUP BY 1, 2""",
       r4="final_value return_pct", r6="max_drawdown")
def _(read):
    return P.buy_hold(bars_1d(read))


@query("g6_strategy_report", f"""{SQL_4H}, {sql_sma_signal(N)}, {sql_curve()}, st AS (SELECT 'strategy' AS series, symbol, total_return, max_drawdown FROM ({sql_metrics()})),
bh AS (SELECT 'benchmark' AS series, symbol, benchmark_return AS total_return, benchmark_max_drawdown AS max_drawdown FROM ({sql_metrics()})) SELECT * FROM st UNION ALL SELECT * FROM bh""",
       r6="total_return max_drawdown")
def _(read):
    return G.strategy_report({"strategy": P.curve_metrics(curve_frame(read))})


@query("t5_sample_params", f"""{sql_macd_sweep()}, p AS (SELECT fast, slow, signal FROM (SELECT DISTINCT fast, slow, signal FROM res) ORDER BY md5(concat_ws(',', fast, slow, signal, '42')) LIMIT 50)
SELECT symbol, fast, slow, signal, total_return FROM res JOIN p USING (fast, slow, signal)""", r4="total_return")
def _(read):
    """Fifty parameter sets of the grid, with their results; only those are swept."""
    grid = G.grid(read("events").sparkSession, fast=FAST, slow=SLOW, signal=SIGNAL).drop("param_id")
    sets = [tuple(r) for r in G.sample_params(grid.filter("fast < slow"), 50).collect()]
    return macd_sweep_frame(read, sets).select("symbol", "fast", "slow", "signal", "total_return")


@query("t7_order_results", f"{sql_macd_sweep()} SELECT symbol, fast, slow, signal, total_return FROM res WHERE total_trades > 0 ORDER BY total_return DESC", r4="total_return")
def _(read):
    res = macd_sweep_frame(read).filter(F.col("total_trades") > 0)
    return res.orderBy(F.col("total_return").desc(), "symbol", "fast", "slow", "signal").select(
        "symbol", "fast", "slow", "signal", "total_return")
