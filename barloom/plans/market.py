"""Bars, windows, indicators, signals and trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import indicators as I
from ..operators import levels as V
from ..operators import performance as P
from ..operators import signals as S
from ..operators import sweep as G
from ..operators.series import KEYS, running, windowed
from .inputs import (NUMBERED, SQL_1D, SQL_1H, SQL_4H, W, bars_1d, bars_1h, bars_4h, event_ticks, last_n,
                     sql_cross, sql_curve, sql_event_bars, sql_ewm, sql_excursions, sql_macd, sql_rma, sql_sma,
                     sql_sma_signal, sql_trades, sql_wma)
from .registry import query

UPTO = f"{W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
OHLC = "open high low close"

# ---------------------------------------------------------------- bars


@query("a5_resample_ticks_4h", f"WITH {sql_event_bars(4)} SELECT * FROM bars", r6=OHLC)
def _(read):
    return B.ticks_to_bars(event_ticks(read), "4 hours", "4h")


@query("a5_resample_bars_weekly", f"""{SQL_1D}
SELECT symbol, '1w' AS timeframe, date_trunc('week', ts)::TIMESTAMP AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, ts) AS close, sum(volume) AS volume FROM b GROUP BY 1, 2, 3""", r6=OHLC + " volume")
def _(read):
    return B.resample(bars_1d(read), "week", "1w")


@query("s9_dedupe_bars", """SELECT symbol, timeframe, ts, close, ingest_seq FROM (
  SELECT event_type AS symbol, '1h' AS timeframe, time_bucket(INTERVAL '1 hour', ts) AS ts, value AS close, event_id AS ingest_seq,
    row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL '1 hour', ts) ORDER BY event_id) AS rn FROM events) WHERE rn = 1""")
def _(read):
    chunks = event_ticks(read).select("symbol", F.lit("1h").alias("timeframe"), F.window("ts", "1 hour").start.alias("ts"),
                                      F.col("price").alias("close"), F.col("tick_id").alias("ingest_seq"))
    return B.dedupe_bars(chunks, "first")


@query("s9_dedupe_bars_last", """SELECT symbol, timeframe, ts, close, ingest_seq FROM (
  SELECT event_type AS symbol, '1h' AS timeframe, time_bucket(INTERVAL '1 hour', ts) AS ts, value AS close, event_id AS ingest_seq,
    row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL '1 hour', ts) ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(read):
    chunks = event_ticks(read).select("symbol", F.lit("1h").alias("timeframe"), F.window("ts", "1 hour").start.alias("ts"),
                                      F.col("price").alias("close"), F.col("tick_id").alias("ingest_seq"))
    return B.dedupe_bars(chunks, "last")


@query("s10_clip", f"{SQL_4H} SELECT symbol, timeframe, ts, close FROM bars WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'",
       r6="close")
def _(read):
    from datetime import datetime
    return B.clip(bars_4h(read), datetime(2024, 1, 5), datetime(2024, 1, 20)).select("symbol", "timeframe", "ts", "close")


@query("a6_last_per_day", f"{SQL_4H} SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS period, max(ts) AS ts, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2",
       r6="close")
def _(read):
    return B.last_per(bars_4h(read).select("symbol", "ts", "close"), "day")


@query("a7_expand_daily_4h", f"""{SQL_1D}, h AS (SELECT b.*, unnest([0, 4, 8, 12, 16, 20]) AS hour FROM b),
p AS (SELECT *, CASE hour WHEN 0 THEN open WHEN 20 THEN open + (close - open) * 0.833 ELSE open + (close - open) * (hour / 20.0::DOUBLE - 0.167) END AS o,
  CASE hour WHEN 0 THEN open + (close - open) * 0.167 WHEN 20 THEN close ELSE open + (close - open) * (hour / 20.0::DOUBLE + 0.167) END AS c FROM h)
SELECT symbol, '4h' AS timeframe, ts + hour * INTERVAL '1 hour' AS ts, o AS open, least(high, greatest(o, c) * 1.001) AS high,
  greatest(low, least(o, c) * 0.999) AS low, c AS close, volume / 6 AS volume FROM p""", r9=OHLC + " volume")
def _(read):
    return B.expand_daily_4h(bars_1d(read))


@query("a8_detect_frequency", f"""{SQL_1D}, w AS (SELECT * FROM b UNION ALL SELECT * REPLACE (symbol || '_week' AS symbol) FROM b WHERE dayofweek(ts) = 1),
g AS (SELECT symbol, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM w GROUP BY 1),
d AS (SELECT *, floor((epoch(last_ts) - epoch(first_ts)) / 86400) / nullif(n_rows - 1, 0) AS avg_days FROM g)
SELECT *, CASE WHEN n_rows < 2 THEN 'Unknown' WHEN avg_days <= 1.5 THEN 'Daily' WHEN avg_days <= 7.5 THEN 'Weekly' WHEN avg_days <= 35 THEN 'Monthly' ELSE 'Other' END AS frequency FROM d""",
       r6="avg_days")
def _(read):
    daily = bars_1d(read)
    weekly = daily.filter(F.dayofweek("ts") == 2).withColumn("symbol", F.concat("symbol", F.lit("_week")))
    return B.detect_frequency(daily.unionByName(weekly))


@query("a9_month_end", f"""{SQL_1D} SELECT symbol, last_day(date_trunc('month', ts))::TIMESTAMP AS month_end, max(ts) AS ts, arg_max(close, ts) AS close
FROM b GROUP BY 1, 2""", r6="close")
def _(read):
    return B.month_end(bars_1d(read).select("symbol", "ts", "close"))


@query("j20_higher_timeframe", f"""WITH {sql_event_bars(1)}, d AS (SELECT event_type AS symbol, time_bucket(INTERVAL '4 hours', ts) AS ts,
  last(value ORDER BY ts, event_id) AS close FROM events GROUP BY 1, 2)
SELECT l.symbol, l.ts, l.close, d.close AS htf_close FROM bars l LEFT JOIN d ON d.symbol = l.symbol AND d.ts + INTERVAL '4 hours' = time_bucket(INTERVAL '4 hours', l.ts)""",
       r6="close htf_close")
def _(read):
    return B.higher_timeframe(bars_1h(read), bars_4h(read), "4 hours").select("symbol", "ts", "close", "htf_close")


# ---------------------------------------------------------------- indicators

N = 10


@query("w1_w4_moving_averages", f"""{SQL_4H}, e AS ({sql_ewm('b', 'close', 2 / (N + 1), 'ema')}),
er AS ({sql_ewm('b', 'close', 2 / (N + 1), 'ema_recursive', False)}), rm AS ({sql_rma('b', 'close', N, 'rma')}),
h AS (SELECT *, 2 * ({sql_wma('close', N // 2)}) - ({sql_wma('close', N)}) AS raw FROM b)
SELECT h.symbol, h.ts, h.bar_no, {sql_sma('close', N)} AS sma, avg(close) OVER ({last_n(N)}) AS sma_partial,
  {sql_wma('close', N)} AS wma, {sql_wma('raw', 3)} AS hma, ema, ema_recursive, rma
FROM h JOIN e USING (symbol, bar_no) JOIN er USING (symbol, bar_no) LEFT JOIN rm USING (symbol, bar_no)""",
       r6="sma sma_partial wma hma ema ema_recursive rma")
def _(read):
    return I.moving_averages(bars_4h(read), N).select("symbol", "ts", "bar_no", "sma", "sma_partial", "wma", "hma", "ema",
                                                      "ema_recursive", "rma")


@query("w4_ema_daily_long", f"""{SQL_1D}, e AS ({sql_ewm('b', 'close', 2 / 27, 'ema')}) SELECT symbol, bar_no, ema FROM e""", r4="ema")
def _(read):
    def fn(df, o):
        return I.add_ema(df, o, F.col("close"), "ema", 26)
    return windowed(bars_1d(read), fn, I.ewm_lookback(I.span_alpha(26))).select("symbol", "bar_no", "ema")


@query("w5_macd", f"{SQL_4H}, {sql_macd()} SELECT symbol, ts, ema_fast, ema_slow, macd, macd_signal, histogram, signal_type FROM macd",
       r6="ema_fast ema_slow macd macd_signal histogram")
def _(read):
    return I.macd(bars_4h(read)).select("symbol", "ts", "ema_fast", "ema_slow", "macd", "macd_signal", "histogram", "signal_type")


def _sql_rsi(x: str, n: int = 14, src: str = "b") -> str:
    g = f"avg(greatest(coalesce(d, 0), 0)) OVER ({last_n(n)})"
    s = f"avg(greatest(-coalesce(d, 0), 0)) OVER ({last_n(n)})"
    return f"""r0 AS (SELECT *, {x} - lag({x}) OVER ({W}) AS d FROM {src}),
r1 AS (SELECT *, CASE WHEN count(*) OVER ({last_n(n)}) = {n} THEN {g} END AS g, CASE WHEN count(*) OVER ({last_n(n)}) = {n} THEN {s} END AS s FROM r0),
rsi AS (SELECT *, CASE WHEN g <= 0 AND s <= 0 THEN NULL WHEN s <= 0 THEN 100.0 ELSE 100 - 100.0 / (1 + g / s) END AS rsi FROM r1)"""


@query("w6_rsi", f"{SQL_4H}, {_sql_rsi('close')} SELECT symbol, ts, rsi FROM rsi", r6="rsi")
def _(read):
    return I.rsi(bars_4h(read)).select("symbol", "ts", "rsi")


@query("w6_rsi_volume", f"{SQL_4H}, {_sql_rsi('volume')} SELECT symbol, ts, rsi FROM rsi", r6="rsi")
def _(read):
    return I.rsi(bars_4h(read), column="volume").select("symbol", "ts", "rsi")


@query("w6_rsi_wilder", f"""{SQL_4H}, d0 AS (SELECT *, greatest(close - lag(close) OVER ({W}), 0.0) AS up, greatest(lag(close) OVER ({W}) - close, 0.0) AS dn FROM b),
g AS ({sql_rma('d0', 'up', 14, 'g', 1)}), s AS ({sql_rma('d0', 'dn', 14, 's', 1)})
SELECT b.symbol, b.ts, CASE WHEN g <= 0 AND s <= 0 THEN NULL WHEN s <= 0 THEN 100.0 ELSE 100 - 100.0 / (1 + g / s) END AS rsi
FROM b LEFT JOIN g USING (symbol, bar_no) LEFT JOIN s USING (symbol, bar_no)""", r6="rsi")
def _(read):
    return I.rsi(bars_4h(read), wilder=True).select("symbol", "ts", "rsi")


@query("w7_returns", f"""{SQL_4H}, r AS (SELECT *, close - lag(close) OVER ({W}) AS diff, close / lag(close) OVER ({W}) - 1 AS pct_1, close / lag(close, 5) OVER ({W}) - 1 AS pct_k FROM b)
SELECT symbol, ts, diff, pct_1, pct_k, sum(diff) OVER ({UPTO}) AS cum_diff, CASE WHEN bar_no > 0 THEN exp(sum(ln(1 + pct_1)) OVER ({UPTO})) END AS cum_growth FROM r""",
       r6="diff pct_1 cum_diff", r4="pct_k cum_growth")
def _(read):
    return I.returns(bars_4h(read)).select("symbol", "ts", "diff", "pct_1", "pct_k", "cum_diff", "cum_growth")


@query("w8_cross", f"{SQL_4H}, {sql_sma_signal(N)} SELECT symbol, ts, close, sma, signal_type FROM sig", r6="close sma")
def _(read):
    return S.sma_cross(bars_4h(read), N).select("symbol", "ts", "close", "sma", "signal_type")


@query("w9_position", f"""{SQL_4H}, {sql_sma_signal(N)} SELECT symbol, ts, signal_type,
  (coalesce(last_value(CASE WHEN signal_type <> 0 THEN signal_type END IGNORE NULLS) OVER ({UPTO}), 0) > 0)::INT AS position FROM sig""")
def _(read):
    return S.position(S.sma_cross(bars_4h(read), N, keep_block=True)).select("symbol", "ts", "signal_type", "position")


@query("w10_w42_effective_events", f"""{SQL_1H}, {sql_sma_signal(20)}, {sql_curve()} SELECT symbol, ts, event,
  CASE event WHEN 1 THEN 'BUY' WHEN -1 THEN 'SELL' ELSE 'HOLD' END AS position_status FROM curve""")
def _(read):
    ev = S.effective_events(S.sma_cross(bars_1h(read), 20, keep_block=True))
    return S.position_status(ev).select("symbol", "ts", "event", "position_status")


@query("w11_w12_w15_equity_curve", f"""{SQL_4H}, {sql_sma_signal(N)}, {sql_curve()}
SELECT symbol, ts, position, event, strategy_return, equity, drawdown, benchmark, benchmark_drawdown, trade_no FROM curve""",
       r6="strategy_return drawdown benchmark_drawdown", r4="equity benchmark")
def _(read):
    return S.equity_curve(S.sma_cross(bars_4h(read), N, keep_block=True)).select(
        "symbol", "ts", "position", "event", "strategy_return", "equity", "drawdown", "benchmark",
        "benchmark_drawdown", "trade_no")


@query("w12_equity_with_fee", f"""{SQL_1H}, {sql_macd()}, {sql_curve('macd', 10000.0, 0.001)}
SELECT symbol, ts, position, event, equity, drawdown FROM curve""", r6="drawdown", r4="equity")
def _(read):
    return S.equity_curve(I.macd(bars_1h(read), keep_block=True), fee=0.001).select(
        "symbol", "ts", "position", "event", "equity", "drawdown")


@query("w13_atr", f"""{SQL_4H}, t AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER ({W})), 0), coalesce(abs(low - lag(close) OVER ({W})), 0)) AS true_range FROM b),
a AS ({sql_rma('t', 'true_range', 14, 'atr')}) SELECT t.symbol, t.ts, true_range, atr FROM t LEFT JOIN a USING (symbol, bar_no)""",
       r6="true_range atr")
def _(read):
    return I.atr(bars_4h(read)).select("symbol", "ts", "true_range", "atr")


@query("w14_vwap", f"""{SQL_4H}, s AS (SELECT *, date_trunc('day', ts)::TIMESTAMP AS session FROM b)
SELECT symbol, ts, session, sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w AS vwap FROM s
WINDOW w AS (PARTITION BY symbol, session ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", r6="vwap")
def _(read):
    return I.session_vwap(bars_4h(read)).select("symbol", "ts", "session", "vwap")


def _sql_vwma(x, n):
    return f"CASE WHEN count(*) OVER ({last_n(n)}) = {n} THEN sum({x} * volume) OVER ({last_n(n)}) / sum(volume) OVER ({last_n(n)}) END"


@query("w14_vwma", f"{SQL_4H} SELECT symbol, ts, {_sql_vwma('(high + low) / 2', 20)} AS vwma_hl2, {_sql_vwma('close', 20)} AS vwma_close FROM b",
       r8="vwma_hl2 vwma_close")
def _(read):
    return I.rolling_volume_mean(bars_4h(read), 20).select("symbol", "ts", "vwma_hl2", "vwma_close")


@query("w26_price_channel", f"""{SQL_4H}, c AS (SELECT *, max(high) OVER ({last_n(20)}) AS highest, min(low) OVER ({last_n(20)}) AS lowest FROM b)
SELECT symbol, ts, highest, lowest, (highest + lowest) / 2 AS mid FROM c""", r6="highest lowest mid")
def _(read):
    return I.price_channel(bars_4h(read), 20).select("symbol", "ts", "highest", "lowest", "mid")


@query("w33_rolling_cv", f"""{SQL_4H} SELECT symbol, ts, CASE WHEN count(*) OVER ({last_n(30)}) = 30 THEN stddev_samp(close) OVER ({last_n(30)}) / avg(close) OVER ({last_n(30)}) END AS rolling_cv FROM b""",
       r6="rolling_cv")
def _(read):
    return I.coefficient_of_variation(bars_4h(read)).select("symbol", "ts", "rolling_cv")


@query("w28_regime", f"""{SQL_4H}, s AS (SELECT *, {sql_sma('close', 20)} AS s20, {sql_sma('close', 50)} AS s50 FROM b)
SELECT symbol, ts, (close - s50) / s50 AS trend_strength, CASE WHEN s20 > s50 AND close > s20 THEN 'up' WHEN s20 < s50 AND close < s20 THEN 'down' ELSE 'ranging' END AS regime FROM s""",
       r6="trend_strength")
def _(read):
    return I.regime(bars_4h(read)).select("symbol", "ts", "trend_strength", "regime")


def sql_features(src: str = "b") -> str:
    """CTEs ending in ``feat``: the volume feature columns."""
    return f"""f0 AS (SELECT *, {sql_sma('volume', 20)} AS volume_sma_20, close / lag(close) OVER ({W}) - 1 AS chg, volume * (high + low + close) / 3 AS money_flow,
  CASE WHEN close > open THEN volume ELSE 0.0 END AS buying_pressure, CASE WHEN close < open THEN volume ELSE 0.0 END AS selling_pressure,
  close / lag(close, 5) OVER ({W}) - 1 AS p5, volume / nullif(lag(volume, 5) OVER ({W}), 0) - 1 AS v5, volume - lag(volume) OVER ({W}) AS vd FROM {src}),
f1 AS (SELECT *, volume / volume_sma_20 AS volume_ratio, money_flow * (1 + abs(chg)) AS enhanced_money_flow, buying_pressure - selling_pressure AS volume_delta,
  volume_sma_20 * 3 AS institutional_threshold, CASE WHEN volume > volume_sma_20 * 3 THEN volume ELSE 0.0 END AS institutional_flow,
  (volume > coalesce(volume_sma_20 * 1.5, 1e300))::INT AS volume_wave, (volume > coalesce(volume_sma_20 * 4, 1e300))::INT AS volume_anomaly,
  {sql_sma('p5', 5)} AS price_momentum, {sql_sma('v5', 5)} AS volume_momentum,
  CASE WHEN count(*) OVER ({last_n(14)}) = 14 THEN avg(greatest(coalesce(vd, 0), 0)) OVER ({last_n(14)}) END AS vg,
  CASE WHEN count(*) OVER ({last_n(14)}) = 14 THEN avg(greatest(-coalesce(vd, 0), 0)) OVER ({last_n(14)}) END AS vs FROM f0),
feat AS (SELECT *, price_momentum - volume_momentum AS pv_divergence, sum(volume_delta) OVER ({UPTO}) AS cumulative_delta,
  CASE WHEN vg <= 0 AND vs <= 0 THEN NULL WHEN vs <= 0 THEN 100.0 ELSE 100 - 100.0 / (1 + vg / vs) END AS volume_rsi FROM f1)"""


FEATURES = ("volume_ratio", "money_flow", "enhanced_money_flow", "buying_pressure", "selling_pressure", "volume_delta",
            "cumulative_delta", "institutional_flow", "volume_wave", "volume_anomaly", "price_momentum",
            "volume_momentum", "pv_divergence", "volume_rsi")


@query("w27_volume_features", f"{SQL_4H}, {sql_features()} SELECT symbol, ts, {', '.join(FEATURES)} FROM feat",
       r6="volume_ratio money_flow price_momentum pv_divergence volume_rsi volume_momentum", r4="enhanced_money_flow")
def _(read):
    return I.volume_features(bars_4h(read)).select("symbol", "ts", *FEATURES)


@query("w27_volume_features_daily", f"{SQL_1D}, {sql_features()} SELECT symbol, ts, {', '.join(FEATURES)} FROM feat",
       r6="volume_ratio price_momentum pv_divergence volume_rsi volume_momentum", r4="money_flow enhanced_money_flow")
def _(read):
    return I.volume_features(bars_1d(read)).select("symbol", "ts", *FEATURES)


@query("w40_volume_oscillator", f"""{SQL_4H}, d0 AS (SELECT *, greatest(volume - lag(volume) OVER ({W}), 0.0) AS up, greatest(lag(volume) OVER ({W}) - volume, 0.0) AS dn FROM b),
g AS ({sql_rma('d0', 'up', 14, 'g', 1)}), s AS ({sql_rma('d0', 'dn', 14, 's', 1)}),
o AS (SELECT b.*, CASE WHEN g <= 0 AND s <= 0 THEN NULL WHEN s <= 0 THEN 100.0 ELSE 100 - 100.0 / (1 + g / s) END AS volume_rsi,
  {sql_sma('volume', 5)} AS s5, {sql_sma('volume', 20)} AS s20, {sql_sma('volume', 50)} AS s50
  FROM b LEFT JOIN g USING (symbol, bar_no) LEFT JOIN s USING (symbol, bar_no))
SELECT symbol, ts, volume_rsi, volume / s20 AS volume_to_mean, coalesce(s5 > s20, false) AS fast_above_slow, coalesce(volume > 4 * s50, false) AS anomaly,
  coalesce(volume > 3 * s20, false) AS high_volume_alert, {sql_cross('volume_rsi', '80.0::DOUBLE')} AS rsi_cross_80 FROM o""",
       r6="volume_rsi volume_to_mean")
def _(read):
    return I.volume_oscillator(bars_4h(read)).select("symbol", "ts", "volume_rsi", "volume_to_mean", "fast_above_slow",
                                                     "anomaly", "high_volume_alert", "rsi_cross_80")


# ---------------------------------------------------------------- nearest-value trend

K_, WIN, MA = 3, 30, 5


def sql_knn(src: str, value: str, target: str, k: int, window: int, divide: str = "count(*)", start: int = 0) -> str:
    """CTE body: mean of the k nearest previous values, recent first on ties."""
    return f"""SELECT symbol, bar_no, sum(v ORDER BY d, age) / {divide} AS knn_ma FROM (
  SELECT a.symbol, a.bar_no, p.{value} AS v, abs(a.{target} - p.{value}) AS d, a.bar_no - p.bar_no AS age,
    row_number() OVER (PARTITION BY a.symbol, a.bar_no ORDER BY abs(a.{target} - p.{value}), a.bar_no - p.bar_no) AS rn
  FROM {src} a JOIN {src} p ON p.symbol = a.symbol AND p.bar_no BETWEEN a.bar_no - {window} AND a.bar_no - 1
  WHERE a.bar_no >= {window + start} AND p.{value} IS NOT NULL AND a.{target} IS NOT NULL) WHERE rn <= {k} GROUP BY symbol, bar_no"""


def sql_knn_trend() -> str:
    """CTEs ending in ``kt``: strict nearest-value trend and its signals."""
    return f"""e AS ({sql_ewm('b', 'close', 2 / (MA + 1), 'target_in')}),
v0 AS (SELECT b.*, target_in, {sql_sma('(high + low) / 2', MA)} AS value_in FROM b JOIN e USING (symbol, bar_no)),
k0 AS ({sql_knn('v0', 'value_in', 'target_in', K_, WIN)}),
k1 AS (SELECT v0.*, knn_ma FROM v0 LEFT JOIN k0 USING (symbol, bar_no)),
k2 AS (SELECT *, {sql_wma('knn_ma', 5)} AS knn_smooth, {sql_sma('knn_ma', 50)} AS knn_average FROM k1),
k3 AS (SELECT *, CASE WHEN knn_smooth > lag(knn_smooth) OVER ({W}) THEN 'up' WHEN knn_smooth < lag(knn_smooth) OVER ({W}) THEN 'down' ELSE 'neutral' END AS trend FROM k2),
kt AS (SELECT *, CASE WHEN lag(trend) OVER ({W}) = 'down' AND trend = 'up' THEN 1 WHEN lag(trend) OVER ({W}) = 'up' AND trend = 'down' THEN -1 ELSE 0 END AS signal_type FROM k3)"""


@query("w18_w20_knn_trend", f"{SQL_4H}, {sql_knn_trend()} SELECT symbol, ts, knn_ma, knn_smooth, knn_average, trend, signal_type FROM kt",
       r8="knn_ma knn_smooth knn_average")
def _(read):
    return I.knn_trend(bars_4h(read), K_, WIN, MA).select("symbol", "ts", "knn_ma", "knn_smooth", "knn_average", "trend", "signal_type")


@query("w20_knn_trend_zero_filled", f"""{SQL_4H}, e AS ({sql_ewm('b', 'close', 2 / (MA + 1), 'target_in', False)}),
v0 AS (SELECT b.*, target_in, avg((high + low) / 2) OVER ({last_n(MA)}) AS value_in FROM b JOIN e USING (symbol, bar_no)),
k0 AS ({sql_knn('v0', 'value_in', 'target_in', K_, WIN)}),
k1 AS (SELECT v0.*, coalesce(knn_ma, 0.0) AS knn_ma FROM v0 LEFT JOIN k0 USING (symbol, bar_no)),
k2 AS (SELECT *, coalesce({sql_wma('knn_ma', 5)}, 0.0) AS knn_smooth, avg(knn_ma) OVER ({last_n(50)}) AS knn_average FROM k1),
k3 AS (SELECT *, CASE WHEN knn_smooth > lag(knn_smooth) OVER ({W}) AND knn_smooth > 0 THEN 'up' WHEN knn_smooth < lag(knn_smooth) OVER ({W}) AND knn_smooth > 0 THEN 'down' ELSE 'neutral' END AS trend FROM k2)
SELECT symbol, ts, knn_ma, knn_smooth, knn_average, trend, CASE WHEN lag(trend) OVER ({W}) = 'down' AND trend = 'up' THEN 1 WHEN lag(trend) OVER ({W}) = 'up' AND trend = 'down' THEN -1 ELSE 0 END AS signal_type FROM k3""",
       r8="knn_ma knn_smooth knn_average")
def _(read):
    return I.knn_trend(bars_4h(read), K_, WIN, MA, zero_fill=True).select(
        "symbol", "ts", "knn_ma", "knn_smooth", "knn_average", "trend", "signal_type")


@query("w19_knn_inputs", f"""{SQL_4H}, e AS ({sql_ewm('b', 'close', 2 / (MA + 1), 'value_ema')}),
t AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER ({W})), 0), coalesce(abs(low - lag(close) OVER ({W})), 0)) AS tr FROM b),
a AS ({sql_rma('t', 'tr', 14, 'target_volatility')})
SELECT b.symbol, b.ts, value_ema, {sql_wma('close', MA)} AS value_wma, {sql_sma('(high + low) / 2', MA)} AS value_hl2, target_volatility
FROM b JOIN e USING (symbol, bar_no) LEFT JOIN a USING (symbol, bar_no)""", r6="value_ema value_wma value_hl2 target_volatility")
def _(read):
    def fn(df, o):
        for v in ("ema", "wma", "hl2"):
            df = I.add_knn_inputs(df, o, v, "volatility", MA).withColumnRenamed("value_in", f"value_{v}")
        return df.withColumnRenamed("target_in", "target_volatility")
    back = I.ewm_lookback(1 / 14) + 20
    return windowed(bars_4h(read), fn, back).select("symbol", "ts", "value_ema", "value_wma", "value_hl2", "target_volatility")


@query("w21_w22_knn_vote")
def _(read):
    return I.knn_vote(bars_1h(read)).drop("open", "high", "low", "volume")


@query("j21_best_params", f"""{SQL_4H}, p AS (SELECT * FROM (VALUES ('4h', 23, 50, 30, 5), ('8h', 31, 50, 70, 10)) t(timeframe, k, smoothing, "window", ma_len)),
u AS (SELECT symbol, timeframe FROM b UNION ALL SELECT DISTINCT symbol, '1M' FROM b)
SELECT u.symbol, u.timeframe, coalesce(p.k, 25) AS k, coalesce(p.smoothing, 50) AS smoothing, coalesce(p."window", 50) AS "window", coalesce(p.ma_len, 5) AS ma_len, count(*) AS n_bars
FROM u LEFT JOIN p USING (timeframe) GROUP BY ALL""")
def _(read):
    bars = bars_4h(read).select("symbol", "timeframe")
    more = bars.select("symbol").distinct().withColumn("timeframe", F.lit("1M"))
    best = bars.sparkSession.createDataFrame([("4h", 23, 50, 30, 5), ("8h", 31, 50, 70, 10)],
                                             "timeframe string, k int, smoothing int, window int, ma_len int")
    return (G.with_best_params(bars.unionByName(more), best, {"k": 25, "smoothing": 50, "window": 50, "ma_len": 5})
            .groupBy("symbol", "timeframe", "k", "smoothing", "window", "ma_len").agg(F.count("*").alias("n_bars")))


# ---------------------------------------------------------------- pivots and channels


@query("w23_pivots", f"""{SQL_4H}, w AS (SELECT *, max(high) OVER l AS hl, max(high) OVER r AS hr, min(low) OVER l AS ll, min(low) OVER r AS lr, count(*) OVER l AS nl, count(*) OVER r AS nr FROM b
WINDOW l AS ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), r AS ({W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
SELECT symbol, ts, CASE WHEN nl = 5 AND nr = 5 AND high > hl AND high > hr THEN high END AS pivot_high,
  CASE WHEN nl = 5 AND nr = 5 AND low < ll AND low < lr THEN low END AS pivot_low, bar_no + 5 AS known_at FROM w""", r6="pivot_high pivot_low")
def _(read):
    return V.pivots(bars_4h(read), 5).select("symbol", "ts", "pivot_high", "pivot_low", "known_at")


@query("w24_channels")
def _(read):
    return V.channels(bars_1d(read), p=10)


@query("w25_channel_breaks")
def _(read):
    bars = bars_1d(read)
    return V.channel_breaks(bars, V.channel_sets(bars, p=10)).filter("resistance_broken or support_broken").select(
        "symbol", "ts", "close", "resistance_broken", "support_broken")


# ---------------------------------------------------------------- trades and excursions


@query("j16_pair_trades", f"{SQL_4H}, {sql_sma_signal(N)}, {sql_curve()}, {sql_trades()} SELECT * REPLACE (coalesce(bars_held, -1) AS bars_held) FROM trades",
       r6="entry_price exit_price return_pct", r4="entry_equity exit_equity")
def _(read):
    return S.pair_trades(S.equity_curve(S.sma_cross(bars_4h(read), N, keep_block=True))).na.fill(-1, ["bars_held"])


_TX = """tx AS (SELECT symbol, timeframe, trade_no, 'BUY' AS action, entry_ts AS ts, entry_price AS price, entry_equity / entry_price AS quantity, NULL::DOUBLE AS profit, NULL::DOUBLE AS return_pct, entry_equity AS portfolio_value FROM trades
UNION ALL SELECT symbol, timeframe, trade_no, 'SELL', exit_ts, exit_price, entry_equity / entry_price, (exit_price - entry_price) * entry_equity / entry_price, return_pct, entry_equity / entry_price * exit_price FROM trades WHERE exit_ts IS NOT NULL)"""


@query("w41_transactions", f"{SQL_4H}, {sql_sma_signal(N)}, {sql_curve()}, {sql_trades()}, {_TX} SELECT * FROM tx",
       r6="price return_pct", r4="quantity profit portfolio_value")
def _(read):
    return S.transactions(S.pair_trades(S.equity_curve(S.sma_cross(bars_4h(read), N, keep_block=True))))


@query("w41_transactions_fixed_stake", f"""{SQL_4H}, {sql_sma_signal(N)}, {sql_curve()}, {sql_trades()},
c AS (SELECT *, 10000.0 / entry_price AS q FROM trades WHERE exit_ts IS NOT NULL)
SELECT symbol, timeframe, trade_no, 'BUY' AS action, entry_ts AS ts, entry_price AS price, q AS quantity, NULL::DOUBLE AS profit, NULL::DOUBLE AS return_pct, 10000.0::DOUBLE AS portfolio_value FROM c
UNION ALL SELECT symbol, timeframe, trade_no, 'SELL', exit_ts, exit_price, q, (exit_price - entry_price) * q, return_pct, q * exit_price FROM c""",
       r6="price return_pct", r4="quantity profit portfolio_value")
def _(read):
    return S.transactions(S.pair_trades(S.equity_curve(S.sma_cross(bars_4h(read), N, keep_block=True))), stake=10_000.0)


@query("j12_next_opposite", f"""{SQL_1H}, {sql_sma_signal(N)}, s AS (SELECT * FROM sig WHERE signal_type <> 0)
SELECT s.symbol, s.ts, s.signal_type, coalesce(min(o.bar_no), -1) AS next_bar_no, arg_min(o.ts, o.bar_no) AS next_ts, arg_min(o.close, o.bar_no) AS next_close
FROM s LEFT JOIN s o ON o.symbol = s.symbol AND o.bar_no > s.bar_no AND o.signal_type = -s.signal_type GROUP BY 1, 2, 3""", r6="next_close")
def _(read):
    return S.next_opposite(S.sma_cross(bars_1h(read), N)).select("symbol", "ts", "signal_type", "next_bar_no", "next_ts", "next_close").na.fill(
        -1, ["next_bar_no"])


EXC = "entry_price exit_price extreme_price max_gain_pct max_drop_pct final_return_pct macd macd_signal histogram"


def excursion_frame(read):
    return S.excursions(I.macd(bars_1h(read), keep_block=True))


SQL_EXC = f"{SQL_1H}, {sql_macd()}, {sql_excursions()}"


@query("a14_j13_excursions", f"""{SQL_EXC} SELECT * REPLACE (coalesce(holding_period_duration, -1) AS holding_period_duration,
  coalesce(waiting_period_duration, -1) AS waiting_period_duration) FROM exc""", r6=EXC)
def _(read):
    return excursion_frame(read).na.fill(-1, ["holding_period_duration", "waiting_period_duration"])


@query("a13_signal_stats", f"""{SQL_EXC} SELECT timeframe, signal_type, count(*) AS n_signals, avg(coalesce(max_gain_pct, max_drop_pct)) AS avg_excursion,
  median(coalesce(max_gain_pct, max_drop_pct)) AS median_excursion, max(coalesce(max_gain_pct, max_drop_pct)) AS best_excursion, min(coalesce(max_gain_pct, max_drop_pct)) AS worst_excursion,
  avg(final_return_pct) AS avg_result, max(final_return_pct) AS best_result, min(final_return_pct) AS worst_result, count(*) FILTER (final_return_pct > 0) AS positive_signals,
  avg(coalesce(holding_period_duration, waiting_period_duration)) AS avg_duration, median(coalesce(holding_period_duration, waiting_period_duration)) AS median_duration,
  count(*) FILTER (final_return_pct > 0) / count(*) * 100 AS positive_rate FROM exc GROUP BY 1, 2""",
       r6="avg_excursion median_excursion best_excursion worst_excursion avg_result best_result worst_result avg_duration median_duration positive_rate")
def _(read):
    return S.signal_stats(excursion_frame(read))
