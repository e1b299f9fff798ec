"""Volume profiles, price levels and the signals built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import brackets as K
from ..operators import indicators as I
from ..operators import profile as R
from ..operators import signals as S
from ..session import cut_lineage
from .inputs import SQL_1D, SQL_4H, W, bars_1d, bars_4h, last_n, sql_ewm, sql_rma, sql_sma
from .market import _sql_vwma, sql_features
from .registry import query

LOOK, ROWS = 300, 30


def sql_profile(look: int = LOOK, rows: int = ROWS) -> str:
    """CTEs ending in ``prof``, by the plain overlap condition."""
    return f"""lst AS (SELECT f.*, max(bar_no) OVER (PARTITION BY symbol) AS e FROM feat f), l AS (SELECT * FROM lst WHERE bar_no > e - {look}),
bd AS (SELECT symbol, timeframe, min(low) AS lo, max(high) AS hi, (max(high) - min(low)) / {rows} AS h FROM l GROUP BY 1, 2),
gr AS (SELECT bd.*, r AS row_no, lo + (r + 0.5::DOUBLE) * h AS price_level, lo + r * h AS rb FROM bd, range({rows}) t(r)),
pt AS (SELECT g.symbol, g.row_no, l.close, l.open, l.volume, l.institutional_threshold AS th,
  greatest(least(l.high, rb + h) - greatest(l.low, rb), 0.0) / (l.high - l.low) * l.enhanced_money_flow AS part
  FROM gr g JOIN l ON l.symbol = g.symbol AND l.high > l.low AND l.low <= rb + h AND l.high >= rb),
ps AS (SELECT symbol, row_no, sum(part) AS total_volume, sum(CASE WHEN close > open THEN part ELSE 0.0 END) AS buy_volume,
  sum(CASE WHEN close > open THEN 0.0 ELSE part END) AS sell_volume, sum(CASE WHEN volume > th THEN part ELSE 0.0 END) AS institutional_volume, count(*) AS n_bars FROM pt GROUP BY 1, 2),
prof AS (SELECT g.symbol, g.timeframe, g.row_no, g.price_level, coalesce(total_volume, 0.0) AS total_volume, coalesce(buy_volume, 0.0) AS buy_volume,
  coalesce(sell_volume, 0.0) AS sell_volume, coalesce(institutional_volume, 0.0) AS institutional_volume, coalesce(n_bars, 0) AS n_bars,
  coalesce(total_volume / n_bars, 0.0) AS avg_size FROM gr g LEFT JOIN ps USING (symbol, row_no))"""


SQL_PROF = f"{SQL_4H}, {sql_features()}, {sql_profile()}"
SQL_PROF_D = f"{SQL_1D}, {sql_features()}, {sql_profile()}"


@query("a16_j11_volume_profile", f"{SQL_PROF} SELECT * EXCLUDE (n_bars, avg_size) FROM prof",
       r4="price_level total_volume buy_volume sell_volume institutional_volume")
def _(read):
    # the count of bars that only touch an edge depends on the last bit of the edge; volumes do not
    return R.volume_profile(bars_4h(read), LOOK, ROWS).drop("n_bars", "avg_size")


@query("a16_volume_profile_daily", f"{SQL_PROF_D} SELECT * EXCLUDE (n_bars, avg_size) FROM prof",
       r6="price_level", r2="total_volume buy_volume sell_volume institutional_volume")
def _(read):
    return R.volume_profile(bars_1d(read), LOOK, ROWS).drop("n_bars", "avg_size")


SQL_VA = """va0 AS (SELECT *, coalesce(sum(total_volume) OVER (PARTITION BY symbol ORDER BY total_volume DESC, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS bef,
  sum(total_volume) OVER (PARTITION BY symbol) AS al FROM prof),
va AS (SELECT symbol, timeframe, max(price_level) AS va_high, min(price_level) AS va_low, count(*) AS va_rows FROM va0 WHERE bef < 0.7 * al GROUP BY 1, 2)"""
SQL_PM = f"""{SQL_VA},
poc AS (SELECT symbol, timeframe, arg_min(price_level, ROW(-total_volume, row_no)) AS poc_price, max(total_volume) AS poc_volume, sum(total_volume) AS total_volume,
  sum(buy_volume) - sum(sell_volume) AS net_delta, coalesce((sum(buy_volume) - sum(sell_volume)) / nullif(sum(buy_volume) + sum(sell_volume), 0), 0.0) AS delta_ratio,
  coalesce(sum(institutional_volume) / nullif(sum(total_volume), 0), 0.0) AS institutional_ratio FROM prof GROUP BY 1, 2),
bal AS (SELECT symbol, coalesce((sum(p.total_volume) FILTER (price_level > poc_price) - sum(p.total_volume) FILTER (price_level <= poc_price)) / nullif(sum(p.total_volume), 0), 0.0) AS profile_balance
  FROM prof p JOIN poc USING (symbol) GROUP BY 1),
pm AS (SELECT poc.*, va_high, va_low, va_rows, profile_balance FROM poc JOIN va USING (symbol) JOIN bal USING (symbol))"""


@query("a18_profile_metrics", f"{SQL_PROF}, {SQL_PM} SELECT * FROM pm",
       r4="poc_price poc_volume total_volume net_delta va_high va_low", r6="delta_ratio institutional_ratio profile_balance")
def _(read):
    return R.profile_metrics(R.volume_profile(bars_4h(read), LOOK, ROWS))


@query("a19_value_area", f"{SQL_PROF_D}, {SQL_VA} SELECT * FROM va", r6="va_high va_low")
def _(read):
    return R.value_area(R.volume_profile(bars_1d(read), LOOK, ROWS))


@query("a20_value_area_contiguous", f"""WITH RECURSIVE {SQL_PROF[len('WITH '):]},
g0 AS (SELECT symbol, timeframe, arg_min(row_no, ROW(-total_volume, row_no)) AS poc, max(total_volume) AS v, sum(total_volume) * 0.7 AS goal, max(row_no) AS top FROM prof GROUP BY 1, 2),
gw(symbol, lo, hi, v, goal, top, step) AS (SELECT symbol, poc, poc, v, goal, top, 0 FROM g0
  UNION ALL SELECT g.symbol, CASE WHEN g.hi < g.top AND coalesce(u.total_volume, -1) >= coalesce(d.total_volume, -1) THEN g.lo ELSE g.lo - 1 END,
    CASE WHEN g.hi < g.top AND coalesce(u.total_volume, -1) >= coalesce(d.total_volume, -1) THEN g.hi + 1 ELSE g.hi END,
    g.v + greatest(coalesce(u.total_volume, -1), coalesce(d.total_volume, -1)), g.goal, g.top, g.step + 1
  FROM gw g LEFT JOIN prof u ON u.symbol = g.symbol AND u.row_no = g.hi + 1 LEFT JOIN prof d ON d.symbol = g.symbol AND d.row_no = g.lo - 1
  WHERE g.v < g.goal AND (u.row_no IS NOT NULL OR d.row_no IS NOT NULL)),
fin AS (SELECT symbol, arg_max(lo, step) AS lo, arg_max(hi, step) AS hi, arg_max(v, step) AS va_volume FROM gw GROUP BY 1),
ed AS (SELECT symbol, (max(price_level) - min(price_level)) / (2.0 * max(row_no)) AS edge FROM prof GROUP BY 1)
SELECT f.symbol, g0.timeframe, p.price_level AS poc_price, a.price_level - edge AS va_low, z.price_level + edge AS va_high, va_volume
FROM fin f JOIN g0 USING (symbol) JOIN ed USING (symbol) JOIN prof p ON p.symbol = f.symbol AND p.row_no = g0.poc
JOIN prof a ON a.symbol = f.symbol AND a.row_no = f.lo JOIN prof z ON z.symbol = f.symbol AND z.row_no = f.hi""",
       r4="poc_price va_low va_high va_volume")
def _(read):
    return R.value_area_contiguous(R.volume_profile(bars_4h(read), LOOK, ROWS))


@query("a21_smart_levels", f"""{SQL_PROF_D}, fl AS (SELECT symbol, quantile_cont(total_volume, 0.85) AS fl FROM prof GROUP BY 1),
hv AS (SELECT p.*, row_number() OVER (PARTITION BY symbol ORDER BY row_no) AS i FROM prof p JOIN fl USING (symbol) WHERE total_volume > fl)
SELECT symbol, timeframe, price_level AS price, total_volume AS volume, 1::BIGINT AS strength, buy_volume, sell_volume, institutional_volume FROM hv
WHERE NOT EXISTS (SELECT 1 FROM hv o WHERE o.symbol = hv.symbol AND o.row_no <> hv.row_no AND abs(o.price_level - hv.price_level) / least(o.price_level, hv.price_level) < 0.002)""",
       r6="price", r2="volume buy_volume sell_volume institutional_volume")
def _(read):
    # rows of this profile are further apart than the tolerance, so every group has one row
    return R.smart_levels(R.volume_profile(bars_1d(read), LOOK, ROWS))


@query("a21_smart_levels_wide", f"""WITH RECURSIVE {SQL_4H[len('WITH '):]}, {sql_features()}, {sql_profile(LOOK, 100)}, fl AS (SELECT symbol, quantile_cont(total_volume, 0.7) AS fl FROM prof GROUP BY 1),
hv AS (SELECT p.*, row_number() OVER (PARTITION BY symbol ORDER BY row_no) AS i FROM prof p JOIN fl USING (symbol) WHERE total_volume > fl),
sd AS (SELECT symbol, i, price_level AS seed FROM hv WHERE i = 1 UNION ALL
  SELECT h.symbol, h.i, CASE WHEN abs(g.seed - h.price_level) / g.seed < 0.05 THEN g.seed ELSE h.price_level END FROM sd g JOIN hv h ON h.symbol = g.symbol AND h.i = g.i + 1)
SELECT symbol, timeframe, sum(price_level * total_volume) / sum(total_volume) AS price, sum(total_volume) AS volume, count(*) AS strength,
  sum(buy_volume) AS buy_volume, sum(sell_volume) AS sell_volume, sum(institutional_volume) AS institutional_volume FROM hv JOIN sd USING (symbol, i) GROUP BY symbol, timeframe, seed""",
       r6="price", r2="volume buy_volume sell_volume institutional_volume")
def _(read):
    return R.smart_levels(R.volume_profile(bars_4h(read), LOOK, 100), 0.7, 0.05)


@query("a17_dynamic_rows", f"""{SQL_4H}, t AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER ({W})), 0), coalesce(abs(low - lag(close) OVER ({W})), 0)) AS tr FROM b),
a AS ({sql_rma('t', 'tr', 20, 'atr_20')}) SELECT t.symbol, t.ts, atr_20, CASE WHEN atr_20 IS NULL THEN -1 ELSE greatest(15, least(100, 30 + round(atr_20 / close * 1000))) END::INT AS profile_rows
FROM t LEFT JOIN a USING (symbol, bar_no)""", r6="atr_20")
def _(read):
    return R.dynamic_rows(bars_4h(read)).na.fill(-1, ["profile_rows"]).select("symbol", "ts", "atr_20", "profile_rows")


@query("a22_cluster_levels", f"""{SQL_1D}, v AS (SELECT *, {sql_sma('volume', 50)} AS av FROM b),
n AS (SELECT a.symbol, a.bar_no, a.ts, a.close, a.av, count(*) AS members, sum(c.volume) AS cluster_volume FROM v a JOIN v c ON c.symbol = a.symbol
  AND c.bar_no BETWEEN a.bar_no - 10 AND a.bar_no + 10 AND abs(c.close - a.close) / a.close < 0.02 GROUP BY ALL)
SELECT symbol, ts, close, members::INT AS members, cluster_volume FROM n WHERE members >= 3 AND cluster_volume > 2 * av""", r4="close cluster_volume")
def _(read):
    return R.cluster_levels(bars_1d(read), tolerance=0.02).select("symbol", "ts", "close", "members", "cluster_volume")


@query("a39_profile_approx", f"""{SQL_4H}, p AS (SELECT *, {_sql_vwma('(high + low) / 2', 50)} AS poc, max(high) OVER ({last_n(50)}) - min(low) OVER ({last_n(50)}) AS rg FROM b)
SELECT symbol, ts, poc, poc + 0.3 * rg AS va_high, poc - 0.3 * rg AS va_low FROM p""", r8="poc va_high va_low")
def _(read):
    return R.profile_approx(bars_4h(read), 50).select("symbol", "ts", "poc", "va_high", "va_low")


@query("p31_level_examples", f"""{SQL_PROF}, {SQL_PM}
SELECT f.symbol, f.ts, coalesce(close > poc_price AND f.volume > volume_sma_20 * 2 AND delta_ratio > 0.3, false) AS breakout_above_poc,
  coalesce((close <= va_low AND volume_rsi < 30) OR (close >= va_high AND volume_rsi > 70), false) AS value_area_reversal,
  coalesce(institutional_flow > 0 AND bar_no > 0 AND volume_delta > 0 AND volume_momentum > 0, false) AS flow_following FROM feat f LEFT JOIN pm USING (symbol)""")
def _(read):
    bars = bars_4h(read)
    levels = R.profile_metrics(R.volume_profile(bars, LOOK, ROWS))
    return R.level_examples(I.volume_features(bars), levels).select(
        "symbol", "ts", "breakout_above_poc", "value_area_reversal", "flow_following")


def _sql_signals() -> str:
    """CTEs ending in ``vs``: the twelve flags."""
    rsi = f"""rs0 AS (SELECT *, close - lag(close) OVER ({W}) AS dc FROM feat),
rs AS (SELECT *, CASE WHEN count(*) OVER ({last_n(14)}) = 14 THEN avg(greatest(coalesce(dc, 0), 0)) OVER ({last_n(14)}) END AS cg,
  CASE WHEN count(*) OVER ({last_n(14)}) = 14 THEN avg(greatest(-coalesce(dc, 0), 0)) OVER ({last_n(14)}) END AS cs, {sql_sma('close', 20)} AS s20, {sql_sma('close', 50)} AS s50 FROM rs0)"""
    return f"""ef AS ({sql_ewm('b', 'close', 2 / 13, 'ef')}), es AS ({sql_ewm('b', 'close', 2 / 27, 'es')}),
ml AS (SELECT symbol, bar_no, ef - es AS macd FROM ef JOIN es USING (symbol, bar_no)), sg AS ({sql_ewm('ml', 'macd', 0.2, 'sgn')}), {rsi},
x AS (SELECT rs.*, macd, sgn, CASE WHEN cg <= 0 AND cs <= 0 THEN NULL WHEN cs <= 0 THEN 100.0 ELSE 100 - 100.0 / (1 + cg / cs) END AS r,
  CASE WHEN s20 > s50 AND close > s20 THEN 'up' WHEN s20 < s50 AND close < s20 THEN 'down' ELSE 'ranging' END AS reg, CASE WHEN bar_no > 0 THEN volume_delta END AS d
  FROM rs JOIN ml USING (symbol, bar_no) JOIN sg USING (symbol, bar_no)),
vs AS (SELECT x.symbol, x.timeframe, x.ts, x.bar_no, x.close,
  coalesce(volume_ratio > 2.5, false)::INT AS volume_breakout, coalesce(volume_ratio > 1.5 AND volume_ratio < 3.0, false)::INT AS volume_confirmation, coalesce(institutional_flow > 0, false)::INT AS institutional,
  coalesce(reg = 'up' AND macd > sgn AND r > 45 AND r < 75 AND d > 0, false)::INT AS bullish_trend, coalesce(reg = 'down' AND macd < sgn AND r < 55 AND r > 25 AND d < 0, false)::INT AS bearish_trend,
  coalesce(close <= poc_price * 1.02 AND close >= poc_price * 0.98 AND reg = 'up' AND volume_ratio > 1.2, false)::INT AS poc_support,
  coalesce((close > va_high AND reg = 'up') OR (close < va_low AND reg = 'down'), false)::INT AS va_breakout,
  coalesce(reg = 'ranging' AND r < 30 AND volume_ratio > 1.5 AND d > 0, false)::INT AS oversold_reversal, coalesce(reg = 'ranging' AND r > 70 AND volume_ratio > 1.5 AND d < 0, false)::INT AS overbought_reversal,
  coalesce(price_momentum < -0.02 AND volume_momentum > 0.1 AND r < 40, false)::INT AS bullish_divergence, coalesce(price_momentum > 0.02 AND volume_momentum < -0.1 AND r > 60, false)::INT AS bearish_divergence,
  coalesce(r > 80 OR r < 20 OR volume_ratio < 0.5, false)::INT AS profit_take FROM x LEFT JOIN pm USING (symbol))"""


FLAGS = ("volume_breakout", "volume_confirmation", "institutional", "bullish_trend", "bearish_trend", "poc_support",
         "va_breakout", "oversold_reversal", "overbought_reversal", "bullish_divergence", "bearish_divergence", "profit_take")
SQL_SIGNALS = f"{SQL_PROF}, {SQL_PM}, {_sql_signals()}"
SQL_TARGET = """tp0 AS (SELECT *, bullish_trend * 3 + poc_support * 2 + oversold_reversal * 2 + bullish_divergence * 2 + volume_breakout + institutional AS long_score,
  bearish_trend * 3 + va_breakout * 2 + overbought_reversal * 2 + bearish_divergence * 2 AS short_score FROM vs),
tp1 AS (SELECT *, greatest(max(long_score) OVER (PARTITION BY symbol), CASE WHEN max(long_score) OVER (PARTITION BY symbol) > 0 THEN 0 ELSE 1 END) AS ml,
  CASE WHEN max(short_score) OVER (PARTITION BY symbol) > 0 THEN max(short_score) OVER (PARTITION BY symbol) ELSE 1 END AS ms FROM tp0)"""


def signal_frame(read):
    bars = bars_4h(read)
    return S.volume_signals(bars, R.profile_metrics(R.volume_profile(bars, LOOK, ROWS)))


@query("w29_volume_signals", f"{SQL_SIGNALS} SELECT symbol, ts, {', '.join(FLAGS)} FROM vs")
def _(read):
    return signal_frame(read).select("symbol", "ts", *FLAGS)


@query("w30_target_position", f"""{SQL_SIGNALS}, {SQL_TARGET} SELECT symbol, ts, long_score, short_score, long_score / ml * 0.1 - short_score / ms * 0.1 AS target_position FROM tp1""",
       r8="target_position")
def _(read):
    return S.target_position(signal_frame(read)).select("symbol", "ts", "long_score", "short_score", "target_position")


@query("w30_target_position_fixed", f"""{SQL_SIGNALS}, {SQL_TARGET} SELECT symbol, ts, long_score / 11.0 * 0.1 - short_score / 9.0 * 0.1 AS target_position FROM tp0""",
       r8="target_position")
def _(read):
    return S.target_position(signal_frame(read), fixed=True).select("symbol", "ts", "target_position")


def bracket_input(read):
    """Target positions once per configuration; the size scales with its maximum."""
    # the scores are used for their maximum and for themselves
    base = K.with_configs(S.target_position(cut_lineage(signal_frame(read)), 1.0))
    return base.select("symbol", "timeframe", "config", "ts", "bar_no", "close", "profit_take", "stop_loss", "take_profit",
                       (F.col("target_position") * F.col("max_position")).alias("target_position"))


SQL_BRACKET = f"""{SQL_SIGNALS}, {SQL_TARGET}, cf AS (SELECT * FROM (VALUES ('Conservative', 0.05::DOUBLE, 0.03::DOUBLE, 0.10::DOUBLE), ('Moderate', 0.10, 0.05, 0.15), ('Aggressive', 0.15, 0.07, 0.20)) t(config, mp, sl, tk)),
tg AS (SELECT symbol, timeframe, config, ts, bar_no, close, profit_take, sl, tk, (long_score / ml * 1.0 - short_score / ms * 1.0) * mp AS t FROM tp1, cf),
cx AS (SELECT e.symbol, e.timeframe, e.config, e.bar_no AS entry_no, e.close AS entry_price, e.t AS target_position, min(x.bar_no) AS exit_no, arg_min(x.close, x.bar_no) AS exit_price
  FROM tg e LEFT JOIN tg x ON x.symbol = e.symbol AND x.config = e.config AND x.bar_no > e.bar_no AND (
    sign(e.t) * (x.close - e.close) / e.close <= -e.sl OR sign(e.t) * (x.close - e.close) / e.close >= e.tk OR x.profit_take > 0 OR sign(e.t) * x.t < 0)
  WHERE abs(e.t) > 0.01 AND e.bar_no >= 1 GROUP BY ALL)"""


@query("w31_bracket_exits", f"""{SQL_BRACKET} SELECT symbol, config, entry_no, entry_price, target_position, coalesce(exit_no, -1) AS exit_no, exit_price,
  target_position * (exit_price - entry_price) / entry_price AS trade_return FROM cx""", r6="entry_price exit_price trade_return", r8="target_position")
def _(read):
    return K.bracket_exits(bracket_input(read)).select(
        "symbol", "config", "entry_no", "entry_price", "target_position", F.coalesce("exit_no", F.lit(-1)).alias("exit_no"),
        "exit_price", "trade_return")


SQL_CHAIN = f"""WITH RECURSIVE {SQL_BRACKET[len('WITH '):]}, cx1 AS MATERIALIZED (SELECT * FROM cx),
ch(symbol, config, entry_no, exit_no, trade_no) AS (SELECT symbol, config, min(entry_no), arg_min(exit_no, entry_no), 1::BIGINT FROM cx1 GROUP BY 1, 2
  UNION ALL SELECT c.symbol, c.config, n.entry_no, n.exit_no, c.trade_no + 1 FROM ch c JOIN cx1 n ON n.symbol = c.symbol AND n.config = c.config
  AND n.entry_no = (SELECT min(m.entry_no) FROM cx1 m WHERE m.symbol = c.symbol AND m.config = c.config AND m.entry_no >= c.exit_no) WHERE c.exit_no IS NOT NULL),
tr AS (SELECT c.symbol, c.config, c.trade_no, x.* EXCLUDE (symbol, config), x.target_position * (exit_price - entry_price) / entry_price AS trade_return
  FROM ch c JOIN cx1 x ON x.symbol = c.symbol AND x.config = c.config AND x.entry_no = c.entry_no)"""


@query("w32_bracket_trades", f"""{SQL_CHAIN} SELECT symbol, config, trade_no, entry_no, coalesce(exit_no, -1) AS exit_no, entry_price, exit_price, trade_return FROM tr""",
       r6="entry_price exit_price trade_return")
def _(read):
    return K.bracket_trades(K.bracket_exits(bracket_input(read))).select(
        "symbol", "config", "trade_no", "entry_no", F.coalesce("exit_no", F.lit(-1)).alias("exit_no"), "entry_price",
        "exit_price", "trade_return")


@query("g4_sweep_brackets", f"""{SQL_CHAIN} SELECT symbol, timeframe, config, count(trade_return) AS total_trades, count(*) FILTER (trade_return > 0) AS wins,
  coalesce(avg(trade_return) FILTER (trade_return > 0), 0.0) AS avg_win, coalesce(avg(trade_return) FILTER (trade_return < 0), 0.0) AS avg_loss, coalesce(sum(trade_return), 0.0) AS sum_return,
  coalesce(count(*) FILTER (trade_return > 0) / nullif(count(trade_return), 0), 0.0) AS win_rate,
  abs(coalesce(avg(trade_return) FILTER (trade_return > 0), 0.0) * count(*) FILTER (trade_return > 0) / nullif(coalesce(avg(trade_return) FILTER (trade_return < 0), 0.0) * (count(trade_return) - count(*) FILTER (trade_return > 0)), 0)) AS profit_factor
FROM tr GROUP BY 1, 2, 3""", r6="avg_win avg_loss sum_return win_rate profit_factor")
def _(read):
    return K.bracket_metrics(K.bracket_trades(K.bracket_exits(bracket_input(read))))


SQL_CURVE = f"""{SQL_CHAIN}, held AS (SELECT b.symbol, b.config, b.ts, b.bar_no, b.close, coalesce(t.target_position, 0.0) AS position
  FROM tg b LEFT JOIN tr t ON t.symbol = b.symbol AND t.config = b.config AND b.bar_no >= t.entry_no AND (t.exit_no IS NULL OR b.bar_no < t.exit_no)),
moved AS (SELECT *, coalesce(lag(position) OVER w * (close / lag(close) OVER w - 1), 0.0) AS strategy_return FROM held WINDOW w AS (PARTITION BY symbol, config ORDER BY bar_no))
SELECT symbol, config, ts, position, strategy_return, product(1 + strategy_return) OVER (PARTITION BY symbol, config ORDER BY bar_no) AS growth FROM moved"""


@query("w32_bracket_curve", SQL_CURVE, r6="growth", r8="position strategy_return")
def _(read):
    targets = bracket_input(read)
    return K.bracket_curve(targets, K.bracket_trades(K.bracket_exits(targets))).select(
        "symbol", "config", "ts", "position", "strategy_return", "growth")
