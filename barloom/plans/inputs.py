"""The driver tables as ticks, bars and feeds, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators.series import number_bars
from ..session import cut_lineage


def event_ticks(read) -> DataFrame:
    """Events as ticks: the event type is the symbol, the value the price."""
    return read("events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"),
                                 F.lit(1.0).alias("volume"), F.col("event_id").alias("tick_id"))


def order_ticks(read) -> DataFrame:
    """Line items as ticks: ten symbols, unit price in whole cents, quantity as volume."""
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100
    return read("lineitem").select(
        F.concat(F.lit("S"), (F.col("l_suppkey") % 10).cast("string")).alias("symbol"), F.col("l_shipdate").alias("ts"),
        price.alias("price"), F.col("l_quantity").alias("volume"),
        F.struct("l_orderkey", "l_linenumber", price.alias("p")).alias("tick_id"))


def _stored(bars: DataFrame) -> DataFrame:
    """Numbered bars, written once to the shared checkpoint folder.

    Every later step reads these few rows instead of aggregating the ticks again.
    """
    return cut_lineage(number_bars(bars))


def bars_4h(read) -> DataFrame:
    return _stored(B.ticks_to_bars(event_ticks(read), "4 hours", "4h"))


def bars_1h(read) -> DataFrame:
    return _stored(B.ticks_to_bars(event_ticks(read), "1 hour", "1h"))


def bars_1d(read) -> DataFrame:
    return _stored(B.ticks_to_bars(order_ticks(read), "1 day", "1d"))


def sql_event_bars(hours: int) -> str:
    return f"""bars AS (
  SELECT event_type AS symbol, '{hours}h' AS timeframe, time_bucket(INTERVAL '{hours} hours', ts) AS ts,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, sum(1.0::DOUBLE) AS volume
  FROM events GROUP BY 1, 2, 3)"""


SQL_DAILY = """bars AS (
  SELECT symbol, '1d' AS timeframe, ts, first(price ORDER BY ok, ln, price) AS open, max(price) AS high,
         min(price) AS low, last(price ORDER BY ok, ln, price) AS close, sum(volume) AS volume
  FROM (SELECT 'S' || (l_suppkey % 10) AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts,
               floor(l_extendedprice / l_quantity * 100) / 100 AS price, l_quantity AS volume, l_orderkey AS ok, l_linenumber AS ln
        FROM lineitem) GROUP BY 1, 2, 3)"""

NUMBERED = """b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_no FROM bars)"""

SQL_4H = f"WITH {sql_event_bars(4)}, {NUMBERED}"
SQL_1H = f"WITH {sql_event_bars(1)}, {NUMBERED}"
SQL_1D = f"WITH {SQL_DAILY}, {NUMBERED}"
# named windows used by many statements
W = "PARTITION BY symbol ORDER BY bar_no"


def last_n(n: int) -> str:
    return f"{W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"


def sql_sma(x: str, n: int) -> str:
    return (f"CASE WHEN count({x}) OVER ({last_n(n)}) = {n} THEN avg({x}) OVER ({last_n(n)}) END")


def sql_wma(x: str, n: int) -> str:
    terms = " + ".join(f"{n - i} * lag({x}, {i}) OVER ({W})" for i in range(n))
    return f"({terms}) / {n * (n + 1) / 2}"


def sql_ewm(src: str, x: str, alpha: float, out: str, adjust: bool = True) -> str:
    """CTE body: exponential mean of x of table src, as its closed form."""
    q = 1.0 - alpha
    if adjust:
        value = f"sum(power({q!r}::DOUBLE, a.bar_no - c.bar_no) * c.{x}) / sum(power({q!r}::DOUBLE, a.bar_no - c.bar_no))"
    else:
        value = (f"sum(power({q!r}::DOUBLE, a.bar_no - c.bar_no) * c.{x} * "
                 f"CASE WHEN c.bar_no = 0 THEN 1.0::DOUBLE ELSE {alpha!r}::DOUBLE END)")
    return (f"SELECT a.symbol, a.bar_no, {value} AS {out} FROM {src} a JOIN {src} c "
            f"ON a.symbol = c.symbol AND c.bar_no <= a.bar_no GROUP BY a.symbol, a.bar_no")


def sql_rma(src: str, x: str, n: int, out: str, start: int = 0) -> str:
    """CTE body: Wilder mean seeded with the mean of the first n values from ``start`` on."""
    q = 1.0 - 1.0 / n
    s = start + n - 1
    return f"""SELECT a.symbol, a.bar_no, sum(power({q!r}::DOUBLE, a.bar_no - greatest(c.bar_no, {s})) * c.{x} / {n}.0) AS {out}
      FROM {src} a JOIN {src} c ON a.symbol = c.symbol AND c.bar_no BETWEEN {start} AND a.bar_no
      WHERE a.bar_no >= {s} GROUP BY a.symbol, a.bar_no"""


def sql_cross(a: str, b: str) -> str:
    pa, pb = f"lag({a}) OVER ({W})", f"lag({b}) OVER ({W})"
    return f"CASE WHEN {a} > {b} AND {pa} <= {pb} THEN 1 WHEN {a} < {b} AND {pa} >= {pb} THEN -1 ELSE 0 END"


def sql_macd(fast: int = 12, slow: int = 26, signal: int = 9) -> str:
    """CTEs ending in ``macd`` (bars with ema_fast, ema_slow, macd, macd_signal, histogram, signal_type)."""
    a = [2.0 / (x + 1) for x in (fast, slow, signal)]
    return f"""ef AS ({sql_ewm('b', 'close', a[0], 'ema_fast')}), es AS ({sql_ewm('b', 'close', a[1], 'ema_slow')}),
m0 AS (SELECT b.*, ema_fast, ema_slow, ema_fast - ema_slow AS macd FROM b JOIN ef USING (symbol, bar_no) JOIN es USING (symbol, bar_no)),
sg AS ({sql_ewm('m0', 'macd', a[2], 'macd_signal')}),
m1 AS (SELECT m0.*, macd_signal, macd - macd_signal AS histogram FROM m0 JOIN sg USING (symbol, bar_no)),
macd AS (SELECT *, {sql_cross('macd', 'macd_signal')} AS signal_type FROM m1)"""


def sql_sma_signal(n: int) -> str:
    """CTEs ending in ``sig`` (bars with sma and signal_type)."""
    return f"""s0 AS (SELECT *, {sql_sma('close', n)} AS sma FROM b),
sig AS (SELECT *, {sql_cross('close', 'sma')} AS signal_type FROM s0)"""


def sql_curve(src: str = "sig", capital: float = 10000.0, fee: float = 0.0) -> str:
    """CTEs ending in ``curve``: position, event, equity, peak, drawdown, benchmark, trade_no."""
    upto = f"{W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    before = f"{W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""c0 AS (SELECT *, coalesce(last_value(CASE WHEN signal_type <> 0 THEN signal_type END IGNORE NULLS) OVER ({before}), -1) AS was,
  coalesce(close / lag(close) OVER ({W}) - 1, 0.0) AS market_return FROM {src}),
c1 AS (SELECT *, CASE WHEN signal_type <> 0 AND signal_type <> was THEN signal_type ELSE 0 END AS event,
  CASE WHEN signal_type <> 0 THEN (signal_type > 0)::INT ELSE (was > 0)::INT END AS position,
  CASE WHEN was > 0 THEN market_return ELSE 0.0 END AS strategy_return FROM c0),
c2 AS (SELECT *, {capital} * exp(sum(ln((1 + strategy_return) * CASE WHEN event <> 0 THEN {1.0 - fee} ELSE 1.0 END)) OVER ({upto})) AS equity,
  (sum((event = 1)::INT) OVER ({upto}))::BIGINT AS trade_no, close / first_value(close) OVER ({W}) * {capital} AS benchmark FROM c1),
curve AS (SELECT *, equity / max(equity) OVER ({upto}) - 1 AS drawdown, benchmark / max(benchmark) OVER ({upto}) - 1 AS benchmark_drawdown FROM c2)"""


def sql_trades(src: str = "curve") -> str:
    """CTE ``trades`` out of ``curve``."""
    def at(side, c):
        return f"max(CASE WHEN event = {side} THEN {c} END)"
    return f"""trades AS (SELECT symbol, timeframe, trade_no, {at(1, 'ts')} AS entry_ts, {at(-1, 'ts')} AS exit_ts,
  {at(1, 'close')} AS entry_price, {at(-1, 'close')} AS exit_price, {at(1, 'equity')} AS entry_equity,
  {at(-1, 'equity')} AS exit_equity, {at(-1, 'bar_no')} - {at(1, 'bar_no')} AS bars_held,
  ({at(-1, 'close')} / {at(1, 'close')} - 1) * 100 AS return_pct
  FROM {src} WHERE event <> 0 AND trade_no > 0 GROUP BY 1, 2, 3)"""


def sql_excursions(src: str = "macd", extra: str = "macd, macd_signal, histogram") -> str:
    """CTE ``exc``: each signal with the extreme until the next opposite one."""
    pre = "".join(f", s.{c.strip()}" for c in extra.split(",")) if extra else ""
    grp = "".join(f", n.{c.strip()}" for c in extra.split(",")) if extra else ""
    return f"""sg1 AS (SELECT * FROM {src} WHERE signal_type <> 0),
nx AS (SELECT s.symbol, s.timeframe, s.bar_no, s.ts, s.close, s.signal_type{pre}, min(o.bar_no) AS x_no
  FROM sg1 s JOIN sg1 o ON o.symbol = s.symbol AND o.bar_no > s.bar_no AND o.signal_type = -s.signal_type
  GROUP BY s.symbol, s.timeframe, s.bar_no, s.ts, s.close, s.signal_type{pre}),
exc AS (SELECT n.symbol, n.timeframe, CASE WHEN n.signal_type = 1 THEN 'BUY' ELSE 'SELL' END AS signal_type,
  n.ts AS entry_time, x.ts AS exit_time, n.close AS entry_price, x.close AS exit_price,
  CASE WHEN n.signal_type = 1 THEN max(p.close) ELSE min(p.close) END AS extreme_price,
  CASE WHEN n.signal_type = 1 THEN (max(p.close) - n.close) / n.close * 100 END AS max_gain_pct,
  CASE WHEN n.signal_type = -1 THEN abs((min(p.close) - n.close) / n.close * 100) END AS max_drop_pct,
  CASE WHEN n.signal_type = 1 THEN x.close - n.close ELSE n.close - x.close END / n.close * 100 AS final_return_pct,
  CASE WHEN n.signal_type = 1 THEN arg_min(p.bar_no, ROW(-p.close, p.bar_no)) ELSE arg_min(p.bar_no, ROW(p.close, p.bar_no)) END - n.bar_no AS duration_to_extreme,
  CASE WHEN n.signal_type = 1 THEN n.x_no - n.bar_no END AS holding_period_duration,
  CASE WHEN n.signal_type = -1 THEN n.x_no - n.bar_no END AS waiting_period_duration{grp}
  FROM nx n JOIN b x ON x.symbol = n.symbol AND x.bar_no = n.x_no
  JOIN b p ON p.symbol = n.symbol AND p.bar_no BETWEEN n.bar_no AND n.x_no
  GROUP BY n.symbol, n.timeframe, n.signal_type, n.bar_no, n.x_no, n.ts, n.close, x.ts, x.close{grp})"""
