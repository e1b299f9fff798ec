"""Result store: merges, audits, coverage, named views and serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import guards as U
from ..operators import performance as P
from ..operators import signals as S
from ..operators import store as O
from .inputs import SQL_1D, SQL_4H, W, bars_1d, bars_4h, sql_curve, sql_sma_signal
from .market import SQL_EXC, excursion_frame, sql_knn_trend
from .metrics import SQL_CURVE, curve_frame
from .registry import query

def order_day():
    return F.to_date("o_orderdate")


def stored(read):
    """Orders before 1998 as the stored table."""
    return read("orders").filter("o_orderdate < timestamp_ntz'1998-01-01'").select("o_custkey", F.col("o_orderkey").alias("version"), "o_totalprice", "o_orderstatus")


def incoming(read):
    """Newest order of each customer since 1997 as the incoming batch."""
    new = read("orders").filter("o_orderdate >= timestamp_ntz'1997-01-01'")
    return new.groupBy("o_custkey").agg(F.max("o_orderkey").alias("version"), F.max_by("o_totalprice", "o_orderkey").alias("o_totalprice"),
                                        F.max_by("o_orderstatus", "o_orderkey").alias("o_orderstatus"))


SQL_ST = """st AS (SELECT o_custkey, max(o_orderkey) AS version, arg_max(o_totalprice, o_orderkey) AS o_totalprice, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
nw AS (SELECT o_custkey, max(o_orderkey) AS version, arg_max(o_totalprice, o_orderkey) AS o_totalprice, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1)"""


@query("s17_upsert", f"WITH {SQL_ST} SELECT * FROM nw UNION ALL SELECT * FROM st WHERE o_custkey NOT IN (SELECT o_custkey FROM nw)", r2="o_totalprice")
def _(read):
    old = O.enforce_key(stored(read), ["o_custkey"], "version")
    return O.merge_upsert(old, incoming(read), ["o_custkey"])


@query("s18_fill_blanks", f"""WITH {SQL_ST}, t AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS a, CASE WHEN version % 2 = 0 THEN NULL ELSE version::VARCHAR END AS b FROM st),
s AS (SELECT o_custkey, o_orderstatus AS a, version::VARCHAR AS b FROM nw)
SELECT coalesce(t.o_custkey, s.o_custkey) AS o_custkey, coalesce(nullif(t.a, ''), nullif(s.a, ''), '') AS a, coalesce(nullif(t.b, ''), nullif(s.b, ''), '') AS b FROM t FULL JOIN s ON t.o_custkey = s.o_custkey""")
def _(read):
    old = O.enforce_key(stored(read), ["o_custkey"], "version").selectExpr(
        "o_custkey", "CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS a", "CASE WHEN version % 2 = 0 THEN NULL ELSE CAST(version AS STRING) END AS b")
    new = incoming(read).selectExpr("o_custkey", "o_orderstatus AS a", "CAST(version AS STRING) AS b")
    return O.merge_fill_blanks(old, new, ["o_custkey"], ["a", "b"])


@query("s19_j14_missing_rows", f"WITH {SQL_ST} SELECT * FROM nw WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')", r2="o_totalprice")
def _(read):
    known = read("orders").filter("o_orderdate < timestamp_ntz'1996-01-01'").select("o_custkey")
    return O.missing_rows(known, incoming(read), ["o_custkey"])


@query("s20_daily_summary", """SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS created_day, max(o_orderkey) AS last_id, arg_max(o_totalprice, o_orderkey) AS total FROM orders GROUP BY 1""", r2="total")
def _(read):
    """The last row of a day replaces the earlier ones."""
    df = read("orders").select(F.to_date("o_orderdate").alias("created_day"), "o_orderkey", "o_totalprice")
    return O.enforce_key(df, ["created_day"], "o_orderkey").select("created_day", F.col("o_orderkey").alias("last_id"), F.col("o_totalprice").alias("total"))


@query("s21_retain", "SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS date_analyzed FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 90 DAY")
def _(read):
    df = read("orders").select("o_orderkey", order_day().alias("date_analyzed"))
    return O.retained(df, 90, F.lit("1998-01-01").cast("date"))


@query("r6_clear_day", "SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS date_analyzed FROM orders WHERE o_orderdate NOT IN (TIMESTAMP '1997-03-03', TIMESTAMP '1997-03-04')")
def _(read):
    from datetime import date
    df = read("orders").select("o_orderkey", order_day().alias("date_analyzed"))
    return O.clear_days(df, [date(1997, 3, 3), date(1997, 3, 4)])


@query("a30_d4_audit_duplicates", """SELECT 'lineitem' AS table_name, count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_keys,
  (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS n_repeated, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_excess FROM lineitem
UNION ALL SELECT 'orders', count(*), count(DISTINCT o_orderkey), 0, count(*) - count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'events', count(*), (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)), (SELECT count(*) FROM (SELECT 1 FROM events GROUP BY user_id, event_type HAVING count(*) > 1)), count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) FROM events""")
def _(read):
    return O.audit_duplicates({"lineitem": (read("lineitem"), ["l_orderkey", "l_linenumber"]), "orders": (read("orders"), ["o_orderkey"]),
                               "events": (read("events"), ["user_id", "event_type"])})


@query("a30_repeated_keys", "SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def _(read):
    return O.repeated_keys(read("events"), ["user_id", "event_type"], "event_id")


@query("a30_repeated_key_ids", "SELECT user_id, event_type, n, event_id FROM events JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1) USING (user_id, event_type)")
def _(read):
    return O.repeated_key_ids(read("events"), ["user_id", "event_type"], "event_id")


@query("d12_enforce_key", "SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2", r2="l_extendedprice")
def _(read):
    return O.enforce_key(read("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey", "l_linenumber"], "l_extendedprice")


@query("a31_coverage", f"""{SQL_4H}, x AS (SELECT symbol, 180::BIGINT AS expected_rows, table_name FROM (SELECT DISTINCT symbol FROM b), (VALUES ('trend'), ('equity')) v(table_name)),
c AS (SELECT 'trend' AS table_name, symbol, count(*) AS n, min(ts) AS a, max(ts) AS z FROM b GROUP BY 2 UNION ALL SELECT 'equity', symbol, count(*), min(ts), max(ts) FROM b WHERE close > open GROUP BY 2)
SELECT x.symbol, expected_rows, table_name, coalesce(n, 0) AS n_rows, a AS first_ts, z AS last_ts, coalesce(n, 0) >= floor(expected_rows * 0.95) AS is_complete FROM x LEFT JOIN c USING (symbol, table_name)""")
def _(read):
    bars = bars_4h(read)
    expected = bars.select("symbol").distinct().withColumn("expected_rows", F.lit(180).cast("long"))
    return O.coverage({"trend": bars, "equity": bars.filter("close > open")}, ["symbol"], expected)


@query("a32_completeness", """WITH d AS (SELECT count(*) AS total, count(*) FILTER (text <> '') AS a, count(*) FILTER (lang <> '') AS b, count(*) FILTER (CASE WHEN n_chars > 1000 THEN source END <> '') AS c FROM documents)
SELECT 'text' AS column_name, a AS n_filled, total, a * 100.0 / total AS filled_pct FROM d UNION ALL SELECT 'lang', b, total, b * 100.0 / total FROM d UNION ALL SELECT 'long_source', c, total, c * 100.0 / total FROM d""", r6="filled_pct")
def _(read):
    df = read("documents").withColumn("long_source", F.when(F.col("n_chars") > 1000, F.col("source")))
    return O.completeness(df, ["text", "lang", "long_source"])


@query("a32_numeric_profile", """SELECT 'value' AS column_name, count(*) FILTER (event_id % 11 = 0) AS n_null, count(*) FILTER (event_id % 11 <> 0 AND event_id % 13 = 0) AS n_nan, 0::BIGINT AS n_infinite, count(*) FILTER (event_id % 11 <> 0 AND event_id % 13 <> 0 AND value = 0) AS n_zero,
  min(value) FILTER (event_id % 11 <> 0 AND event_id % 13 <> 0) AS min_value, max(value) FILTER (event_id % 11 <> 0 AND event_id % 13 <> 0) AS max_value FROM events""", r2="min_value max_value")
def _(read):
    v = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return O.numeric_profile(read("events").select(v.alias("value")), ["value"])


@query("a33_profile_rows", f"{SQL_4H} SELECT count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT symbol) AS n_symbols, count(DISTINCT timeframe) AS n_timeframes FROM b")
def _(read):
    return O.profile_rows(bars_4h(read))


@query("d3_concat_results", f"{SQL_CURVE} SELECT 'curve' AS part, symbol, count(*) AS n FROM curve GROUP BY 2 UNION ALL SELECT 'bars', symbol, count(*) FROM b GROUP BY 2")
def _(read):
    a = curve_frame(read).groupBy("symbol").agg(F.count("*").alias("n")).withColumn("part", F.lit("curve"))
    b = bars_4h(read).groupBy("symbol").agg(F.count("*").alias("n")).withColumn("part", F.lit("bars"))
    return a.unionByName(b)


@query("p26_clean_import", """SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS entry_time, CASE WHEN o_orderkey % 4 NOT IN (0, 1) THEN nullif(o_custkey, 0)::DOUBLE END AS duration FROM orders""")
def _(read):
    df = read("orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 10 = 0 THEN 'bad' ELSE CAST(o_orderdate AS STRING) END AS entry_time",
                                   "CASE o_orderkey % 4 WHEN 0 THEN '0' WHEN 1 THEN 'x' ELSE CAST(o_custkey AS STRING) || '.0' END AS duration")
    return O.clean_import(df, ["entry_time"], ["duration"]).withColumn("duration", F.col("duration").cast("double"))


@query("p27_label_trend", f"""{SQL_4H}, {sql_knn_trend()} SELECT symbol, ts, CASE trend WHEN 'up' THEN 'BULLISH' WHEN 'down' THEN 'BEARISH' ELSE 'NEUTRAL' END AS trend_direction, signal_type = 1 AS buy_signal, signal_type = -1 AS sell_signal,
  CASE WHEN signal_type <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS signal_strength FROM kt""")
def _(read):
    from ..operators.indicators import knn_trend
    t = knn_trend(bars_4h(read))
    return t.select("symbol", "ts", U.trend_label("trend").alias("trend_direction"), (F.col("signal_type") == 1).alias("buy_signal"),
                    (F.col("signal_type") == -1).alias("sell_signal"), F.when(F.col("signal_type") != 0, 1.0).otherwise(0.0).alias("signal_strength"))


# ---------------------------------------------------------------- views


@query("v1_latest_equity_curves", f"{SQL_CURVE}, d AS (SELECT symbol, ts, equity, date_trunc('day', ts)::TIMESTAMP AS date_analyzed FROM curve) SELECT * FROM d WHERE date_analyzed = (SELECT max(date_analyzed) FROM d)", r4="equity")
def _(read):
    df = curve_frame(read).select("symbol", "ts", "equity", F.to_date("ts").alias("date_analyzed"))
    return O.newest(df, "date_analyzed")


@query("v2_p29_recent_signals", f"{SQL_4H}, {sql_sma_signal(10)} SELECT symbol, ts, close, signal_type FROM sig WHERE signal_type <> 0 AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY", r6="close")
def _(read):
    sig = O.flagged(S.sma_cross(bars_4h(read), 10))
    return O.recent(sig, 7, F.lit("2024-01-31").cast("timestamp_ntz")).select("symbol", "ts", "close", "signal_type")


@query("v3_t6_chart_data", f"{SQL_4H} SELECT symbol, ts, open, high, low, close FROM b WHERE timeframe = '4h' ORDER BY ts DESC, symbol LIMIT 100", r6="open high low close")
def _(read):
    return O.chart_data(bars_4h(read), "4h", 100).select("symbol", "ts", "open", "high", "low", "close")


@query("v4_latest_performance", """WITH t AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS date_analyzed, o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2) SELECT * FROM t WHERE date_analyzed = (SELECT max(date_analyzed) FROM t)""", r2="total")
def _(read):
    t = read("orders").groupBy(order_day().alias("date_analyzed"), "o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return O.newest(t, "date_analyzed")


@query("v5_top_today", """WITH s AS (SELECT o_orderkey, o_totalprice, o_orderdate::TIMESTAMP AS snapshot_date FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)) SELECT * FROM s ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""", r2="o_totalprice")
def _(read):
    s = O.newest(read("orders").select("o_orderkey", "o_totalprice", F.col("o_orderdate").alias("snapshot_date")), "snapshot_date")
    return s.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10)


@query("v6_signal_stats_function", f"""{SQL_EXC} SELECT timeframe, signal_type, count(*) AS n_signals, avg(final_return_pct) AS avg_return FROM exc WHERE timeframe = '1h' GROUP BY 1, 2""", r6="avg_return")
def _(read):
    """Statistics of one timeframe through a SQL statement on the view."""
    exc = excursion_frame(read)
    O.create_views(exc.sparkSession, {"barloom_signals": exc})
    return exc.sparkSession.sql("""SELECT timeframe, signal_type, count(*) AS n_signals, avg(final_return_pct) AS avg_return
        FROM barloom_signals WHERE timeframe = '1h' GROUP BY timeframe, signal_type""")


@query("v7_f17_signal_history", f"""{SQL_EXC} SELECT symbol, signal_type, strftime(entry_time, '%Y-%m-%d %H:%M') AS entry_text, entry_price, exit_price, CASE WHEN signal_type = 'BUY' THEN max_gain_pct ELSE max_drop_pct END AS extreme_pct, final_return_pct AS return_pct
FROM exc ORDER BY entry_time DESC, symbol LIMIT 50""", r2="entry_price exit_price extreme_pct return_pct")
def _(read):
    return O.signal_history(excursion_frame(read), 50)


@query("v8_flagged_signals", f"{SQL_4H}, {sql_sma_signal(10)} SELECT symbol, ts, signal_type FROM sig WHERE signal_type <> 0")
def _(read):
    return O.flagged(S.sma_cross(bars_4h(read), 10)).select("symbol", "ts", "signal_type")


@query("w37_first_last_value", f"""{SQL_CURVE} SELECT symbol, ts, first_value(equity) OVER (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts) AS first_value, last_value(equity) OVER (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_value FROM curve""",
       r4="first_value last_value")
def _(read):
    from pyspark.sql import Window
    # a day of one series is a handful of bars
    w = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return curve_frame(read).select("symbol", "ts", F.first("equity").over(w).alias("first_value"), F.last("equity").over(w).alias("last_value"))
