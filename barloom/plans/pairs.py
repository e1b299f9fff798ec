"""Pairs of series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import guards as U
from ..operators import assets as A
from ..operators import pairs as X
from .inputs import SQL_1D, SQL_1H, bars_1d, bars_1h, event_ticks
from .registry import query

A_, B_ = "click", "view"


def two(read):
    bars = bars_1h(read)
    return tuple(bars.filter(F.col("symbol") == s).select("ts", "close", "volume") for s in (A_, B_))


def two_daily(read):
    bars = bars_1d(read)
    return tuple(bars.filter(F.col("symbol") == s).select("ts", "close", "volume") for s in ("S1", "S2"))


SQL_TWO = f"{SQL_1H}, l AS (SELECT ts, close, volume FROM b WHERE symbol = '{A_}'), r AS (SELECT ts, close, volume FROM b WHERE symbol = '{B_}')"
SQL_TWO_D = f"{SQL_1D}, l AS (SELECT ts, close, volume FROM b WHERE symbol = 'S1'), r AS (SELECT ts, close, volume FROM b WHERE symbol = 'S2')"
SQL_PAIR = f"{SQL_TWO_D}, p AS (SELECT 'S1/S2' AS pair, l.ts, l.close AS a_close, r.close AS b_close, l.close / r.close AS close_ratio FROM l JOIN r USING (ts))"


@query("j1_j2_align_exact", f"""{SQL_TWO} SELECT ts, l.close AS a_close, l.volume AS a_volume, r.close AS b_close, r.volume AS b_volume, l.close / r.close AS close_ratio, l.volume / r.volume AS volume_ratio
FROM l JOIN r USING (ts)""", r6="a_close b_close close_ratio volume_ratio")
def _(read):
    return X.align_exact(*two(read), ("close", "volume"))


@query("j3_align_asof", f"""{SQL_TWO}, u AS (SELECT coalesce(l.ts, r.ts) AS ts, l.close AS lc, r.close AS rc FROM l FULL JOIN r ON l.ts = r.ts),
f AS (SELECT ts, last_value(lc IGNORE NULLS) OVER (ORDER BY ts) AS a_close, last_value(rc IGNORE NULLS) OVER (ORDER BY ts) AS b_close FROM u)
SELECT ts, a_close, b_close, a_close / b_close AS close_ratio FROM f WHERE a_close IS NOT NULL AND b_close IS NOT NULL""", r6="a_close b_close close_ratio")
def _(read):
    return X.align_asof(*two(read))


@query("j4_align_monthly", f"""{SQL_TWO_D}, lm AS (SELECT date_trunc('month', ts) AS m, max(ts) AS ts, arg_max(close, ts) AS c FROM l GROUP BY 1), rm AS (SELECT date_trunc('month', ts) AS m, arg_max(close, ts) AS c FROM r GROUP BY 1)
SELECT lm.ts, lm.c AS a_close, rm.c AS b_close, lm.c / rm.c AS close_ratio FROM lm JOIN rm USING (m)""", r6="a_close b_close close_ratio")
def _(read):
    return X.align_monthly(*two_daily(read))


@query("j5_align_overlap", f"""{SQL_TWO}, ld AS (SELECT date_trunc('day', ts)::TIMESTAMP AS d, arg_max(close, ts) AS c FROM l GROUP BY 1), rd AS (SELECT date_trunc('day', ts)::TIMESTAMP AS d, arg_max(close, ts) AS c FROM r GROUP BY 1)
SELECT ld.d AS ts, ld.c AS a_close, rd.c AS b_close, ld.c / rd.c AS close_ratio FROM ld JOIN rd USING (d)
WHERE d BETWEEN greatest((SELECT min(d) FROM ld), (SELECT min(d) FROM rd)) AND least((SELECT max(d) FROM ld), (SELECT max(d) FROM rd))""", r6="a_close b_close close_ratio")
def _(read):
    return X.align_overlap(*two(read))


@query("j6_align_auto", f"""{SQL_TWO_D}, same AS (SELECT (SELECT count(*) FROM l) = (SELECT count(*) FROM r) AS s),
lm AS (SELECT date_trunc('month', ts) AS m, max(ts) AS ts, arg_max(close, ts) AS c FROM l GROUP BY 1), rm AS (SELECT date_trunc('month', ts) AS m, arg_max(close, ts) AS c FROM r GROUP BY 1)
SELECT l.ts, l.close AS a_close, r.close AS b_close, l.close / r.close AS close_ratio FROM l JOIN r USING (ts), same WHERE s
UNION ALL SELECT lm.ts, lm.c, rm.c, lm.c / rm.c FROM lm JOIN rm USING (m), same WHERE NOT s""", r6="a_close b_close close_ratio")
def _(read):
    return X.align_auto(*two_daily(read))


def pair_frame(read):
    return X.align_exact(*two_daily(read)).withColumn("pair", F.lit("S1/S2"))


@query("a10_ratio_stats", f"""{SQL_PAIR}, s AS (SELECT pair, arg_max(close_ratio, ts) AS current_ratio, arg_min(close_ratio, ts) AS start_ratio, avg(close_ratio) AS avg_ratio, min(close_ratio) AS min_ratio, max(close_ratio) AS max_ratio,
  arg_min(ts, ROW(close_ratio, ts)) AS min_date, arg_min(ts, ROW(-close_ratio, ts)) AS max_date, (arg_max(close_ratio, ts) / arg_min(close_ratio, ts) - 1) * 100 AS change_pct,
  (arg_max(a_close, ts) / arg_min(a_close, ts) - 1) * 100 AS a_growth, (arg_max(b_close, ts) / arg_min(b_close, ts) - 1) * 100 AS b_growth FROM p GROUP BY 1)
SELECT *, max_ratio / min_ratio AS range_multiple, (current_ratio - min_ratio) / (max_ratio - min_ratio) * 100 AS range_position,
  CASE WHEN current_ratio > avg_ratio * 1.1 THEN 'STRONG' WHEN current_ratio < avg_ratio * 0.9 THEN 'WEAK' ELSE 'NEUTRAL' END AS strength,
  CASE WHEN current_ratio > avg_ratio * 1.15 THEN 'VERY STRONG' WHEN current_ratio > avg_ratio * 1.05 THEN 'STRONG' WHEN current_ratio < avg_ratio * 0.85 THEN 'WEAK' WHEN current_ratio < avg_ratio * 0.95 THEN 'SLIGHTLY WEAK' ELSE 'NEUTRAL' END AS strength_5 FROM s""",
       r6="current_ratio start_ratio avg_ratio min_ratio max_ratio change_pct a_growth b_growth range_multiple range_position")
def _(read):
    return X.ratio_stats(pair_frame(read))


SQL_BACK = f"{SQL_PAIR}, k AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts DESC) - 1 AS back, count(*) OVER (PARTITION BY pair) AS n FROM p)"


@query("a11_ratio_trend", f"""{SQL_BACK}, t AS (SELECT pair, avg(close_ratio) FILTER (back < 12) AS recent_avg, CASE WHEN max(n) >= 24 THEN avg(close_ratio) FILTER (back BETWEEN 12 AND 23) ELSE avg(close_ratio) END AS older_avg, count(*) AS n_rows FROM k GROUP BY 1)
SELECT *, CASE WHEN recent_avg > older_avg THEN 'UP' ELSE 'DOWN' END AS direction, abs((recent_avg - older_avg) / older_avg) * 100 AS change_pct FROM t""", r6="recent_avg older_avg change_pct")
def _(read):
    return X.ratio_trend(pair_frame(read))


@query("a11_ratio_trend_long", f"""{SQL_BACK}, t AS (SELECT pair, avg(close_ratio) FILTER (back < 90) AS recent_avg, avg(close_ratio) FILTER (back < 365) AS year_avg, count(*) AS n_rows FROM k GROUP BY 1)
SELECT *, CASE WHEN recent_avg > year_avg * 1.05 THEN 'UPWARD' WHEN recent_avg < year_avg * 0.95 THEN 'DOWNWARD' ELSE 'SIDEWAYS' END AS direction FROM t WHERE n_rows >= 365""", r6="recent_avg year_avg")
def _(read):
    # the small table shares fewer than 365 days; the query is then empty on both sides
    return X.ratio_trend_long(pair_frame(read))


@query("a12_yearly_extremes", f"""{SQL_PAIR} SELECT pair, coalesce(year(ts), 0)::INT AS year, max(close_ratio) AS max_ratio, arg_min(ts, ROW(-close_ratio, ts)) AS max_ts, min(close_ratio) AS min_ratio, arg_min(ts, ROW(close_ratio, ts)) AS min_ts FROM p GROUP BY 1, 2
UNION ALL SELECT pair, 0, max(close_ratio), arg_min(ts, ROW(-close_ratio, ts)), min(close_ratio), arg_min(ts, ROW(close_ratio, ts)) FROM p GROUP BY 1""", r6="max_ratio min_ratio")
def _(read):
    return X.yearly_extremes(pair_frame(read)).na.fill(0, ["year"])


@query("a12_change_back", f"""{SQL_BACK} SELECT pair, max(close_ratio) FILTER (back = 0) AS current_ratio, (max(close_ratio) FILTER (back = 0) / max(close_ratio) FILTER (back = 29) - 1) * 100 AS change_30,
  (max(close_ratio) FILTER (back = 0) / max(close_ratio) FILTER (back = 364) - 1) * 100 AS change_365 FROM k GROUP BY 1""", r6="current_ratio change_30 change_365")
def _(read):
    return X.ratio_change_back(pair_frame(read))


@query("a37_named_pair", f"""{SQL_1D}, s AS (SELECT symbol AS ticker, date_trunc('month', ts)::TIMESTAMP AS snapshot_date, sum(close * volume) AS market_cap, arg_max(close, ts) AS current_price FROM b GROUP BY 1, 2)
SELECT snapshot_date, max(market_cap) FILTER (ticker = 'S1') AS a_cap, max(market_cap) FILTER (ticker = 'S2') AS b_cap, max(current_price) FILTER (ticker = 'S1') AS a_price, max(current_price) FILTER (ticker = 'S2') AS b_price,
  max(market_cap) FILTER (ticker = 'S1') / max(market_cap) FILTER (ticker = 'S2') AS cap_ratio, max(current_price) FILTER (ticker = 'S1') / max(current_price) FILTER (ticker = 'S2') AS price_ratio FROM s WHERE ticker IN ('S1', 'S2') GROUP BY 1""",
       r4="a_cap b_cap a_price b_price", r6="cap_ratio price_ratio")
def _(read):
    return X.named_pair(monthly_snapshot(read), "S1", "S2")


def monthly_snapshot(read):
    return (bars_1d(read).groupBy(F.col("symbol").alias("ticker"), F.date_trunc("month", "ts").alias("snapshot_date"))
            .agg(F.sum(F.col("close") * F.col("volume")).alias("market_cap"), F.max_by("close", "ts").alias("current_price")))


@query("a38_overlap_profile", f"""{SQL_TWO}, s AS (SELECT count(*) AS a_rows, min(ts) AS a_first, max(ts) AS a_last FROM l), t AS (SELECT count(*) AS b_rows, min(ts) AS b_first, max(ts) AS b_last FROM r)
SELECT s.*, t.*, (SELECT count(*) FROM (SELECT date_trunc('day', ts) FROM l INTERSECT SELECT date_trunc('day', ts) FROM r)) AS common_days,
  (SELECT count(*) FROM (SELECT date_trunc('month', ts) FROM l INTERSECT SELECT date_trunc('month', ts) FROM r)) AS common_months FROM s, t""")
def _(read):
    return X.overlap_profile(*two(read))


@query("d2_splice", f"""{SQL_1D} SELECT symbol, ts, close, 'old' AS part FROM b WHERE ts < TIMESTAMP '1998-01-01' UNION ALL SELECT symbol, ts, close, 'new' FROM b WHERE ts >= TIMESTAMP '1998-01-01'
EXCEPT SELECT symbol, ts, close, 'old' FROM b WHERE ts >= (SELECT min(ts) FROM b WHERE ts >= TIMESTAMP '1998-01-01')""", r6="close")
def _(read):
    bars = bars_1d(read).select("symbol", "ts", "close")
    cut, late = F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("1999-01-01").cast("timestamp_ntz")
    old = bars.filter(F.col("ts") < late).withColumn("part", F.lit("old"))
    new = bars.filter(F.col("ts") >= cut).withColumn("part", F.lit("new"))
    return X.splice(old, new)


@query("d5_common_months", f"""{SQL_TWO_D} SELECT date_trunc('month', ts)::TIMESTAMP AS month FROM l INTERSECT SELECT date_trunc('month', ts)::TIMESTAMP FROM r""")
def _(read):
    a, b = (d.select(F.date_trunc("month", "ts").alias("month")) for d in two_daily(read))
    return a.intersect(b)


@query("p33_ratio_level", f"""{SQL_PAIR} SELECT ts, close_ratio, CASE WHEN close_ratio / 10 > 0.15 THEN 'high' WHEN close_ratio / 10 < 0.10 THEN 'low' ELSE 'normal' END AS ratio_level FROM p""", r6="close_ratio")
def _(read):
    return pair_frame(read).select("ts", "close_ratio", U.ratio_level(F.col("close_ratio") / 10).alias("ratio_level"))


@query("p30_quote_currency", """SELECT event_type || '/USDT' AS pair, count(*) AS n, sum(value * r) AS total_usd FROM events, (SELECT max(value) FILTER (event_type = 'error') / 100 AS r FROM events) GROUP BY 1""", r2="total_usd")
def _(read):
    rate = read("events").filter("event_type = 'error'").select((F.col("value") / 100).alias("usd_rate"))
    return (A.to_usd_quote(event_ticks(read), rate).groupBy("pair").agg(F.count("*").alias("n"), F.sum("price_usd").alias("total_usd")))


@query("f18_percentages", f"""{SQL_PAIR} SELECT ts, (a_close / b_close - 1) * 100 AS pct, a_close / (a_close + b_close) * 100 AS share, (a_close / b_close) / (b_close / a_close) AS rr FROM p""", r6="pct share rr")
def _(read):
    a, b = F.col("a_close"), F.col("b_close")
    return pair_frame(read).select("ts", U.pct(a, b).alias("pct"), U.share_pct(a, a + b).alias("share"), U.ratio_of_ratios(a, b, b, a).alias("rr"))
