"""Texts, pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import text as T
from ..operators import assets as A
from ..sources import html as H
from ..sources import readers as D
from .registry import query

# ---------------------------------------------------------------- amounts written as text

# one text per order: dollars with a scale letter, coins, percent, noise
_TEXT = {
    "money": "CASE o_orderkey % 6 WHEN 0 THEN '$' || CAST(o_custkey AS {s}) || '.5 T' WHEN 1 THEN '$1,' || CAST(o_custkey % 900 + 100 AS {s}) || ' B' WHEN 2 THEN CAST(o_custkey AS {s}) || 'M' WHEN 3 THEN '$' || CAST(o_custkey AS {s}) || '.25' WHEN 4 THEN 'N/A' ELSE '' END",
    "number": "CASE o_orderkey % 7 WHEN 0 THEN CAST(o_custkey AS {s}) || '.5k' WHEN 1 THEN '₿ 9,' || CAST(o_custkey % 900 + 100 AS {s}) WHEN 2 THEN CAST(o_custkey AS {s}) || ' b' WHEN 3 THEN '-' || CAST(o_custkey AS {s}) || '.25%' WHEN 4 THEN 'N/A' WHEN 5 THEN '—' ELSE '3m' END",
    "name": "CASE o_orderkey % 5 WHEN 0 THEN 'Acme ' || o_orderpriority || ' 12AC' || CAST(o_custkey % 9 AS {s}) WHEN 1 THEN 'Big Firm ' || CAST(o_custkey % 90 + 10 AS {s}) || 'BF.L' WHEN 2 THEN 'Solo' WHEN 3 THEN 'Two Words' ELSE 'New Update ' || CAST(o_custkey AS {s}) END"}


def _text(kind: str, sql: bool = True) -> str:
    return _TEXT[kind].format(s="VARCHAR" if sql else "STRING")


def texts(read, *kinds):
    return read("orders").selectExpr("o_orderkey", *[f"{_text(k, False)} AS {k}" for k in kinds])


@query("f2_f4_parse_money", f"""WITH t AS (SELECT o_orderkey, trim(replace(replace({_text('money')}, '$', ''), ',', '')) AS m FROM orders)
SELECT o_orderkey, coalesce(trunc(CASE WHEN m LIKE '%T%' THEN try_cast(trim(replace(m, 'T', '')) AS DOUBLE) * 1e12 WHEN m LIKE '%B%' THEN try_cast(trim(replace(m, 'B', '')) AS DOUBLE) * 1e9
  WHEN m LIKE '%M%' THEN try_cast(trim(replace(m, 'M', '')) AS DOUBLE) * 1e6 ELSE try_cast(m AS DOUBLE) END)::BIGINT, 0) AS money, coalesce(round(try_cast(m AS DOUBLE), 2), 0.0) AS price FROM t""")
def _(read):
    return texts(read, "money").select("o_orderkey", T.parse_money("money").alias("money"), T.parse_price("money").alias("price"))


@query("f3_f4_parse_number", f"""WITH t AS (SELECT o_orderkey, {_text('number')} AS raw FROM orders), u AS (SELECT *, replace(replace(replace(replace(raw, ',', ''), '$', ''), '₿', ''), '%', '') AS c FROM t)
SELECT o_orderkey, CASE WHEN raw IN ('-', '', 'N/A', '?', '—') THEN 0.0 ELSE coalesce(try_cast(regexp_extract(c, '[\\d.-]+') AS DOUBLE) * CASE WHEN upper(c) LIKE '%B%' THEN 1e9 WHEN upper(c) LIKE '%M%' THEN 1e6 WHEN upper(c) LIKE '%K%' THEN 1e3 ELSE 1 END, 0.0) END AS number,
  coalesce(trunc(try_cast(trim(replace(replace(raw, '₿', ''), ',', '')) AS DOUBLE))::BIGINT, 0) AS btc FROM u""", r2="number")
def _(read):
    return texts(read, "number").select("o_orderkey", T.parse_number("number").alias("number"), T.parse_btc("number").alias("btc"))


@query("f5_signed_change", """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '-' || (o_custkey % 10) || '.5%' WHEN 1 THEN (o_custkey % 10) || '.5%' ELSE 'none' END AS t, CASE o_custkey % 4 WHEN 0 THEN 'percentage-red' WHEN 1 THEN 'up' WHEN 2 THEN 'gain green' ELSE '' END AS d FROM orders)
SELECT o_orderkey, CASE WHEN NOT regexp_matches(t, '\\d%') THEN '' WHEN d = 'percentage-red' AND t NOT LIKE '-%' THEN '-' || t WHEN d IN ('up', 'gain green') AND t LIKE '-%' THEN substr(t, 2) ELSE t END AS change FROM t""")
def _(read):
    df = read("orders").selectExpr("o_orderkey", "CASE o_orderkey % 3 WHEN 0 THEN '-' || (o_custkey % 10) || '.5%' WHEN 1 THEN (o_custkey % 10) || '.5%' ELSE 'none' END AS t",
                                   "CASE o_custkey % 4 WHEN 0 THEN 'percentage-red' WHEN 1 THEN 'up' WHEN 2 THEN 'gain green' ELSE '' END AS d")
    return df.select("o_orderkey", T.signed_change("t", "d").alias("change"))


@query("s12_split_name_ticker", f"""WITH t AS (SELECT o_orderkey, trim({_text('name')}) AS t FROM orders), w AS (SELECT *, string_split_regex(t, '\\s+') AS w FROM t)
SELECT o_orderkey, CASE WHEN regexp_matches(t, '^(.*?)\\s+(\\d{{1,3}})([A-Z0-9.\\-]+)$') THEN trim(regexp_extract(t, '^(.*?)\\s+(\\d{{1,3}})([A-Z0-9.\\-]+)$', 1)) WHEN len(w) >= 2 THEN array_to_string(w[:-2], ' ') ELSE t END AS name,
  CASE WHEN regexp_matches(t, '^(.*?)\\s+(\\d{{1,3}})([A-Z0-9.\\-]+)$') THEN regexp_extract(t, '^(.*?)\\s+(\\d{{1,3}})([A-Z0-9.\\-]+)$', 3) WHEN len(w) >= 2 AND regexp_matches(w[-1], '^(\\d{{1,2}})(\\d*[A-Z0-9.\\-]+)$') THEN regexp_extract(w[-1], '^(\\d{{1,2}})(\\d*[A-Z0-9.\\-]+)$', 2)
    WHEN len(w) >= 2 THEN w[-1] ELSE 'UNKNOWN' END AS ticker FROM w""")
def _(read):
    name, ticker = T.name_and_ticker("name")
    return texts(read, "name").select("o_orderkey", name.alias("name"), ticker.alias("ticker"))


# ---------------------------------------------------------------- names and documents


def _sql_normalize(x: str) -> str:
    out = f"upper({x})"
    for s in T.COMPANY_SUFFIXES:
        out = f"regexp_replace({out}, '{s}', '')"
    return out


@query("f1_normalize_company", f"""WITH s AS (SELECT l_orderkey, l_linenumber, count(*) AS copies, 'Ab ' || l_linestatus || CASE l_orderkey % 8 WHEN 0 THEN ' Holdings' WHEN 1 THEN ' Group Inc.' WHEN 2 THEN ' & Co.' WHEN 3 THEN ' S.A.' WHEN 4 THEN ', Corp' WHEN 5 THEN ' Co Ltd' WHEN 6 THEN ' N.V' ELSE '  plc' END AS name FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, name, trim(regexp_replace(regexp_replace({_sql_normalize('name')}, '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS normalized FROM s""")
def _(read):
    df = read("lineitem").selectExpr("l_orderkey", "l_linenumber", "'Ab ' || l_linestatus || CASE l_orderkey % 8 WHEN 0 THEN ' Holdings' WHEN 1 THEN ' Group Inc.' WHEN 2 THEN ' & Co.' WHEN 3 THEN ' S.A.' WHEN 4 THEN ', Corp' WHEN 5 THEN ' Co Ltd' WHEN 6 THEN ' N.V' ELSE '  plc' END AS name").distinct()
    return df.withColumn("normalized", T.normalize_company("name"))


@query("f6_clean_text", "SELECT doc_id, length(c) AS n_clean, md5(c) AS clean_md5 FROM (SELECT doc_id, trim(nfc_normalize(regexp_replace(" + "replace(" * len(T.MOJIBAKE) + "text" + "".join(
    f", '{a}', '{b}')" for a, b in T.MOJIBAKE) + ", '[\\x00-\\x1F\\x7F]', '', 'g'))) AS c FROM documents)")
def _(read):
    df = read("documents").select("doc_id", T.normalize_text("text").alias("c"))
    return df.select("doc_id", F.length("c").cast("long").alias("n_clean"), F.md5(F.encode("c", "UTF-8")).alias("clean_md5"))


@query("f7_clean_holder", """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(trim(text), '^\\d+\\s*', ''), 'Update ', ''), 'New ', ''), '[^\\x00-\\x7F]+', ' ', 'g'), '[^\\w\\s&.-]', '', 'g'), '\\s+', ' ', 'g'))) AS holder FROM documents""")
def _(read):
    return read("documents").select("doc_id", F.md5(F.encode(T.clean_holder("text"), "UTF-8")).alias("holder"))


@query("f8_strip_rank_noise", """SELECT o_orderkey, trim(regexp_replace(regexp_replace(n, '\\n\\d+$', ''), '^\\d+\\s*', '')) AS name FROM (SELECT o_orderkey, (o_custkey % 100) || ' ' || o_orderpriority || chr(10) || (o_custkey % 7) AS n FROM orders)""")
def _(read):
    df = read("orders").selectExpr("o_orderkey", "(o_custkey % 100) || ' ' || o_orderpriority || char(10) || (o_custkey % 7) AS n")
    return df.select("o_orderkey", T.strip_rank_noise("n").alias("name"))


@query("f10_truncate", "SELECT doc_id, left(text, 50) AS cut, CASE WHEN length(text) <= 20 THEN text ELSE left(text, 17) || '...' END AS short FROM documents")
def _(read):
    from ..functions.guards import truncate
    return read("documents").select("doc_id", truncate("text", 50).alias("cut"), truncate("text", 20, True).alias("short"))


@query("f11_uuid5", """WITH h AS (SELECT event_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(event_id || '-' || event_type || '-4h-' || user_id)) AS h FROM events)
SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""")
def _(read):
    return read("events").select("event_id", T.uuid5("event_id", "event_type", F.lit("4h"), "user_id").alias("uuid"))


@query("f12_to_utc", "SELECT event_id, try_strptime(t, '%Y-%m-%d %H:%M:%S') AS utc FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS t FROM events)")
def _(read):
    t = F.when(F.col("event_id") % 9 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return read("events").select("event_id", T.to_utc(t).cast("timestamp_ntz").alias("utc"))


@query("f14_split_items", """WITH i AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, '. '), lambda s: trim(s)), lambda s: s <> '')) AS item FROM documents), l AS (SELECT doc_id, item, string_split(item, chr(10)) AS l FROM i)
SELECT doc_id, count(*) AS n_items, count(DISTINCT trim(l[1])) AS n_headlines, sum(length(trim(coalesce(l[2], ''))))::BIGINT AS subtitle_chars, count(*) FILTER (regexp_matches(item, 'https?://[a-zA-Z0-9]')) AS n_urls FROM l GROUP BY 1""")
def _(read):
    items = read("documents").select("doc_id", F.explode(T.split_items("text", r"\. ")).alias("item"))
    f = T.article_fields("item")
    return items.select("doc_id", *[c.alias(k) for k, c in f.items()]).groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.countDistinct("headline").alias("n_headlines"),
        F.sum(F.length("subtitle")).cast("long").alias("subtitle_chars"), F.count("url_link").alias("n_urls"))


@query("f15_event_ts", """SELECT o_orderkey, (date_trunc('day', o_orderdate) + (o_custkey % 12) * INTERVAL '1 hour' + 30 * INTERVAL '1 minute')::TIMESTAMP AS event_ts FROM orders""")
def _(read):
    df = read("orders").selectExpr("o_orderkey", "date_format(o_orderdate, 'MMM d') AS md", "o_orderdate AS today",
                                   "CASE WHEN o_custkey % 12 = 0 THEN '12:30am' ELSE (o_custkey % 12) || ':30am' END AS clock")
    return df.select("o_orderkey", T.event_ts("md", "clock", "this", "today").cast("timestamp_ntz").alias("event_ts"))


@query("f16_params_json", "SELECT DISTINCT p_size, '{\"p_size\":' || p_size || ',\"p_brand\":\"' || p_brand || '\"}' AS params FROM part")
def _(read):
    return read("part").select("p_size", T.params_json("p_size", "p_brand").alias("params")).distinct()


# ---------------------------------------------------------------- pages


@query("s11_list_items", """SELECT page_id, (i - 1)::INT AS row_no, regexp_extract(it[i], 'href="([^"]*)"', 1) AS href, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(it[i], '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS item_text
FROM (SELECT page_id, it, unnest(range(1, len(it) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li>', 1) AS it FROM pages))""")
def _(read):
    return H.list_items(read("pages"))


@query("s11_html_rows", """WITH r AS (SELECT page_id, regexp_extract_all(html, '(?is)<ul\\b[^>]*>(.*?)</ul>', 1) AS rs FROM pages), x AS (SELECT page_id, (i - 1)::INT AS row_no, rs[i] AS r FROM (SELECT page_id, rs, unnest(range(1, len(rs) + 1)) AS i FROM r)),
c AS (SELECT *, regexp_extract_all(r, '(?is)(<li\\b[^>]*>.*?</li>)', 1) AS cs FROM x)
SELECT page_id, row_no, len(cs)::INT AS n_cells, array_to_string(list_transform(cs, lambda c: trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(c, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))), ' ') AS row_text FROM c WHERE len(cs) >= 4""")
def _(read):
    """The generic row parser on navigation lists, the tables these pages have."""
    rows = H.table_rows(read("pages"), row_tag="ul", cell_tag="li", skip_header=False)
    return rows.select("page_id", "row_no", F.size("cells").alias("n_cells"), "row_text")


def _cells(read):
    """Rows of an asset table in cells: one per order, with gaps in different columns."""
    return read("orders").selectExpr(
        "o_orderkey AS row_id", "CAST(o_orderkey % 100 AS INT) AS row_no", "CAST(o_orderkey % 5 + 1 AS INT) AS page",
        """array('', CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_custkey % 700 AS STRING) END, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Asset ' || o_orderpriority || ' (AS' || (o_custkey % 50) || ')' END,
           '', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '$' || (o_custkey % 900) || '.5 B' END, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '$' || (o_custkey % 5000) || '.25' END,
           CASE WHEN o_orderkey % 6 = 0 THEN 'flat' ELSE (o_custkey % 20) || '.5%' END) AS cells""",
        "array(NULL, CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_custkey % 600 AS STRING) END, NULL, NULL, NULL, CASE WHEN o_orderkey % 14 = 0 THEN '777.50' END, CASE WHEN o_orderkey % 12 = 0 THEN '-3.5' END) AS attrs")


@query("s13_recover_rank", """SELECT o_orderkey AS row_id, coalesce(CASE WHEN o_orderkey % 9 = 0 AND o_custkey % 600 BETWEEN 1 AND 500 THEN o_custkey % 600 END, CASE WHEN o_orderkey % 4 <> 0 AND o_custkey % 700 BETWEEN 1 AND 500 THEN o_custkey % 700 END,
  CASE WHEN (o_orderkey % 5 + 1 - 1) * 100 + o_orderkey % 100 + 1 BETWEEN 1 AND 500 THEN (o_orderkey % 5) * 100 + o_orderkey % 100 + 1 END)::INT AS rank FROM orders""")
def _(read):
    return _cells(read).select("row_id", C.recover_rank(F.col("cells"), F.col("attrs"), F.lit(""), F.col("page"), F.col("row_no")).alias("rank"))


@query("s24_recover_cap", """SELECT o_orderkey AS row_id, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN '$' || (o_custkey % 900) || '.5 B' END, CASE WHEN o_orderkey % 6 = 0 THEN 'flat' END, '') AS cap FROM orders""")
def _(read):
    return _cells(read).select("row_id", F.coalesce(C.recover_cap(F.col("cells")), F.lit("")).alias("cap"))


@query("s23_recover_price", """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 7 <> 0 THEN '$' || (o_custkey % 5000) || '.25' WHEN o_orderkey % 14 = 0 THEN '$777.50'
  WHEN o_orderkey % 3 <> 0 THEN '$' || (o_custkey % 900) || '.5' WHEN o_custkey % 700 > 500 THEN '$' || (o_custkey % 700) ELSE '$' || (o_custkey % 20) || '.5' END AS price FROM orders""")
def _(read):
    """Rows without a price cell or attribute fall to a currency amount, then to a number that is no rank."""
    return _cells(read).select("row_id", C.recover_price(F.col("cells"), F.col("attrs"), F.array_join("cells", " ")).alias("price"))


@query("s25_recover_change", """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 6 <> 0 THEN (o_custkey % 20) || '.5%' WHEN o_orderkey % 12 = 0 THEN '-3.5%' ELSE '' END AS change FROM orders""")
def _(read):
    change = C.recover_change(F.col("cells"), F.col("attrs"), F.array_join("cells", " "))
    return _cells(read).select("row_id", F.coalesce(change, F.lit("")).alias("change"))


@query("s26_recover_identity", """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 5 <> 0 THEN 'Asset ' || o_orderpriority ELSE 'flat' END AS name, CASE WHEN o_orderkey % 5 <> 0 THEN 'AS' || (o_custkey % 50) ELSE 'N/A' END AS symbol FROM orders WHERE o_orderkey % 6 = 0 OR o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, 'Asset_Rank_7', 'N/A' FROM orders WHERE o_orderkey % 6 <> 0 AND o_orderkey % 5 = 0""")
def _(read):
    name, symbol = C.recover_identity(F.col("cells"), F.array_join("cells", " "), F.lit(7))
    return _cells(read).select("row_id", name.alias("name"), symbol.alias("symbol"))


@query("s27_parse_holding", """SELECT o_orderkey AS row_id, 'Land ' || (o_custkey % 60) AS holder_name, CASE WHEN o_orderkey % 2 = 0 THEN '₿ 9,' || (o_custkey % 900 + 100) ELSE '' END AS bitcoin_amount,
  CASE WHEN o_orderkey % 2 = 0 THEN 9000 + o_custkey % 900 + 100 ELSE 0 END::BIGINT AS bitcoin_raw, CASE WHEN o_orderkey % 3 = 0 THEN '$1.5B' ELSE '' END AS usd_value, CASE WHEN o_orderkey % 3 = 0 THEN 1500000000 ELSE 0 END::BIGINT AS usd_raw
FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def _(read):
    df = read("orders").selectExpr("o_orderkey AS row_id", "array(CAST(o_custkey % 90 AS STRING), 'Land ' || (o_custkey % 60), CASE WHEN o_orderkey % 2 = 0 THEN '₿ 9,' || (o_custkey % 900 + 100) ELSE '' END, CASE WHEN o_orderkey % 3 = 0 THEN '$1.5B' ELSE '' END) AS cells")
    f = C.parse_holding(F.col("cells"), F.array_join("cells", " "))
    return df.select("row_id", *[c.alias(k) for k, c in f.items() if k != "rank"]).filter("keep").drop("keep")


@query("w38_forward_fill", """SELECT o_orderkey AS row_no, o_custkey % 3 AS page_id, coalesce(last_value(d IGNORE NULLS) OVER w, '') AS event_date, coalesce(last_value(t IGNORE NULLS) OVER w, '') AS event_time
FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN o_orderdate::DATE::VARCHAR END AS d, CASE WHEN o_orderpriority = '1-URGENT' THEN (o_custkey % 12) || 'am' END AS t FROM orders)
WINDOW w AS (PARTITION BY o_custkey % 3 ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(read):
    df = read("orders").selectExpr("o_orderkey AS row_no", "o_custkey % 3 AS page_id", "CASE WHEN o_orderstatus = 'P' THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS event_date",
                                   "CASE WHEN o_orderpriority = '1-URGENT' THEN (o_custkey % 12) || 'am' END AS event_time")
    return A.forward_fill(df, ["event_date", "event_time"]).na.fill("", ["event_date", "event_time"])


@query("p23_select_events", "SELECT event_id, event_type FROM events WHERE lower(event_type) IN ('click', 'view')")
def _(read):
    df = read("events").select("event_id", F.upper("event_type").alias("event_name"), F.lit("USD ").alias("currency"))
    return A.select_events(df, ("Click", "VIEW")).select("event_id", F.lower("event_name").alias("event_type"))


@query("p24_months_ahead", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-12-01' AND o_orderdate < TIMESTAMP '1998-02-01'")
def _(read):
    return A.months_ahead(read("orders"), "o_orderdate", F.lit("1997-12-15").cast("date")).select("o_orderkey", "o_orderdate")


@query("s3_klines", """SELECT event_type AS symbol, make_timestamp((epoch_us(ts) // 1000 * 1000)::BIGINT) AS ts, value AS open, value + 1 AS high, value - 1 AS low, value AS close, 1.0::DOUBLE AS volume FROM events""", r4="open high low close")
def _(read):
    """Klines written as text by Spark itself and parsed back."""
    ms = F.expr("CAST(floor(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts) / 1000) AS BIGINT)")
    cells = [ms, F.col("value"), F.col("value") + 1, F.col("value") - 1, F.col("value"), F.lit(1.0)] + [F.lit(0)] * 6
    raw = read("events").select(F.col("event_type").alias("symbol"), F.to_json(F.array(F.array(*[c.cast("string") for c in cells]))).alias("payload"))
    return D.klines_to_bars(raw).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("s6_conform_ohlcv", """SELECT o_orderdate AS ts, o_totalprice AS open, o_totalprice + 2 AS high, o_totalprice - 1 AS low, o_totalprice + 1 AS close, 3e6::DOUBLE AS volume FROM orders WHERE o_orderstatus <> 'P'""", r4="open high low close", r0="volume")
def _(read):
    df = read("orders").selectExpr("CAST(o_orderdate AS STRING) AS ` Date`", "CAST(o_totalprice AS STRING) AS Open", "CAST(o_totalprice + 2 AS STRING) AS HIGH",
                                   "CAST(o_totalprice - 1 AS STRING) AS `low `", "CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE CAST(o_totalprice + 1 AS STRING) END AS close")
    return D.conform_ohlcv(df)


@query("s7_timeframe_of_name", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '4h' WHEN 1 THEN '1d' WHEN 2 THEN '1M' ELSE 'w' END AS timeframe FROM orders""")
def _(read):
    df = read("orders").selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN 'a_4h.csv' WHEN 1 THEN 'noname.csv' WHEN 2 THEN 'x_y_1M.csv' ELSE 'b_w.csv' END AS f")
    return df.select("o_orderkey", D.timeframe_of("f").alias("timeframe"))
