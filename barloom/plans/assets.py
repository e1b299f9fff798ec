"""Asset feeds, listings, ranking, deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import guards as U
from ..functions import listing as L
from ..functions import text as T
from ..operators import assets as A
from .registry import query

# the same expressions serve Spark and the SQL checks
_FEED = """'{p}' || {k} || CASE {n} % 8 WHEN 1 THEN '.L' WHEN 2 THEN '.JK' WHEN 3 THEN '.HK' WHEN 4 THEN '.SA' WHEN 5 THEN '-P' WHEN 6 THEN '.T' WHEN 7 THEN '.DE' ELSE '' END AS ticker
'Firm ' || ({k} % 40) || CASE {k} % 6 WHEN 0 THEN ' Inc' WHEN 1 THEN ' Corp.' WHEN 2 THEN ' & Co' WHEN 3 THEN ' Ltd' WHEN 4 THEN ' REIT Trust' ELSE '' END AS name
CASE {n} % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'ID' WHEN 3 THEN 'BR' WHEN 4 THEN 'SA' ELSE '' END AS country
CASE {k} % 7 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'NASDAQ' WHEN 2 THEN 'LSE' WHEN 3 THEN 'OTC' WHEN 4 THEN '' WHEN 5 THEN 'HKSE' ELSE 'ASX' END AS primary_exchange
abs({b}) * CASE WHEN {n} % 8 = 2 THEN 1e12 WHEN {n} % 8 = 4 THEN 2e9 ELSE 1e8 END AS market_cap
abs({b}) / 10 AS current_price
abs({b}) / 11 AS previous_close
CAST({k} AS DOUBLE) * 1000 AS volume"""


def _exprs(p: str, k: str, n: str, b: str) -> list[str]:
    return _FEED.format(p=p, k=k, n=n, b=b).split("\n")


SUPPLIER = _exprs("S", "s_suppkey", "s_nationkey", "s_acctbal") + ["'stock' AS asset_type", "'feed' AS data_source"]
CUSTOMER = _exprs("C", "c_custkey", "c_nationkey", "c_acctbal") + [
    "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'crypto' ELSE 'stock' END AS asset_type",
    "CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'FMP' ELSE 'feed' END AS data_source"]
SQL_FEED = (f"feed AS (SELECT {', '.join(SUPPLIER)}, 'supplier' AS origin FROM supplier UNION ALL "
            f"SELECT {', '.join(CUSTOMER)}, NULL FROM customer)")


def feeds(read):
    """Two feeds with different columns."""
    return read("supplier").selectExpr(*SUPPLIER, "'supplier' AS origin"), read("customer").selectExpr(*CUSTOMER)


def feed(read):
    return A.union_feeds(*feeds(read))


def listed(read):
    """The feed under the column names of a screener."""
    return feed(read).select(F.col("ticker").alias("symbol"), "name", "country", F.col("primary_exchange").alias("exchange"),
                             "market_cap", F.col("current_price").alias("price"), "volume")


SQL_LIST = f"WITH {SQL_FEED}, li AS (SELECT ticker AS symbol, name, country, primary_exchange AS exchange, market_cap, current_price AS price, volume FROM feed)"


def _sql_currency() -> str:
    out = "CASE"
    for code, suffixes, countries in L.CURRENCY_RULES:
        tests = " OR ".join([f"ends_with(upper(ticker), '{s}')" for s in suffixes]
                            + [f"upper(country) IN ({', '.join(repr(c) for c in countries)})"])
        out += f" WHEN {tests} THEN '{code}'"
    return out + " ELSE 'USD' END"


def _sql_rates(rates: dict) -> str:
    return "(VALUES " + ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in sorted(rates.items())) + ")"


SQL_CONV = f"""WITH {SQL_FEED}, cu AS (SELECT *, {_sql_currency()} AS cur FROM feed),
cv AS (SELECT cu.* EXCLUDE (cur), CASE WHEN NOT (asset_type IN ('crypto', 'commodity') OR data_source = 'FMP') AND market_cap > 1e12 THEN coalesce(r, 1.0) ELSE 1.0 END AS f
  FROM cu LEFT JOIN {_sql_rates(L.EMERGENCY_RATES)} t(c, r) ON c = cur),
cc AS (SELECT * REPLACE (market_cap * f AS market_cap, current_price * f AS current_price, previous_close * f AS previous_close) FROM cv),
cl AS (SELECT * EXCLUDE (f) REPLACE (CASE WHEN asset_type = 'crypto' THEN market_cap ELSE least(market_cap, 4e12) END AS market_cap) FROM cc WHERE asset_type = 'crypto' OR market_cap <= 1e13)"""


@query("d1_union_feeds", f"WITH {SQL_FEED} SELECT ticker, name, country, coalesce(origin, '') AS origin, market_cap FROM feed", r2="market_cap")
def _(read):
    return feed(read).select("ticker", "name", "country", F.coalesce("origin", F.lit("")).alias("origin"), "market_cap")


@query("p1_detect_currency", f"WITH {SQL_FEED} SELECT ticker, country, {_sql_currency()} AS currency FROM feed")
def _(read):
    return feed(read).select("ticker", "country", L.detect_currency("ticker", "country").alias("currency"))


SQL_SFX = """CASE WHEN symbol LIKE '%.JO' THEN 'ZAR' WHEN symbol LIKE '%.HK' OR symbol LIKE '%.HKSE%' THEN 'HKD' WHEN symbol LIKE '%.SR' THEN 'SAR' WHEN symbol LIKE '%.KS' OR symbol LIKE '%.KQ' THEN 'KRW'
  WHEN symbol LIKE '%.T' THEN 'JPY' WHEN symbol LIKE '%.L' OR symbol LIKE '%.LSE' THEN 'GBP' WHEN symbol LIKE '%.TA' THEN 'ILS' ELSE coalesce(cc.cur, 'USD') END"""
SQL_CC = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in L.COUNTRY_CURRENCY.items()) + ") cc(co, cur)"


@query("p2_detect_currency_suffix_first", f"{SQL_LIST} SELECT symbol, country, {SQL_SFX} AS currency FROM li LEFT JOIN {SQL_CC} ON co = country")
def _(read):
    return listed(read).select("symbol", "country", L.detect_currency_suffix_first("symbol", "country").alias("currency"))


@query("p3_to_usd", f"""{SQL_LIST}, c AS (SELECT li.*, {SQL_SFX} AS currency FROM li LEFT JOIN {SQL_CC} ON co = country)
SELECT symbol, currency, market_cap * coalesce(r, 1.0) AS market_cap_usd FROM c LEFT JOIN {_sql_rates(L.FALLBACK_RATES)} t(k, r) ON k = currency""", r0="market_cap_usd")
def _(read):
    df = listed(read).withColumn("currency", L.detect_currency_suffix_first("symbol", "country"))
    return A.to_usd(df, L.rates_frame(df.sparkSession)).select("symbol", "currency", "market_cap_usd")


@query("p4_emergency_convert", f"{SQL_CONV} SELECT ticker, market_cap, current_price, previous_close FROM cc", r2="market_cap", r4="current_price previous_close")
def _(read):
    return A.emergency_convert(feed(read)).select("ticker", "market_cap", "current_price", "previous_close")


@query("p5_clamp_or_drop", f"{SQL_CONV} SELECT ticker, asset_type, market_cap FROM cl", r2="market_cap")
def _(read):
    return A.clamp_or_drop(A.emergency_convert(feed(read))).select("ticker", "asset_type", "market_cap")


SQL_SUB = "(symbol LIKE '%.L' OR symbol LIKE '%.JO' OR symbol LIKE '%.TA' OR exchange LIKE '%LSE%' OR exchange LIKE '%JNB%' OR exchange LIKE '%TLV%')"


@query("p6_adjust_subunits", f"{SQL_LIST} SELECT symbol, exchange, CASE WHEN {SQL_SUB} THEN market_cap / 100 ELSE market_cap END AS market_cap FROM li", r2="market_cap")
def _(read):
    return A.adjust_subunits(listed(read)).select("symbol", "exchange", "market_cap")


def quotes(read):
    """Quotes for part of the listing: one per part key, shares from the size."""
    part = read("part").selectExpr("'S' || p_partkey AS symbol", "p_retailprice AS price", "p_retailprice * 0.98 AS previous_close",
                                   "2.0D AS change_pct", "CAST(p_size AS DOUBLE) * 10 AS volume", "CAST(p_size % 5 AS DOUBLE) * 1e7 AS shares")
    return part


SQL_QUOTES = "q AS (SELECT 'S' || p_partkey AS symbol, p_retailprice AS price, p_retailprice * 0.98 AS previous_close, 2.0::DOUBLE AS change_pct, p_size::DOUBLE * 10 AS volume, (p_size % 5)::DOUBLE * 1e7 AS shares FROM part)"


@query("p7_effective_cap", f"""{SQL_LIST}, {SQL_QUOTES}, c AS (SELECT li.*, {SQL_SFX} AS currency FROM li LEFT JOIN {SQL_CC} ON co = country),
r AS (SELECT c.*, CASE WHEN currency = 'USD' THEN 1.0 ELSE coalesce(t.r, 1.0) END AS rate FROM c LEFT JOIN {_sql_rates(L.FALLBACK_RATES)} t(k, r) ON k = currency)
SELECT r.symbol, currency, CASE WHEN shares > 0 AND q.price > 0 THEN q.price * CASE WHEN {SQL_SUB.replace('symbol', 'r.symbol')} THEN 0.01 ELSE 1.0 END * rate * shares
    ELSE market_cap * CASE WHEN currency <> 'USD' AND {SQL_SUB.replace('symbol', 'r.symbol')} THEN 0.01 ELSE 1.0 END * rate END AS market_cap_usd,
  coalesce(q.price, r.price) AS current_price, CASE WHEN q.symbol IS NOT NULL THEN q.previous_close ELSE r.price * 0.99 END AS previous_close,
  CASE WHEN q.symbol IS NOT NULL THEN change_pct ELSE 1.0 END AS percentage_change, CASE WHEN q.symbol IS NOT NULL THEN q.volume ELSE r.volume END AS volume,
  CASE WHEN name LIKE '%REIT%' THEN 'reit' ELSE 'stock' END AS asset_type FROM r LEFT JOIN q ON q.symbol = r.symbol""", r2="market_cap_usd volume", r6="current_price previous_close")
def _(read):
    return A.effective_cap(listed(read), quotes(read)).select("symbol", "currency", "market_cap_usd", "current_price", "previous_close",
                                                              "percentage_change", "volume", "asset_type")


def _sql_any(col: str, words) -> str:
    return "(" + " OR ".join(f"{col} LIKE '%{w}%'" for w in words) + ")"


@query("p8_p9_funds", f"""{SQL_LIST} SELECT symbol, name, (length(symbol) >= 4 AND {_sql_any('upper(symbol)', L.FUND_SYMBOL_PARTS)}) OR upper(name) LIKE '% ETF%' OR upper(name) LIKE '%ETF %' OR {_sql_any('upper(name)', L.FUND_NAME_PARTS)} AS is_fund,
  list_has_any(list_transform(string_split_regex(upper(name), '\\s+'), lambda w: trim(w, '.,!?;:')), ['ETF', 'INDEX', 'FUND', 'SPDR', 'ISHARES', 'VANGUARD']) AS has_word FROM li""")
def _(read):
    return listed(read).select("symbol", "name", L.is_fund("symbol", "name").alias("is_fund"), L.contains_word("name").alias("has_word"))


@query("p8_p9_funds_text", f"""WITH d AS (SELECT doc_id, upper(text) AS u FROM documents) SELECT doc_id, u LIKE '% ETF%' OR u LIKE '%ETF %' OR {_sql_any('u', L.FUND_NAME_PARTS)} AS is_fund FROM d""")
def _(read):
    return read("documents").select("doc_id", L.is_fund(F.lit(""), "text").alias("is_fund"))


@query("p10_p12_symbol_form", f"""{SQL_LIST} SELECT symbol, regexp_matches(upper(symbol), '[-.][PWU]') OR (upper(symbol) LIKE '%PR%' AND length(symbol) > 4) AS is_preferred,
  length(symbol) BETWEEN 1 AND 5 AND NOT ({' OR '.join(f"(symbol LIKE '%{s}' AND length(symbol) > {len(s)})" for s in L.COUNTRY_SUFFIXES)}) AS is_domestic FROM li""")
def _(read):
    return listed(read).select("symbol", L.is_preferred("symbol").alias("is_preferred"), L.is_domestic("symbol").alias("is_domestic"))


@query("p11_p13_us_large_caps", f"""{SQL_LIST} SELECT symbol, name, exchange, market_cap, price FROM li WHERE market_cap >= 40e9 AND exchange IN ('NASDAQ', 'NYSE') AND price > 0 AND price <= 10000
  AND NOT ((length(symbol) >= 4 AND {_sql_any('upper(symbol)', L.FUND_SYMBOL_PARTS)}) OR upper(name) LIKE '% ETF%' OR upper(name) LIKE '%ETF %' OR {_sql_any('upper(name)', L.FUND_NAME_PARTS)})""", r2="market_cap", r4="price")
def _(read):
    return A.us_large_caps(listed(read)).select("symbol", "name", "exchange", "market_cap", "price")


@query("p14_drop_bad", f"{SQL_LIST} SELECT symbol, exchange, market_cap FROM li WHERE NOT (symbol IN ('NVL', 'AXTLF', 'ALIZY') OR market_cap > 5e12 OR exchange LIKE '%OTC%' OR exchange = '')", r2="market_cap")
def _(read):
    return A.drop_bad(listed(read)).select("symbol", "exchange", "market_cap")


SQL_COINS = "co AS (SELECT 'C' || p_partkey AS ticker, p_name AS name, p_retailprice AS current_price, (p_size - 25)::DOUBLE AS percentage_change, p_retailprice * p_size * 1e6 * CASE WHEN p_partkey % 9 = 0 THEN 1.2 ELSE 1.0 END AS market_cap, p_size * 1e6 * CASE WHEN p_partkey % 50 = 0 THEN 0 ELSE 1 END AS circulating_supply, p_size * 5.0::DOUBLE AS volume FROM part)"


def coins(read):
    return read("part").selectExpr(
        "'C' || p_partkey AS ticker", "p_name AS name", "p_retailprice AS current_price", "CAST(p_size - 25 AS DOUBLE) AS percentage_change",
        "p_retailprice * p_size * 1e6D * CASE WHEN p_partkey % 9 = 0 THEN 1.2D ELSE 1.0D END AS market_cap",
        "p_size * 1e6D * CASE WHEN p_partkey % 50 = 0 THEN 0 ELSE 1 END AS circulating_supply", "p_size * 5.0D AS volume")


@query("p15_p17_crypto", f"""WITH {SQL_COINS} SELECT ticker, CASE WHEN percentage_change <> 0 THEN current_price / (1 + percentage_change / 100) ELSE current_price END AS previous_close,
  abs(current_price * circulating_supply - market_cap) / market_cap > 0.1 AS cap_mismatch FROM co WHERE market_cap > 0 AND current_price > 0 AND circulating_supply > 0""", r6="previous_close")
def _(read):
    return A.complete_crypto(coins(read)).select("ticker", "previous_close", "cap_mismatch")


@query("p16_pct_change_from_close", f"WITH {SQL_FEED} SELECT ticker, CASE WHEN previous_close > 0 THEN (current_price - previous_close) / previous_close * 100 ELSE 0.0 END AS percentage_change FROM feed", r6="percentage_change")
def _(read):
    return A.change_from_close(feed(read)).select("ticker", "percentage_change")


@query("d1_conform_crypto", f"""WITH {SQL_COINS} SELECT ticker AS symbol, name, current_price, trunc(market_cap) AS market_cap, coalesce(nullif(trunc(circulating_supply)::BIGINT, 0), -1) AS circulating_supply, 'CoinGecko' AS primary_exchange, 'crypto' AS category FROM co""",
       r2="current_price")
def _(read):
    c = coins(read).withColumn("previous_close", F.col("current_price"))
    return A.conform_crypto(c).na.fill(-1, ["circulating_supply"]).select(
        "symbol", "name", "current_price", "market_cap", "circulating_supply", "primary_exchange", "category")


@query("p18_asset_type", f"{SQL_LIST} SELECT symbol, CASE WHEN name LIKE '%REIT%' THEN 'reit' ELSE 'stock' END AS asset_type FROM li")
def _(read):
    return listed(read).select("symbol", L.asset_type("name").alias("asset_type"))


@query("p20_to_store_row", f"WITH {SQL_FEED} SELECT left(ticker, 50) AS ticker, left(name, 200) AS name, CASE WHEN market_cap * 1e6 >= 9223372036854775807 THEN 9223372036854775807 ELSE trunc(market_cap * 1e6)::BIGINT END AS market_cap FROM feed")
def _(read):
    df = feed(read).withColumn("market_cap", F.col("market_cap") * 1e6)
    return A.to_store_row(df).select("ticker", "name", "market_cap")


@query("p21_fallback_category", "SELECT doc_id, CASE " + " ".join(
    f"WHEN {_sql_any('lower(text)', words)} THEN '{label}'" for label, words in L.CATEGORY_WORDS) + " ELSE 'Other' END AS category FROM documents")
def _(read):
    return read("documents").select("doc_id", L.fallback_category("text").alias("category"))


@query("p22_public_company", f"""WITH n AS (SELECT doc_id, text AS raw, trim(lower(text)) AS n FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS text FROM documents))
SELECT doc_id, count(*) AS n_names, count(*) FILTER (raw <> '' AND NOT ({_sql_any('n', L.TOTAL_WORDS)} OR n IN ({', '.join(repr(c) for c in L.COUNTRY_NAMES)}) OR {' OR '.join(f"starts_with(n, 'auto {c}')" for c in L.COUNTRY_NAMES)}
  OR {_sql_any('n', L.GOVERNMENT_WORDS)} OR {_sql_any('n', L.NON_PROFIT_WORDS)} OR {_sql_any('n', L.PRIVATE_NAMES)})
  AND ({_sql_any('n', L.CORPORATE_WORDS)} OR regexp_matches(raw, '(^|[^\\p{{L}}\\p{{N}}_])[A-Z]{{2,5}}($|[^\\p{{L}}\\p{{N}}_])') OR {_sql_any('n', L.KNOWN_PUBLIC)})) AS n_public FROM n GROUP BY 1""")
def _(read):
    names = read("documents").select("doc_id", F.explode(F.split("text", r"\. ")).alias("name"))
    return names.groupBy("doc_id").agg(F.count("*").alias("n_names"), F.count_if(L.is_public_company("name")).alias("n_public"))


# ---------------------------------------------------------------- ranking and dedupe

RANKED = "row_number() OVER (ORDER BY market_cap DESC, ticker)"


@query("t1_top_assets", f"{SQL_CONV} SELECT ticker, market_cap FROM cl ORDER BY market_cap DESC, ticker LIMIT 500", r2="market_cap")
def _(read):
    return A.top_assets(A.clamp_or_drop(A.emergency_convert(feed(read)))).select("ticker", "market_cap")


@query("w35_rank_assets", f"{SQL_CONV} SELECT ticker, market_cap, rank FROM (SELECT *, {RANKED}::INT AS rank FROM cl) WHERE rank <= 100", r2="market_cap")
def _(read):
    return A.rank_assets(A.clamp_or_drop(A.emergency_convert(feed(read))), 100).select("ticker", "market_cap", "rank")


@query("t8_present_in_top", f"{SQL_CONV}, tp AS (SELECT ticker FROM cl ORDER BY market_cap DESC, ticker LIMIT 50) SELECT w.t AS ticker, w.t IN (SELECT ticker FROM tp) AS present FROM (VALUES ('S1'), ('C8'), ('C100.JK'), ('C5.JK')) w(t)")
def _(read):
    return A.present_in_top(A.clamp_or_drop(A.emergency_convert(feed(read))), ("S1", "C8", "C100.JK", "C5.JK"))


SQL_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(upper(name), '\\s+(CORP\\.?|INC\\.?|LTD\\.?|& CO\\.?)$', ''), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
SQL_SCORE = """CASE WHEN regexp_matches(upper(ticker), '[-.][PWU]') OR (upper(ticker) LIKE '%PR%' AND length(ticker) > 4) THEN 0.0 ELSE 10000.0 END + market_cap / 1e9 + volume / 1e6
  + CASE WHEN primary_exchange IN ('NYSE', 'NASDAQ', 'LSE', 'HKSE') THEN 100.0 ELSE 0.0 END + CASE WHEN country IN ('US', 'USA') THEN 50.0 ELSE 0.0 END"""
# the suffix '& Co' loses ' Co' first and keeps the '&', which becomes a space
SQL_DEDUPE = f"""{SQL_CONV}, ky AS (SELECT *, replace({SQL_KEY.replace("& CO\\.?", "CO\\.?")}, '&', ' ') AS k, {SQL_SCORE} AS score FROM cl),
dd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, ticker) AS rn FROM ky) WHERE rn = 1)"""


@query("d7_dedupe_companies", f"{SQL_DEDUPE} SELECT ticker, name, market_cap FROM dd", r2="market_cap")
def _(read):
    return A.dedupe_companies(A.clamp_or_drop(A.emergency_convert(feed(read)))).select("ticker", "name", "market_cap")


@query("asset_master", f"""{SQL_DEDUPE} SELECT ticker, name, asset_type, market_cap, rank, category, price_raw FROM (SELECT *, {RANKED}::INT AS rank, 'Global' AS category, current_price AS price_raw FROM dd) WHERE rank <= 500""",
       r2="market_cap", r4="price_raw")
def _(read):
    """The daily ranking end to end: union, convert, clamp, dedupe, rank, defaults."""
    return A.combine(feeds(read)).select("ticker", "name", "asset_type", "market_cap", "rank", "category", "price_raw")


@query("d8_dedupe_listings", f"""{SQL_LIST} SELECT symbol, name, exchange, market_cap FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN symbol LIKE '%.HK' OR exchange = 'HKSE' THEN 1
  WHEN exchange IN ('NYSE', 'NASDAQ', 'LSE') THEN 2 WHEN exchange IN ('ASX', 'BSE', 'NSE') THEN 3 ELSE 4 END, market_cap DESC, symbol) AS rn FROM li) WHERE rn = 1""", r2="market_cap")
def _(read):
    return A.dedupe_listings(listed(read)).select("symbol", "name", "exchange", "market_cap")


@query("d9_dedupe_rank", """SELECT row_id, coalesce(rank, -1) AS rank, name FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(rank::VARCHAR, name) ORDER BY row_id) AS rn FROM
  (SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 500)::INT END AS rank, 'Name ' || (o_custkey % 100) AS name FROM orders)) WHERE rn = 1""")
def _(read):
    df = read("orders").selectExpr("o_orderkey AS row_id", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 500 AS INT) END AS rank",
                                   "'Name ' || (o_custkey % 100) AS name")
    return A.dedupe_rank(df).na.fill(-1, ["rank"])


@query("d10_w36_keep_latest", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1", r2="o_totalprice")
def _(read):
    return A.keep_latest(read("orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("d11_distinct_first", "SELECT l_orderkey, l_partkey, min(l_linenumber) AS row_no FROM lineitem GROUP BY 1, 2")
def _(read):
    df = read("lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("row_no"))
    return A.distinct_first(df, ["l_orderkey", "l_partkey"])


@query("w39_unique_symbols", """WITH o AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 3 = 0 THEN 'BTC' WHEN o_orderkey % 97 = 1 THEN 'BTC' || (o_orderkey % 50) ELSE 'A' || (o_custkey % 300) || 'X' END AS symbol FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY row_id) - 1 AS k FROM o),
fr AS (SELECT s.symbol, c.i, row_number() OVER (PARTITION BY s.symbol ORDER BY c.i) AS pos FROM (SELECT symbol, max(k) AS mk FROM n GROUP BY 1 HAVING max(k) > 0) s, range(2, (SELECT max(k) + 400 FROM n)) c(i)
  WHERE c.i <= s.mk + 400 AND NOT EXISTS (SELECT 1 FROM o WHERE o.symbol = s.symbol || c.i))
SELECT n.row_id, n.symbol, CASE WHEN k = 0 THEN n.symbol ELSE n.symbol || fr.i END AS unique_symbol FROM n LEFT JOIN fr ON fr.symbol = n.symbol AND fr.pos = n.k""")
def _(read):
    df = read("orders").selectExpr("o_orderkey AS row_id", """CASE WHEN o_orderkey % 3 = 0 THEN 'BTC' WHEN o_orderkey % 97 = 1 THEN 'BTC' || (o_orderkey % 50)
        ELSE 'A' || (o_custkey % 300) || 'X' END AS symbol""")
    return A.unique_symbols(df).select("row_id", "symbol", "unique_symbol")


@query("a1_breakdown", f"WITH {SQL_FEED} SELECT country, count(*) AS n FROM feed GROUP BY 1")
def _(read):
    return A.breakdown(feed(read), "country")


SQL_SNAP = f"{SQL_CONV}, sn AS (SELECT *, DATE '2024-01-15' + (volume / 1000 % 3)::INT AS snapshot_date FROM cl)"


def snapshot(read):
    df = A.clamp_or_drop(A.emergency_convert(feed(read)))
    return df.withColumn("snapshot_date", F.date_add(F.lit("2024-01-15").cast("date"), (F.col("volume") / 1000 % 3).cast("int")))


@query("a2_type_stats", f"{SQL_SNAP} SELECT asset_type, count(*) AS n_assets, avg(market_cap) AS avg_cap, max(market_cap) AS max_cap FROM sn WHERE snapshot_date = DATE '2024-01-16' GROUP BY 1", r0="avg_cap max_cap")
def _(read):
    return A.type_stats(snapshot(read), "2024-01-16")


@query("a3_holder_shares", "SELECT c_custkey, holdings, holdings / total * 100 AS share_pct, total, floor(total / n)::BIGINT AS avg_holding FROM (SELECT c_custkey, trunc(abs(c_acctbal))::BIGINT AS holdings FROM customer), (SELECT sum(trunc(abs(c_acctbal)))::BIGINT AS total, count(*) AS n FROM customer)",
       r6="share_pct")
def _(read):
    df = read("customer").select("c_custkey", F.abs("c_acctbal").cast("long").alias("holdings"))
    return A.holder_shares(df, "holdings")


@query("a4_p28_dominance", f"""{SQL_SNAP} SELECT snapshot_date::TIMESTAMP AS snapshot_date, sum(CASE WHEN asset_type = 'crypto' THEN market_cap ELSE 0.0 END) AS part_cap, sum(market_cap) AS total_cap,
  round(sum(CASE WHEN asset_type = 'crypto' THEN market_cap ELSE 0.0 END) / sum(market_cap) * 100, 2) AS share, round(100 - sum(CASE WHEN asset_type = 'crypto' THEN market_cap ELSE 0.0 END) / sum(market_cap) * 100, 2) AS other_share,
  CASE WHEN 100 - sum(CASE WHEN asset_type = 'crypto' THEN market_cap ELSE 0.0 END) / sum(market_cap) * 100 > 75 THEN 'Altcoin Season' WHEN 100 - sum(CASE WHEN asset_type = 'crypto' THEN market_cap ELSE 0.0 END) / sum(market_cap) * 100 < 25 THEN 'Bitcoin Season' ELSE 'Neutral' END AS season FROM sn GROUP BY 1""",
       r0="part_cap total_cap")
def _(read):
    return A.dominance(snapshot(read), "crypto", "asset_type", by=("snapshot_date",))


@query("a34_treasury_ratios", """WITH h AS (SELECT c_custkey, abs(c_acctbal) * 10 AS holdings, (c_custkey % 97) * 1e8 AS market_cap FROM customer), r AS (SELECT *, CASE WHEN market_cap > 0 THEN holdings * 107000.0 / market_cap END AS ratio, holdings / 21000000 * 100 AS sp FROM h)
SELECT c_custkey, coalesce(CASE WHEN ratio BETWEEN 0.001 AND 20.0 THEN round(ratio, 3) END, 0.0) AS mnav, coalesce(CASE WHEN ratio * 100 BETWEEN 0.1 AND 5000.0 THEN round(ratio * 100, 2) END, 0.0) AS mnav_pct,
  coalesce(CASE WHEN sp BETWEEN 0.001 AND 5.0 THEN round(sp, 4) END, 0.0) AS supply_share FROM r""", r2="mnav_pct", r3="mnav", r4="supply_share")
def _(read):
    df = read("customer").selectExpr("c_custkey", "abs(c_acctbal) * 10 AS holdings", "(c_custkey % 97) * 1e8D AS market_cap")
    return A.treasury_ratios(df, 107_000.0).drop("holdings", "market_cap")


@query("j7_enrich", f"""WITH {SQL_QUOTES}, pf AS (SELECT 'S' || s_suppkey AS symbol, 'US' AS country, r_name AS sector, CASE WHEN s_nationkey % 4 = 0 THEN '' ELSE 'EUR' END AS currency FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT q.symbol, q.price, coalesce(country, '') AS country, coalesce(sector, '') AS sector, coalesce(nullif(currency, ''), 'USD') AS currency FROM q LEFT JOIN pf USING (symbol)""", r2="price")
def _(read):
    return A.enrich(quotes(read), profiles(read)).na.fill("", ["country", "sector"]).select("symbol", "price", "country", "sector", "currency")


def profiles(read):
    n, r = read("nation"), read("region")
    return (read("supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
            .selectExpr("'S' || s_suppkey AS symbol", "'US' AS country", "r_name AS sector", "'' AS industry",
                        "CASE WHEN s_nationkey % 4 = 0 THEN '' ELSE 'EUR' END AS currency"))


@query("j8_filter_by_country", f"""{SQL_LIST}, pf AS (SELECT ticker AS symbol, country FROM feed WHERE volume / 1000 % 2 = 0) SELECT li.symbol FROM li LEFT JOIN pf USING (symbol)
WHERE CASE WHEN pf.country IS NOT NULL THEN pf.country IN ('US', 'GB') ELSE length(li.symbol) BETWEEN 1 AND 5 AND NOT ({' OR '.join(f"(li.symbol LIKE '%{s}' AND length(li.symbol) > {len(s)})" for s in L.COUNTRY_SUFFIXES)}) END""")
def _(read):
    p = feed(read).filter(F.col("volume") / 1000 % 2 == 0).select(F.col("ticker").alias("symbol"), "country")
    return A.filter_by_country(listed(read).select("symbol"), p, ("US", "GB"))


SQL_CLS = "cls AS (SELECT p_partkey AS cls_id, CASE WHEN p_partkey % 2 = 0 THEN 'FIRM ' || (p_partkey % 55) || ' INC' ELSE 'x' || p_partkey END AS name, 's' || (p_partkey % 60) AS ticker, p_brand AS category FROM part)"


def classes(read):
    return read("part").selectExpr("p_partkey AS cls_id", "CASE WHEN p_partkey % 2 = 0 THEN 'FIRM ' || (p_partkey % 55) || ' INC' ELSE 'x' || p_partkey END AS name",
                                   "'s' || (p_partkey % 60) AS ticker", "p_brand AS category")


@query("j9_apply_classification", f"""WITH {SQL_FEED}, {SQL_CLS}, m AS (SELECT f.ticker, arg_min(c.category, c.cls_id) AS category FROM feed f JOIN cls c ON lower(c.name) = lower(f.name) OR lower(c.ticker) = lower(f.ticker) GROUP BY 1)
SELECT f.ticker, f.name, coalesce(m.category, '') AS category FROM feed f LEFT JOIN m USING (ticker)""")
def _(read):
    return A.apply_classification(feed(read).select("ticker", "name"), classes(read)).na.fill("", ["category"])


@query("j10_classification_fuzzy", """WITH d AS (SELECT p_partkey AS row_id, p_name AS name FROM part), k AS (SELECT p_partkey AS cls_id, split_part(p_name, ' ', 1 + p_partkey % 2) || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' ' || split_part(p_name, ' ', 2) END AS name, p_brand AS category FROM part),
first AS (SELECT min(cls_id) AS cls_id, lower(name) AS name FROM k GROUP BY 2),
m AS (SELECT row_id, min(first.cls_id) AS cls_id FROM d JOIN first ON contains(lower(d.name), first.name) OR contains(first.name, lower(d.name)) GROUP BY 1)
SELECT row_id, d.name, coalesce(k.category, CASE WHEN contains(d.name, 'gold') OR contains(d.name, 'silver') OR contains(d.name, 'copper') THEN 'Precious Metals' ELSE 'Other' END) AS category FROM d LEFT JOIN m USING (row_id) LEFT JOIN k USING (cls_id)""")
def _(read):
    part = read("part")
    cls = part.selectExpr("p_partkey AS cls_id", "split_part(p_name, ' ', CAST(1 + p_partkey % 2 AS INT)) || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' ' || split_part(p_name, ' ', 2) END AS name",
                          "p_brand AS category")
    return A.apply_classification_fuzzy(part.selectExpr("p_partkey AS row_id", "p_name AS name"), cls).select("row_id", "name", "category")


@query("j15_d6_missing_ranks", "SELECT i::INT AS rank, ceil(i / 100)::INT AS page FROM range(1, 501) t(i) WHERE i NOT IN (SELECT s_suppkey * 3 FROM supplier)")
def _(read):
    return A.missing_ranks(read("supplier").selectExpr("s_suppkey * 3 AS rank"))


@query("p32_any_present", "SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS b FROM orders) WHERE coalesce(a, b) IS NOT NULL")
def _(read):
    df = read("orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS a", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS b")
    return A.any_present(df, ["a", "b"]).select("o_orderkey")


@query("p19_fill_defaults", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 1.5 END AS price_raw, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE 'Global' END AS category, 'FMP' AS data_source FROM orders", r2="price_raw")
def _(read):
    df = read("orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price_raw", "1.5D AS current_price", "CAST(NULL AS DOUBLE) AS market_cap_raw",
                                   "2.0D AS market_cap", "CASE WHEN o_orderkey % 5 = 0 THEN 'x' END AS category", "CAST(NULL AS STRING) AS data_source")
    return A.fill_defaults(df).select("o_orderkey", "price_raw", "category", "data_source")


@query("p25_safe_numeric", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE value END AS safe_value, greatest(0.0, least(CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE value * 1e6 END, 99999999.0)) AS store_volume FROM events""", r4="safe_value store_volume")
def _(read):
    bad = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return read("events").select("event_id", U.safe_numeric(bad).alias("safe_value"), U.store_volume(bad * 1e6).alias("store_volume"))


@query("f9_format_large", """SELECT o_orderkey, CASE WHEN v >= 1e12 THEN printf('%.2fT', v / 1e12) WHEN v >= 1e9 THEN printf('%.2fB', v / 1e9) WHEN v >= 1e6 THEN printf('%.2fM', v / 1e6) WHEN v >= 1e3 THEN printf('%.2fK', v / 1e3) ELSE printf('%.2f', v) END AS large
FROM (SELECT o_orderkey, floor(o_totalprice) * CASE o_orderkey % 4 WHEN 0 THEN 0.001 WHEN 1 THEN 1.0 WHEN 2 THEN 10007.0 ELSE 10000019.0 END + 0.0013 AS v FROM orders)""")
def _(read):
    v = F.expr("floor(o_totalprice) * CASE o_orderkey % 4 WHEN 0 THEN 0.001D WHEN 1 THEN 1.0D WHEN 2 THEN 10007.0D ELSE 10000019.0D END + 0.0013D")
    return read("orders").select("o_orderkey", U.format_large(v).alias("large"))


@query("f13_safe_casts", "SELECT event_id, coalesce(try_cast(p AS DOUBLE), -1.0) AS f, coalesce(trunc(try_cast(p AS DOUBLE))::BIGINT, -2) AS i FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE value::VARCHAR END AS p FROM events)", r4="f")
def _(read):
    p = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return read("events").select("event_id", U.safe_float(p, -1.0).alias("f"), U.safe_int(p, -2).alias("i"))
