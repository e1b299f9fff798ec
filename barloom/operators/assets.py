"""Asset master: feeds to a ranked daily snapshot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import listing as L
from ..functions.guards import bigint_or_null, pct_change_from_close, prev_close
from ..functions.text import normalize_company
from ..session import cut_lineage
from .series import BLOCK_BARS, number_bars, running

CAP_LIMIT, CAP_DROP, SUSPICIOUS = 4e12, 10e12, 1e12
MIN_CAP_US, MIN_CAP_WORLD = 40e9, 50e6


# ---------------------------------------------------------------- feeds


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """Union by name; fields a feed lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def conform_crypto(crypto: DataFrame) -> DataFrame:
    """Crypto rows in the columns of the stock feed."""
    return crypto.select(
        F.col("ticker").alias("symbol"), "ticker", "name",
        "current_price", "previous_close", "percentage_change",
        F.col("market_cap").cast("long").cast("double").alias("market_cap"),
        F.col("volume").cast("long").cast("double").alias("volume"),
        F.nullif(F.col("circulating_supply").cast("long"), F.lit(0)).alias("circulating_supply"),
        F.lit("CoinGecko").alias("primary_exchange"), F.lit("Global").alias("country"),
        F.lit("Cryptocurrency").alias("sector"), F.lit("Digital Currency").alias("industry"),
        F.lit("crypto").alias("asset_type"), F.lit("CoinGecko").alias("data_source"),
        F.lit("crypto").alias("category"))


def complete_crypto(coins: DataFrame) -> DataFrame:
    """Coins with positive cap, price and supply, their previous close and a cap check."""
    c = coins.filter((F.col("market_cap") > 0) & (F.col("current_price") > 0) & (F.col("circulating_supply") > 0))
    gap = F.abs(F.col("current_price") * F.col("circulating_supply") - F.col("market_cap"))
    return c.withColumns({"previous_close": prev_close("current_price", "percentage_change"),
                          "cap_mismatch": F.try_divide(gap, F.col("market_cap")) > 0.1})


def to_usd(df: DataFrame, rates: DataFrame, amount: str = "market_cap", currency: str = "currency") -> DataFrame:
    """Amount times the rate of its currency; an unknown currency leaves it unchanged.

    Spark broadcasts the rates while they are under its size threshold.
    """
    r = rates.select(F.col("currency").alias(currency), F.col("usd_rate").alias("_rate"))
    return (df.join(r, currency, "left")
            .withColumn(f"{amount}_usd", F.col(amount) * F.coalesce("_rate", F.lit(1.0))).drop("_rate"))


def to_usd_quote(ticks: DataFrame, rate: DataFrame) -> DataFrame:
    """Prices quoted in a stable coin times its dollar rate (1.0 when there is none)."""
    # an aggregate without keys is one row
    one = rate.agg(F.coalesce(F.max("usd_rate"), F.lit(1.0)).alias("_rate"))
    pair = F.when(F.col("symbol").contains("/"), F.col("symbol")).otherwise(F.concat("symbol", F.lit("/USDT")))
    return (ticks.crossJoin(F.broadcast(one)).withColumns({"pair": pair, "price_usd": F.col("price") * F.col("_rate")})
            .drop("_rate"))


def emergency_convert(df: DataFrame) -> DataFrame:
    """Convert suspiciously large non-dollar caps (and their prices) by the fixed rates."""
    rate = L.rate_column(L.detect_currency("ticker", "country"))
    exempt = (F.col("asset_type").isin("crypto", "commodity")
              | (F.coalesce(F.col("data_source"), F.lit("")) == "FMP"))
    factor = F.when(~exempt & (F.col("market_cap") > SUSPICIOUS), F.coalesce(rate, F.lit(1.0))).otherwise(1.0)
    return (df.withColumn("_f", factor)
            .withColumns({c: F.col(c) * F.col("_f") for c in ("market_cap", "current_price", "previous_close")})
            .drop("_f"))


def clamp_or_drop(df: DataFrame) -> DataFrame:
    """Caps above 10e12 leave, caps above 4e12 become 4e12; crypto and commodities pass."""
    exempt = F.coalesce(F.col("asset_type").isin("crypto", "commodity"), F.lit(False))
    return (df.filter(exempt | F.col("market_cap").isNull() | (F.col("market_cap") <= CAP_DROP))
            .withColumn("market_cap", F.when(exempt, F.col("market_cap"))
                        .otherwise(F.least("market_cap", F.lit(CAP_LIMIT)))))


def adjust_subunits(df: DataFrame, column: str = "market_cap") -> DataFrame:
    return df.withColumn(column, F.when(L.is_subunit("symbol", "exchange"), F.col(column) / 100)
                         .otherwise(F.col(column)))


def effective_cap(screener: DataFrame, quotes: DataFrame) -> DataFrame:
    """Screener rows with the cap recomputed from quotes where shares and price are known.

    Without a quote the previous close is 0.99 of the price, the change 1 percent.
    """
    q = quotes.select("symbol", F.col("price").alias("q_price"), F.col("previous_close").alias("q_close"),
                      F.col("change_pct").alias("q_change"), F.col("volume").alias("q_volume"),
                      F.col("shares").alias("q_shares"), F.lit(True).alias("_quoted"))
    df = screener.join(q, "symbol", "left")
    code = L.detect_currency_suffix_first("symbol", "country")
    rate = F.when(code == "USD", F.lit(1.0)).otherwise(F.coalesce(L.rate_column(code, L.FALLBACK_RATES), F.lit(1.0)))
    unit = F.when((code != "USD") & L.is_subunit("symbol", "exchange"), 0.01).otherwise(1.0)
    # a recomputed cap is scaled by the unit for every currency
    q_unit = F.when(L.is_subunit("symbol", "exchange"), 0.01).otherwise(1.0)
    known = (F.col("q_shares") > 0) & (F.col("q_price") > 0)
    return df.withColumns({
        "currency": code,
        "market_cap_usd": F.when(known, F.col("q_price") * q_unit * rate * F.col("q_shares"))
        .otherwise(F.col("market_cap") * unit * rate),
        "current_price": F.coalesce("q_price", "price"),
        "previous_close": F.when(F.col("_quoted"), F.col("q_close")).otherwise(F.col("price") * 0.99),
        "percentage_change": F.when(F.col("_quoted"), F.col("q_change")).otherwise(1.0),
        "volume": F.when(F.col("_quoted"), F.col("q_volume")).otherwise(F.col("volume")),
        "asset_type": L.asset_type("name")}).drop("q_price", "q_close", "q_change", "q_volume", "q_shares", "_quoted")


def drop_bad(df: DataFrame) -> DataFrame:
    return df.filter(~L.is_bad_listing("symbol", "name", "exchange", "market_cap"))


def us_large_caps(quotes: DataFrame) -> DataFrame:
    """Large US-listed non-fund quotes with a sane price; all tests reach the scan side."""
    return quotes.filter((F.col("market_cap") >= MIN_CAP_US) & F.col("exchange").isin("NASDAQ", "NYSE")
                         & ~L.is_fund("symbol", "name") & (F.col("price") > 0) & (F.col("price") <= 10_000))


def enrich(quotes: DataFrame, profiles: DataFrame) -> DataFrame:
    """Quotes with their profile; a quote without one is kept, currency then is USD."""
    p = profiles.select("symbol", "country", "sector", "industry", F.col("currency").alias("_cur"))
    return (quotes.join(p, "symbol", "left")
            .withColumn("currency", F.coalesce(F.nullif(F.col("_cur"), F.lit("")), F.lit("USD"))).drop("_cur"))


def filter_by_country(symbols: DataFrame, profiles: DataFrame, countries: Sequence[str]) -> DataFrame:
    """Symbols whose profile is in the countries; without a profile the symbol's form decides."""
    p = profiles.select("symbol", F.col("country").alias("_country"))
    guess = L.is_domestic("symbol") & F.lit("US" in countries)
    return (symbols.join(p, "symbol", "left")
            .filter(F.coalesce(F.col("_country").isin(*countries), guess)).drop("_country"))


def fill_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "price_raw": F.coalesce("price_raw", "current_price", F.lit(0.0)),
        "market_cap_raw": F.coalesce("market_cap_raw", "market_cap", F.lit(0.0)),
        "category": F.coalesce("category", F.lit("Global")), "data_source": F.coalesce("data_source", F.lit("FMP"))})


def to_store_row(df: DataFrame) -> DataFrame:
    """Store columns: texts cut to their width, numbers clamped or NULL."""
    widths = {"symbol": 50, "ticker": 50, "name": 200, "primary_exchange": 100, "country": 100}
    out = {c: F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, n)
           for c, n in widths.items() if c in df.columns}
    for c in ("market_cap", "volume", "circulating_supply"):
        if c in df.columns:
            out[c] = bigint_or_null(c)
    return df.withColumns(out)


# ---------------------------------------------------------------- ranking


def top_assets(df: DataFrame, n: int = 500) -> DataFrame:
    """The n largest caps (TakeOrderedAndProject: each task keeps n rows)."""
    return df.orderBy(F.col("market_cap").desc_nulls_last(), "ticker").limit(n)


def rank_assets(df: DataFrame, n: int = 500) -> DataFrame:
    """Ranks 1..n by cap, ties by ticker.  Only the n kept rows meet in one window."""
    order = Window.orderBy(F.col("market_cap").desc_nulls_last(), "ticker")
    return top_assets(df, n).withColumn("rank", F.row_number().over(order))


def combine(feeds: Sequence[DataFrame], n: int = 500, snapshot_date: Column | None = None) -> DataFrame:
    """Feeds to the ranked snapshot: union, convert, clamp, dedupe, rank, defaults."""
    df = dedupe_companies(clamp_or_drop(emergency_convert(union_feeds(*feeds))))
    for c, kind in (("price_raw", "double"), ("market_cap_raw", "double"), ("category", "string")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    ranked = fill_defaults(rank_assets(df, n))
    return ranked if snapshot_date is None else ranked.withColumn("snapshot_date", snapshot_date)


def breakdown(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def type_stats(snapshot: DataFrame, day=None) -> DataFrame:
    if day is not None:
        snapshot = snapshot.filter(F.col("snapshot_date") == F.lit(day).cast("date"))
    return snapshot.groupBy("asset_type").agg(
        F.count("*").alias("n_assets"), F.avg("market_cap").alias("avg_cap"), F.max("market_cap").alias("max_cap"))


def present_in_top(df: DataFrame, names: Sequence[str], n: int = 50) -> DataFrame:
    """Which of the listed tickers are among the top n."""
    top = top_assets(df, n).select("ticker")
    wanted = df.sparkSession.createDataFrame([(x,) for x in names], "ticker string")
    return (wanted.join(top.withColumn("present", F.lit(True)), "ticker", "left")
            .withColumn("present", F.coalesce("present", F.lit(False))))


def holder_shares(df: DataFrame, amount: str) -> DataFrame:
    """Share of each holder in percent, with total and whole-number average.

    Totals are a one-row aggregate joined back, not a window over everything.
    """
    total = df.agg(F.sum(amount).alias("total"), F.count("*").alias("_n"))
    return (df.crossJoin(F.broadcast(total))
            .withColumns({"share_pct": F.coalesce(F.try_divide(F.col(amount), F.col("total")) * 100, F.lit(0.0)),
                          "avg_holding": F.floor(F.try_divide(F.col("total"), F.col("_n")))}).drop("_n"))


def dominance(df: DataFrame, name: str, column: str = "ticker", cap: str = "market_cap",
              by: Sequence[str] = ()) -> DataFrame:
    """Share of one asset, the share of all others and the season it implies."""
    from ..functions.guards import season
    part = F.sum(F.when(F.col(column) == name, F.col(cap)).otherwise(0.0))
    agg = (df.groupBy(*by) if by else df.groupBy()).agg(part.alias("part_cap"), F.sum(cap).alias("total_cap"))
    share = F.try_divide("part_cap", "total_cap") * 100
    return agg.withColumns({"share": F.round(share, 2), "other_share": F.round(100 - share, 2),
                            "season": season(100 - share)})


def treasury_ratios(df: DataFrame, price: float) -> DataFrame:
    """Holdings value over cap (ratio and percent) and share of the total supply; out of range is 0."""
    value = F.col("holdings") * price
    ratio = F.when(F.col("market_cap") > 0, F.try_divide(value, F.col("market_cap")))
    supply = F.col("holdings") / 21_000_000 * 100

    def within(c, lo, hi, digits):
        return F.coalesce(F.when(c.between(lo, hi), F.round(c, digits)), F.lit(0.0))
    return df.withColumns({"mnav": within(ratio, 0.001, 20.0, 3), "mnav_pct": within(ratio * 100, 0.1, 5000.0, 2),
                           "supply_share": within(supply, 0.001, 5.0, 4)})


# ---------------------------------------------------------------- deduplication


def best_row(df: DataFrame, keys: Sequence[str | Column], rank: Column) -> DataFrame:
    """The row with the largest ``rank`` per key, as an aggregate with map-side combine.

    A key that owns a third of the table shrinks to one row per task before the shuffle.
    """
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), rank).alias("_b")).select("_b.*"))


def dedupe_companies(df: DataFrame) -> DataFrame:
    """Best listing per normalised company name; rows with a blank name leave."""
    score = L.asset_score("ticker", F.col("market_cap"), F.col("volume"), "primary_exchange", "country")
    named = df.filter(F.trim("name") != "")
    rank = F.struct((-score).alias("s"), "ticker")
    return (named.groupBy(normalize_company(F.trim("name")).alias("_key"))
            .agg(F.min_by(F.struct(*df.columns), rank).alias("_b")).select("_b.*"))


def dedupe_listings(df: DataFrame) -> DataFrame:
    """Best exchange per exact company name, then the larger cap, then the smaller symbol."""
    rank = F.struct(L.listing_priority("symbol", "exchange").alias("p"), (-F.col("market_cap")).alias("c"), "symbol")
    return df.groupBy("name").agg(F.min_by(F.struct(*df.columns), rank).alias("_b")).select("_b.*")


def dedupe_rank(df: DataFrame, order: str = "row_id") -> DataFrame:
    """First row per rank; rows without a rank count by name."""
    key = F.coalesce(F.col("rank").cast("string"), F.nullif(F.col("name"), F.lit("")))
    return (df.withColumn("_k", key).filter(F.col("_k").isNotNull()).groupBy("_k")
            .agg(F.min_by(F.struct(*df.columns), order).alias("_b")).select("_b.*"))


def keep_latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Newest row per key; also how unique keys are enforced at a write."""
    return best_row(df, keys, F.col(order))


def distinct_first(df: DataFrame, keys: Sequence[str], order: str = "row_no") -> DataFrame:
    """First row per key."""
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("_b")).select("_b.*"))


def unique_symbols(df: DataFrame, order: str = "row_id", size: int = BLOCK_BARS) -> DataFrame:
    """Later occurrences of a symbol get the next free number from 2 on as a suffix.

    Occurrences are numbered by span counts, so a symbol carried by a third of the rows is not one task.  Numbers
    that a natural symbol uses are skipped: the r-th of them, t, has t - 1 - r free numbers below it, so the i-th
    free number is i + 1 and as many more as there are numbers in use with fewer than i free ones below.  That is a
    running maximum over both, in blocks; no symbol's numbers meet in one place.  A number of over 18 digits
    is out of reach of any count.
    """
    numbered = cut_lineage(number_bars(df.filter("symbol IS NOT NULL"), ("symbol",), size, order))
    natural = numbered.select("symbol").distinct()
    # a name such as AB12 blocks 12 for AB and 2 for AB1
    parts = natural.withColumn("cut", F.explode(F.sequence(F.lit(1), F.length("symbol"))))
    parts = parts.select(F.expr("left(symbol, cut)").alias("symbol"),
                         F.expr("substring(symbol, cut + 1)").alias("_num"))
    taken = (parts.filter(F.col("_num").rlike(r"^[1-9]\d{0,17}$")).select("symbol", F.col("_num").cast("long").alias("_t"))
             .filter("_t >= 2").join(natural, "symbol").distinct())
    ranked = number_bars(taken, ("symbol",), size, "_t")
    gaps = cut_lineage(ranked.groupBy("symbol", (F.col("_t") - 2 - F.col("bar_no")).alias("_below"))
                       .agg(F.max(F.col("bar_no") + 1).alias("_rank")))
    asked = (numbered.filter(F.col("bar_no") >= 1).select("symbol", order, (2 * F.col("bar_no")).alias("_place"))
             .join(gaps.select("symbol").distinct(), "symbol", "left_semi"))
    both = asked.unionByName(gaps.select("symbol", (2 * F.col("_below") + 1).alias("_place"), "_rank"), allowMissingColumns=True)
    shift = (running(number_bars(both, ("symbol",), size, "_place"), {"_shift": ("max", F.col("_rank"))}, ("symbol",), size)
             .filter(F.col(order).isNotNull()).select("symbol", order, "_shift"))
    keep = (F.col("bar_no") == 0) | F.col("symbol").isin("", "N/A")
    n = F.col("bar_no") + 1 + F.coalesce("_shift", F.lit(0))
    named = (numbered.join(shift, ["symbol", order], "left")
             .withColumn("unique_symbol", F.when(keep, F.col("symbol")).otherwise(F.concat("symbol", n.cast("string"))))
             .select(*df.columns, "unique_symbol"))
    return named.unionByName(df.filter("symbol IS NULL").withColumn("unique_symbol", F.col("symbol")))


# ---------------------------------------------------------------- classification joins


def apply_classification(df: DataFrame, cls: DataFrame) -> DataFrame:
    """Category by lower name or lower ticker, the earlier classification wins.

    Two equi joins instead of one OR condition, which would be a nested loop.
    """
    def first(by):
        return (cls.groupBy(F.lower(by).alias("_k"))
                .agg(F.min(F.struct("cls_id", "category")).alias("_c")))
    by_name = first("name").select(F.col("_k").alias("_n"), F.col("_c").alias("_cn"))
    by_tick = first("ticker").select(F.col("_k").alias("_t"), F.col("_c").alias("_ct"))
    out = (df.withColumns({"_n": F.lower("name"), "_t": F.lower("ticker")})
           .join(by_name, "_n", "left").join(by_tick, "_t", "left"))
    return (out.withColumn("category", F.least("_cn", "_ct")["category"]).drop("_n", "_t", "_cn", "_ct"))


def _bounds(q: int, longest: int) -> list[int]:
    """Depths of the trie's nodes: q, 2q, 4q ... characters below the longest text."""
    out = [q]
    while out[-1] * 2 < longest:
        out.append(out[-1] * 2)
    return out


def prefix_texts(a: DataFrame, b: DataFrame, q: int = 12) -> DataFrame:
    """Pairs (a_key, b_text, b_key) of one side where the text of a begins with that of b, by a trie joined level by level.

    a has side, a_key and a_text; b has side, b_text and b_key, a row a side and text.  The texts of b (not empty) share
    their beginnings of q, 2q, 4q ... characters: such a beginning is one node, which knows the lengths at which to
    look next.  Every text of a looks up its pieces of those lengths, one equi join a level, and goes on only from nodes
    it reached.  However many texts begin alike, they are met as one node, so no pair is made that does not hold; a
    piece met by very many texts is one row on the other side, which a skewed join can be split along.  Levels
    grow with the logarithm of the longest text of b.
    """
    size = F.length("b_text")
    b = b.filter(size > 0)
    bounds = _bounds(q, b.agg(F.max(size)).first()[0] or 0)
    # a text stands under the nodes of its beginnings; the length after a node is that of the next one or its own
    path = F.array(F.struct(F.lit("").alias("at"), F.least(size, F.lit(q)).alias("next")),
                   *[F.struct(F.substring("b_text", 1, n).alias("at"), F.least(size, F.lit(2 * n)).alias("next")) for n in bounds])
    ends = F.struct(F.col("b_text").alias("at"), F.lit(None).cast("int").alias("next"))
    path = F.concat(F.filter(path, lambda x: F.length(x["at"]) < size), F.array(ends))
    # at most q lengths under the root and as many as its own depth under a node
    tree = (b.select("side", "b_key", F.explode(path).alias("_n")).groupBy("side", F.col("_n.at").alias("_at"))
            .agg(F.collect_set("_n.next").alias("_lens"), F.count_if(F.col("_n.next").isNull()).alias("_ends"),
                 F.max(F.when(F.col("_n.next").isNull(), F.col("b_key"))).alias("b_key")))
    tree = cut_lineage(tree)
    # a row a side, of at most q numbers: broadcast
    root = tree.filter(F.col("_at") == "").select("side", "_lens")
    state = a.filter(F.length("a_text") > 0).select("side", "a_key", F.col("a_text").alias("_s")).join(F.broadcast(root), "side")
    found = None
    for depth in bounds + [None]:
        fits = F.filter("_lens", lambda n: n <= F.length("_s"))
        pieces = state.select("side", "a_key", "_s", F.explode(fits).alias("_n"))
        pieces = pieces.select("side", "a_key", F.col("_s").substr(F.lit(1), F.col("_n")).alias("_at"),
                               *([F.when(F.col("_n") == depth, F.col("_s")).alias("_s")] if depth else []))
        met = pieces.join(tree, ["side", "_at"])
        if depth is not None:
            # few texts reach a node; read for the pairs and for the next level
            met = cut_lineage(met)
            state = met.filter((F.size("_lens") > 0) & F.col("_s").isNotNull()).select("side", "a_key", "_s", "_lens")
        pairs = met.filter("_ends > 0").select("side", "a_key", F.col("_at").alias("b_text"), "b_key")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def endings(text: str) -> Column:
    """Array of the endings of a text, the whole one first; none of an empty text."""
    c = F.col(text)
    return F.transform(F.when(F.length(c) > 0, F.sequence(F.lit(1), F.length(c))), lambda i: F.substr(c, i))


def contains_pairs(a: DataFrame, b: DataFrame, q: int = 12) -> DataFrame:
    """Pairs (a_key, b_key) where the text of a contains that of b: one of its endings begins with it."""
    texts = b.select(F.lit(0).alias("side"), "b_text", F.lit(0).alias("b_key")).distinct()
    found = prefix_texts(a.select(F.lit(0).alias("side"), "a_key", F.explode(endings("a_text")).alias("a_text")), texts, q)
    return found.select("a_key", "b_text").distinct().join(b, "b_text").select("a_key", "b_key")


def apply_classification_fuzzy(df: DataFrame, cls: DataFrame, q: int = 12) -> DataFrame:
    """Category when one name contains the other (any case); the earlier one wins.  Names are looked up once each.

    Class names inside a row's name (side 0) and row names inside a class name (side 1) are found in one walk; for the
    latter, equal endings of class names are reduced to their least class first.  Rows without a name match nothing.
    """
    names = df.select(F.lower("name").alias("_name")).filter(F.length("_name") > 0).distinct()
    # of classes of one name only the earliest can win
    known = cls.groupBy(F.lower("name").alias("_name")).agg(F.min("cls_id").alias("cls_id"))
    nobody, no_class = F.lit(None).cast("string"), known.select("cls_id").schema[0].dataType
    parts = names.select(F.lit(0).alias("side"), F.struct("_name", F.lit(None).cast(no_class).alias("cls_id")).alias("a_key"),
                         F.explode(endings("_name")).alias("a_text"))
    ends = known.select("cls_id", F.explode(endings("_name")).alias("a_text")).groupBy("a_text").agg(F.min("cls_id").alias("cls_id"))
    asked = parts.unionByName(ends.select(F.lit(1).alias("side"), F.struct(nobody.alias("_name"), "cls_id").alias("a_key"), "a_text"))
    texts = (known.select(F.lit(0).alias("side"), F.col("_name").alias("b_text"), F.col("cls_id").alias("b_key"))
             .unionByName(names.select(F.lit(1).alias("side"), F.col("_name").alias("b_text"), F.lit(None).cast(no_class).alias("b_key"))))
    first = (prefix_texts(asked, texts, q).groupBy(F.coalesce("a_key._name", "b_text").alias("_name"))
             .agg(F.min(F.coalesce("a_key.cls_id", "b_key")).alias("cls_id")))
    hit = first.join(cls.groupBy("cls_id").agg(F.min("category").alias("_cat")), "cls_id").drop("cls_id")
    out = df.withColumn("_name", F.lower("name")).join(hit, "_name", "left")
    return out.withColumn("category", F.coalesce("_cat", L.fallback_category("name"))).drop("_cat", "_name")


def missing_ranks(df: DataFrame, top: int = 500, per_page: int = 100) -> DataFrame:
    """Ranks 1..top that were not found and the page each belongs to."""
    expected = df.sparkSession.range(1, top + 1).select(F.col("id").cast("int").alias("rank"))
    found = df.select(F.col("rank").cast("int").alias("rank")).filter(F.col("rank").between(1, top))
    return (expected.join(found, "rank", "left_anti")
            .withColumn("page", F.ceil(F.col("rank") / per_page).cast("int")))


# ---------------------------------------------------------------- calendar


# fixed values: calendar events that are kept
EVENT_NAMES = (
    "Unemployment Rate", "ISM Manufacturing PMI", "CPI y/y", "FOMC Press Conference", "Core Retail Sales m/m",
    "Non-Farm Employment Change", "Federal Funds Rate", "GDP Growth Rate", "CPI YoY", "PPI YoY",
    "President Trump Speaks", "Unemployment Claims")


def select_events(df: DataFrame, names: Sequence[str] = EVENT_NAMES, currency: str = "USD") -> DataFrame:
    return df.filter((F.trim("currency") == currency)
                     & F.lower(F.trim("event_name")).isin(*[n.lower() for n in names]))


def months_ahead(df: DataFrame, column: str, today: Column) -> DataFrame:
    """Rows of this calendar month and the next one, over the turn of the year too."""
    month = F.date_trunc("month", today)
    d = F.col(column)
    return df.filter((d >= month) & (d < F.add_months(month, 2).cast("timestamp_ntz")))


def forward_fill(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("page_id",),
                 order: str = "row_no", size: int = BLOCK_BARS) -> DataFrame:
    """Carry the last known value of each column down the rows of a document."""
    from .series import running
    numbered = number_bars(df, keys, size, order)
    filled = running(numbered, {f"_{c}": ("last", F.col(c)) for c in columns}, keys, size)
    return filled.withColumns({c: F.col(f"_{c}") for c in columns}).drop("bar_no", *[f"_{c}" for c in columns])


def any_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(F.coalesce(*columns).isNotNull())


def change_from_close(df: DataFrame) -> DataFrame:
    return df.withColumn("percentage_change", pct_change_from_close("current_price", "previous_close"))
