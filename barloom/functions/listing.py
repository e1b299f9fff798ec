"""Rules on listings: currency, funds, preferred shares, public companies, categories.

The rule tables are fixed values; rule order matters and is kept.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# fixed values: (currency, symbol suffixes, countries), first match wins
CURRENCY_RULES = (
    ("IDR", (".JK",), ("ID",)), ("CLP", (".SN",), ("CL",)), ("SAR", (".SR",), ("SA",)),
    ("ILS", (".TA",), ("IL",)), ("ARS", (".BA",), ("AR",)), ("GBP", (".L",), ("GB",)),
    ("ZAR", (".JO",), ("ZA",)), ("COP", (".CO",), ("CO",)), ("PEN", (".LM",), ("PE",)),
    ("EGP", (".EG",), ("EG",)), ("TRY", (".IS",), ("TR",)), ("RUB", (".ME",), ("RU",)),
    ("KRW", (".KS", ".KQ"), ("KR",)), ("INR", (".BO", ".NS"), ("IN",)), ("BRL", (".SA",), ("BR",)),
    ("MXN", (".MX",), ("MX",)), ("THB", (".BK",), ("TH",)), ("MYR", (".KL",), ("MY",)),
    ("PHP", (".PS",), ("PH",)), ("VND", (".VN",), ("VN",)), ("TWD", (".TW",), ("TW",)),
    ("HKD", (".HK",), ("HK",)), ("SGD", (".SI",), ("SG",)), ("JPY", (".T",), ("JP",)),
    ("CNY", (".SS", ".SZ"), ("CN",)), ("AUD", (".AX",), ("AU",)), ("CAD", (".TO",), ("CA",)),
    ("EUR", (".PA", ".DE"), ("FR", "DE", "IT", "ES", "NL", "BE", "AT", "PT", "GR", "FI", "IE")))

# fixed values: US dollars per unit, used when a feed was not converted
EMERGENCY_RATES = {
    "IDR": 0.000062, "CLP": 0.0010, "SAR": 0.267, "ILS": 0.27, "COP": 0.00025, "PEN": 0.27, "EGP": 0.020,
    "TRY": 0.029, "RUB": 0.010, "KRW": 0.00075, "INR": 0.012, "BRL": 0.18, "MXN": 0.058, "ZAR": 0.055,
    "THB": 0.029, "MYR": 0.22, "PHP": 0.018, "VND": 0.000040, "TWD": 0.031, "HKD": 0.128, "SGD": 0.74,
    "JPY": 0.0067, "CNY": 0.14, "AUD": 0.64, "CAD": 0.74, "EUR": 1.08, "GBP": 1.26, "ARS": 0.0010}

# fixed values: US dollars per unit, used when no live rate is at hand
FALLBACK_RATES = {
    "IDR": 0.0000625, "JPY": 0.0067, "KRW": 0.00075, "INR": 0.012, "CNY": 0.14, "HKD": 0.128, "SAR": 0.267,
    "AED": 0.272, "THB": 0.028, "MYR": 0.224, "PHP": 0.018, "VND": 0.00004, "TWD": 0.031, "ZAR": 0.053,
    "BRL": 0.20, "MXN": 0.058, "CLP": 0.0010, "COP": 0.00024, "PEN": 0.27, "ARS": 0.0010, "EGP": 0.032,
    "TRY": 0.030, "ILS": 0.28, "EUR": 1.08, "GBP": 1.27, "CHF": 1.11, "CAD": 0.74, "AUD": 0.64, "SEK": 0.094,
    "NOK": 0.092, "DKK": 0.145, "SGD": 0.74}

# fixed values: exchange suffix rules of the suffix-first variant
SUFFIX_CURRENCY = ((r"\.JO$|\.JNB", "ZAR"), (r"\.HK$|\.HKSE", "HKD"), (r"\.SR$|\.SAU", "SAR"),
                   (r"\.KS$|\.KQ$", "KRW"), (r"\.T$", "JPY"), (r"\.L$|\.LSE$", "GBP"), (r"\.TA$|\.TLV$", "ILS"))

# fixed values: currency of a country
COUNTRY_CURRENCY = {
    "US": "USD", "CA": "CAD", "GB": "GBP", "AU": "AUD", "NZ": "NZD", "DE": "EUR", "FR": "EUR", "IT": "EUR",
    "ES": "EUR", "NL": "EUR", "BE": "EUR", "AT": "EUR", "FI": "EUR", "IE": "EUR", "PT": "EUR", "JP": "JPY",
    "CN": "CNY", "HK": "HKD", "SG": "SGD", "KR": "KRW", "IN": "INR", "TH": "THB", "MY": "MYR", "ID": "IDR",
    "PH": "PHP", "VN": "VND", "TW": "TWD", "CH": "CHF", "SE": "SEK", "NO": "NOK", "DK": "DKK", "BR": "BRL",
    "MX": "MXN", "AR": "ARS", "CL": "CLP", "CO": "COP", "PE": "PEN", "ZA": "ZAR", "EG": "EGP", "SA": "SAR",
    "AE": "AED", "IL": "ILS", "TR": "TRY"}

# fixed values: words that mark funds
FUND_SYMBOL_PARTS = ("ETF", "FUND", "IDX", "INDEX")
FUND_NAME_PARTS = ("FUND", "INDEX", "TRUST", "PORTFOLIO", "VANGUARD", "ISHARES", "SPDR", "FIDELITY",
                   "ADMIRAL", "INSTITUTIONAL", "INVESTOR")
FUND_WORDS = ("ETF", "INDEX", "FUND", "SPDR", "ISHARES", "VANGUARD")

COUNTRY_SUFFIXES = (".NS", ".BO", ".TO", ".L", ".PA", ".DE", ".SW", ".T", ".KS", ".KQ", ".HK", ".SS", ".SZ")
BAD_SYMBOLS = ("NVL", "AXTLF", "ALIZY")
PRIMARY_EXCHANGES = ("NYSE", "NASDAQ", "TSE", "SSE", "SZSE", "LSE", "FRA", "AMS", "SIX", "TSX")
REGIONAL_EXCHANGES = ("ASX", "BSE", "NSE")
MAJOR_EXCHANGES = ("NYSE", "NASDAQ", "LSE", "HKSE", "TSX", "XETRA", "SIX")

# fixed values: category and the words that give it, first match wins
CATEGORY_WORDS = (
    ("Technology Stock", ("microsoft", "apple", "google", "meta", "nvidia", "intel", "amd", "tesla", "amazon",
                          "netflix", "adobe", "salesforce", "oracle", "ibm")),
    ("Financial Stock", ("bank", "jpmorgan", "wells fargo", "goldman sachs", "morgan stanley", "citigroup",
                         "visa", "mastercard", "paypal", "berkshire hathaway")),
    ("Healthcare Stock", ("johnson", "pfizer", "merck", "abbott", "bristol myers", "eli lilly", "roche",
                          "novartis", "health", "pharma", "medical")),
    ("Energy Stock", ("exxon", "chevron", "shell", "bp", "conocophillips", "energy", "oil", "gas")),
    ("Consumer Stock", ("coca cola", "pepsi", "procter", "walmart", "target", "home depot", "nike",
                        "starbucks", "mcdonald")),
    ("Precious Metals", ("gold", "silver", "platinum", "copper", "aluminum")),
    ("Cryptocurrency", ("bitcoin", "ethereum", "coin", "crypto", "blockchain")),
    ("ETF", ("etf", "fund", "trust", "spdr", "ishares", "vanguard")))

# fixed values: names that are not public companies
TOTAL_WORDS = ("grand total", "total", "subtotal", "sum")
COUNTRY_NAMES = (
    "china", "united states", "united kingdom", "north korea", "ukraine", "el salvador", "bhutan", "germany",
    "japan", "canada", "france", "australia", "singapore", "hong kong", "switzerland", "netherlands",
    "sweden", "norway", "south korea", "russia", "brazil", "argentina", "mexico", "venezuela", "colombia",
    "peru", "chile", "india", "thailand", "vietnam", "malaysia", "indonesia", "philippines", "new zealand",
    "south africa")
GOVERNMENT_WORDS = ("holdings of public", "government", "ministry", "department of", "central bank",
                    "reserve bank", "federal reserve", "treasury", "sovereign", "state", "national")
NON_PROFIT_WORDS = ("foundation", "trust", "endowment", "charity")
PRIVATE_NAMES = ("block.one", "spacex", "strike", "zap solutions")
CORPORATE_WORDS = ("inc", "corp", "ltd", "llc", "plc", "ag", "sa", "gmbh", "asa", "company", "group", "holdings",
                   "technologies", "systems", "solutions", "services", "digital", "mining", "platforms")
KNOWN_PUBLIC = ("tesla", "paypal", "amazon", "google", "facebook", "microsoft")


def _any_of(c: Column, words) -> Column:
    return reduce(or_, [c.contains(w) for w in words])


def _lookup(pairs: dict) -> Column:
    """Literal map; Spark folds it into one constant."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def detect_currency(symbol, country) -> Column:
    """Currency by symbol suffix or country, the earlier rule wins, USD when nothing matches.

    Two lookups give the rule numbers of the suffix and of the country.
    """
    by_suffix = {x: i for i, (_, suffixes, _c2) in enumerate(CURRENCY_RULES, 1) for x in suffixes}
    by_country = {x: i for i, (_, _s, countries) in enumerate(CURRENCY_RULES, 1) for x in countries}
    suffix = F.regexp_extract(F.upper(_c(symbol)), r"(\.[^.]*)$", 1)
    rule = F.least(F.try_element_at(_lookup(by_suffix), suffix),
                   F.try_element_at(_lookup(by_country), F.upper(F.coalesce(_c(country), F.lit("")))))
    codes = {i: code for i, (code, _s, _k) in enumerate(CURRENCY_RULES, 1)}
    return F.coalesce(F.try_element_at(_lookup(codes), rule), F.lit("USD"))


def detect_currency_suffix_first(symbol, country) -> Column:
    """Currency by exchange suffix, then by country, then USD."""
    s = F.upper(_c(symbol))
    by_suffix = F.coalesce(*[F.when(s.rlike(p), code) for p, code in SUFFIX_CURRENCY])
    return F.coalesce(by_suffix, F.try_element_at(_lookup(COUNTRY_CURRENCY), _c(country)), F.lit("USD"))


def rate_column(currency, rates: dict[str, float] = EMERGENCY_RATES) -> Column:
    """Rate from a fixed table; NULL for a currency that is not in it."""
    return F.try_element_at(_lookup(rates), _c(currency))


def rates_frame(spark, rates: dict[str, float] = FALLBACK_RATES) -> DataFrame:
    return spark.createDataFrame(sorted(rates.items()), "currency string, usd_rate double")


def is_subunit(symbol, exchange) -> Column:
    """Listings quoted in hundredths (pence, cents, agorot)."""
    s, e = F.upper(_c(symbol)), F.upper(F.coalesce(_c(exchange), F.lit("")))
    return s.rlike(r"\.(L|JO|TA)$") | e.rlike("LSE|JNB|TLV")


def is_fund(symbol, name) -> Column:
    """Fund by parts of the symbol (4 letters or more) or of the name."""
    s, n = F.upper(_c(symbol)), F.upper(_c(name))
    return (((F.length(s) >= 4) & _any_of(s, FUND_SYMBOL_PARTS)) | n.contains(" ETF") | n.contains("ETF ")
            | _any_of(n, FUND_NAME_PARTS))


def contains_word(name, words=FUND_WORDS) -> Column:
    """A whole word (punctuation around it ignored) is one of ``words``."""
    parts = F.transform(F.split(F.upper(_c(name)), r"\s+"),
                        lambda w: F.regexp_replace(w, r"^[.,!?;:]+|[.,!?;:]+$", ""))
    return F.arrays_overlap(parts, F.array(*[F.lit(w.upper()) for w in words]))


def is_preferred(symbol) -> Column:
    s = F.upper(_c(symbol))
    return F.coalesce(s.rlike("[-.][PWU]") | (s.contains("PR") & (F.length(s) > 4)), F.lit(False))


def is_domestic(symbol) -> Column:
    """One to five characters and no country suffix (a suffix alone does not count)."""
    s = _c(symbol)
    suffixed = reduce(or_, [s.endswith(x) & (F.length(s) > len(x)) for x in COUNTRY_SUFFIXES])
    return F.length(s).between(1, 5) & ~suffixed


def is_bad_listing(symbol, name, exchange, cap) -> Column:
    """Denied symbol or name, cap above 5e12, over-the-counter or blank exchange."""
    s, n, e = F.upper(_c(symbol)), F.upper(_c(name)), F.upper(F.coalesce(_c(exchange), F.lit("")))
    return (s.isin(*BAD_SYMBOLS) | (n.contains("AXTEL") & n.contains("S.A.B")) | (_c(cap) > 5e12)
            | e.contains("OTC") | (e == ""))


def listing_priority(symbol, exchange) -> Column:
    """1 Hong Kong, 2 primary exchanges and Saudi, 3 regional, 4 the rest."""
    s, e = F.upper(_c(symbol)), F.upper(F.coalesce(_c(exchange), F.lit("")))
    return (F.when(s.endswith(".HK") | (e == "HKSE"), 1)
            .when(e.isin(*PRIMARY_EXCHANGES) | (e == "SAU") | e.contains("SAUDI"), 2)
            .when(e.isin(*REGIONAL_EXCHANGES), 3).otherwise(4))


def asset_score(symbol, cap, volume, exchange, country) -> Column:
    """Preference among listings of one company; common stock outweighs everything."""
    e = F.upper(F.coalesce(_c(exchange), F.lit("")))
    return (F.when(is_preferred(symbol), 0.0).otherwise(10_000.0) + _c(cap) / 1e9
            + F.coalesce(_c(volume), F.lit(0.0)) / 1e6
            + F.when(_any_of(e, MAJOR_EXCHANGES), 100.0).otherwise(0.0)
            + F.when(_c(country).isin("US", "USA"), 50.0).otherwise(0.0))


def asset_type(name) -> Column:
    return F.when(contains_word(name, ("REIT",)), "reit").otherwise("stock")


def fallback_category(name) -> Column:
    n = F.lower(_c(name))
    out = None
    for label, words in CATEGORY_WORDS:
        hit = _any_of(n, words)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("Other")


def is_public_company(name) -> Column:
    """Not a total, country, office, charity or private firm, and corporate or with a ticker."""
    raw = _c(name)
    n = F.trim(F.lower(raw))
    starts = reduce(or_, [n.startswith(f"auto {k}") for k in COUNTRY_NAMES])
    excluded = (_any_of(n, TOTAL_WORDS) | n.isin(*COUNTRY_NAMES) | starts | _any_of(n, GOVERNMENT_WORDS)
                | _any_of(n, NON_PROFIT_WORDS) | _any_of(n, PRIVATE_NAMES))
    wanted = (_any_of(n, CORPORATE_WORDS) | raw.rlike(r"(?U)\b[A-Z]{2,5}(?:\.[A-Z]+)?\b") | _any_of(n, KNOWN_PUBLIC))
    return F.coalesce((raw != "") & ~excluded & wanted, F.lit(False))
