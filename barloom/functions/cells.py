"""Recovering fields from table rows scraped as cell texts.

``cells`` is an array of texts, ``attrs`` the sort attributes of the same cells,
``text`` the text of the whole row.  Each recovery is a chain of candidates; the
first that passes its range test wins.  Everything is array expressions, so rows
stay in the JVM and spread over the cluster like any other projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import parse_btc, parse_money

# fixed patterns
PERCENT_PATTERNS = (r"[+-]?\d+\.?\d*%", r"[+-]?\d+\.?\d*\s*%", r"[+-]?\s*\d+\.?\d*%", r"\d+\.?\d*%\s*[↑↓]",
                    r"[↑↓]\s*\d+\.?\d*%", r"\(\d+\.?\d*%\)", r"(?i)[+-]\d+\.?\d*\s*percent")
CURRENCY_PATTERNS = (r"[$¥€£₹][\d,]+\.?\d*", r"[\d,]+\.?\d*\s*[$¥€£₹]", r"USD\s*[\d,]+\.?\d*",
                     r"[\d,]+\.?\d*\s*USD")
CAP_PATTERN = r"(?i)\$?[\d,]+\.?\d*\s*[TMB]|[\d,]+\.?\d*\s*(trillion|billion|million)"
NUMBER = r"[\d,]+\.?\d*"


def at(cells: Column, n: int) -> Column:
    """Text of cell n (zero-based); NULL when missing or empty."""
    return F.nullif(F.trim(F.try_element_at(cells, F.lit(n + 1))), F.lit(""))


def first_of(cells: Column, test: Callable[[Column], Column]) -> Column:
    """First cell that passes; NULL if none does."""
    return F.try_element_at(F.filter(cells, lambda c: F.coalesce(test(c), F.lit(False))), F.lit(1))


def _hit(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1))


def _value(text: Column) -> Column:
    return F.translate(text, "$,", "").try_cast("double")


def _rank(text: Column) -> Column:
    """Whole number 1..500 or NULL."""
    n = F.when(text.rlike(r"^\d+$"), text.try_cast("int"))
    return F.when(n.between(1, 500), n)


def recover_rank(cells: Column, attrs: Column, text: Column, page: Column, row_no: Column) -> Column:
    """Rank from cell 1, any attribute, any cell, the row text, or the position on the page."""
    def first_rank(xs: Column) -> Column:
        return F.try_element_at(F.filter(F.transform(xs, _rank), lambda r: r.isNotNull()), F.lit(1))
    guess = (page - 1) * 100 + row_no + 1
    return F.coalesce(_rank(F.try_element_at(attrs, F.lit(2))), _rank(at(cells, 1)), first_rank(attrs),
                      first_rank(F.transform(cells, lambda c: F.trim(c))), first_rank(_all(text, r"\b\d{1,3}\b")),
                      F.when(guess.between(1, 500), guess.cast("int")))


def recover_cap(cells: Column) -> Column:
    """Text of the market cap: cell 4, a financial cell with T/M/B, any amount with a scale."""
    money = F.slice(cells, F.lit(4), F.size(cells))
    fixed = at(cells, 4)
    return F.coalesce(F.when(fixed.rlike("[TMB]"), fixed), first_of(money, lambda c: c.rlike("[TMB]")),
                      first_of(money, lambda c: c.rlike("(?i)[TMB]")),
                      first_of(cells, lambda c: c.rlike(CAP_PATTERN)))


def _from_attr(attr: Column, low: float, high: float) -> Column:
    value = F.abs(attr.try_cast("double"))
    text = F.replace(F.format_string("$%.2f", value), F.lit(".00"), F.lit(""))
    return F.when(attr.rlike(r"^-?[\d.]+$") & value.between(low, high), text)


def recover_price(cells: Column, attrs: Column, text: Column) -> Column:
    """Text of the price: cell 5, its attribute, any $ cell, any currency, any fitting number."""
    def plain(c: Column) -> Column:
        return c.contains("$") & ~c.rlike("[TMB]")
    fixed = at(cells, 5)
    attr = F.try_element_at(attrs, F.lit(6))
    money, money_attrs = F.slice(cells, F.lit(4), F.size(cells)), F.slice(attrs, F.lit(4), F.size(attrs))

    def looks_like_rank(m: Column) -> Column:
        return _value(m).between(1, 500) & ~m.contains(".")

    def number_in(source: Column, low: float, high: float) -> Column:
        ok = F.filter(_all(source, NUMBER), lambda m: F.coalesce(
            _value(m).between(low, high) & ~looks_like_rank(m), F.lit(False)))
        return F.concat(F.lit("$"), F.try_element_at(ok, F.lit(1)))
    by_attr = F.try_element_at(F.filter(F.transform(money_attrs, lambda a: _from_attr(a, 0.01, 500_000)),
                                        lambda p: p.isNotNull()), F.lit(1))
    in_cells = F.filter(F.flatten(F.transform(F.filter(cells, plain), lambda c: _all(c, r"\$?[\d,]+\.?\d*"))),
                        lambda m: F.coalesce(_value(m).between(0.01, 50_000), F.lit(False)))
    dollar = F.try_element_at(in_cells, F.lit(1))
    dollar = F.when(dollar.startswith("$"), dollar).otherwise(F.concat(F.lit("$"), dollar))
    any_currency = F.coalesce(*[_hit(first_of(cells, lambda c, p=p: c.rlike(p)), p) for p in CURRENCY_PATTERNS])
    any_cell = F.try_element_at(F.filter(F.transform(cells, lambda c: number_in(c, 0.10, 100_000)),
                                         lambda p: p.isNotNull()), F.lit(1))
    return F.coalesce(F.when(plain(fixed), fixed), _from_attr(attr, 0.01, 500_000),
                      first_of(money, plain), by_attr, dollar, any_currency, any_cell,
                      number_in(text, 1.0, 200_000))


def recover_change(cells: Column, attrs: Column, text: Column) -> Column:
    """Percent change: any percent form in a cell, a signed attribute, then the row text."""
    in_cell = F.coalesce(*[_hit(first_of(cells, lambda c, p=p: c.rlike(p)), p) for p in PERCENT_PATTERNS])
    signed = F.filter(attrs, lambda a: F.coalesce(
        a.rlike(r"^[+-]") & a.try_cast("double").between(-100, 1000), F.lit(False)))
    by_attr = F.concat(F.try_element_at(signed, F.lit(1)), F.lit("%"))
    in_row = F.coalesce(*[_hit(text, p) for p in (PERCENT_PATTERNS[0], r"(?i)[+-]?\d+\.?\d*\s*percent")])
    ok = F.regexp_extract(in_row, r"[\d.]+", 0).try_cast("double").between(0, 1000)
    return F.coalesce(in_cell, by_attr, F.when(ok, in_row))


def recover_identity(cells: Column, text: Column, rank: Column) -> tuple[Column, Column]:
    """Name and symbol: 'Name (SYM)', a badge cell, the first alphabetic word, a placeholder."""
    pair = r"^(.*?)\s*\(([A-Z0-9]{1,8})\)\s*$"
    paired = first_of(cells, lambda c: c.rlike(pair))
    dedicated = at(cells, 2)
    words = F.split(F.coalesce(text, F.lit("")), r"\s+")
    word = first_of(words, lambda w: F.regexp_replace(w, r"[0-9$%+\-.,]", "").rlike(r"(?U)^\p{L}{3,}$"))
    name = F.coalesce(F.nullif(F.regexp_extract(paired, pair, 1), F.lit("")),
                      F.when(~dedicated.rlike(r"[$%]|^[0-9.,\s]+$"), dedicated), word,
                      first_of(cells, lambda c: (F.length(c) > 2) & ~c.rlike(r"[$%]|^[0-9.,\s]+$")),
                      F.concat(F.lit("Asset_Rank_"), rank.cast("string")))
    symbol = F.coalesce(F.nullif(F.regexp_extract(paired, pair, 2), F.lit("")),
                        first_of(cells, lambda c: c.rlike(r"^[A-Z0-9]{1,8}$") & c.rlike("[A-Z]")), F.lit("N/A"))
    return F.substring(name, 1, 255), F.substring(symbol, 1, 20)


# fixed words of header rows
HOLDING_HEADERS = "rank|name|bitcoin|usd value|entity"


def parse_holding(cells: Column, text: Column) -> dict[str, Column]:
    """Fields of a holdings row; ``keep`` tells rows with a name and one amount."""
    usd_pattern = r"\$[\d,]+\.?\d*[BMT]?"
    rank = F.when(at(cells, 0).rlike(r"^\d+$"), at(cells, 0).try_cast("int"))
    coin_cell = first_of(cells, lambda c: c.contains("₿") | F.lower(c).contains("btc"))
    coin = F.coalesce(coin_cell, _hit(text, r"₿\s*[\d,]+"))
    named = F.when(F.length(at(cells, 1)) > 1, at(cells, 1))
    usd_cell = first_of(cells, lambda c: c.contains("$") & ~c.contains("₿"))
    # the row text is only consulted when the cells gave no name or no coin amount
    usd = F.coalesce(usd_cell, F.when(named.isNull() | coin_cell.isNull(), _hit(text, usd_pattern)))
    rest = F.regexp_replace(text, r"^\d+\s*", "")
    rest = F.trim(F.regexp_replace(F.regexp_replace(rest, r"₿[\d,\s]+", ""), usd_pattern, ""))
    name = F.coalesce(named, F.when(F.length(rest) > 2, rest))
    header = F.lower(text).rlike(HOLDING_HEADERS)
    keep = (~header & (F.length(F.trim(text)) >= 3) & name.isNotNull() & (coin.isNotNull() | usd.isNotNull()))
    return {"rank": rank, "holder_name": name, "bitcoin_amount": F.coalesce(coin, F.lit("")),
            "bitcoin_raw": parse_btc(coin), "usd_value": F.coalesce(usd, F.lit("")),
            "usd_raw": parse_money(usd), "keep": F.coalesce(keep, F.lit(False))}
