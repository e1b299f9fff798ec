"""Text parsing and cleaning as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .guards import BIGINT_MAX


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _strip(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def _number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


# ---------------------------------------------------------------- amounts


def parse_money(text) -> Column:
    """'$3.512 T' to a whole number; T, B, M checked in that order, unreadable is 0."""
    t = F.trim(_strip(_c(text), "$,"))
    value = (F.when(t.contains("T"), _number(_strip(t, "T")) * 1e12)
             .when(t.contains("B"), _number(_strip(t, "B")) * 1e9)
             .when(t.contains("M"), _number(_strip(t, "M")) * 1e6).otherwise(_number(t)))
    return F.coalesce(value.try_cast("long"), F.lit(0))


def parse_number(text) -> Column:
    """Number anywhere in the text times B/M/K in any case; dashes, N/A and ? are 0."""
    raw = F.trim(_c(text))
    t = _strip(raw, ",$₿%")
    up = F.upper(t)
    digits = F.regexp_extract(t, r"([\d.-]+)", 1).try_cast("double")
    scale = (F.when(up.contains("B"), 1e9).when(up.contains("M"), 1e6).when(up.contains("K"), 1e3)
             .otherwise(1.0))
    empty = raw.isNull() | raw.isin("-", "", "N/A", "?", "—")
    return F.when(empty, 0.0).otherwise(F.coalesce(digits * scale, F.lit(0.0)))


def parse_price(text) -> Column:
    """'$1,220' to a double with two decimals (half-even); unreadable is 0."""
    return F.coalesce(F.bround(_number(_strip(_c(text), "$,")), 2), F.lit(0.0))


def parse_btc(text) -> Column:
    """'₿ 9,720' to a whole number; unreadable is 0."""
    return F.coalesce(_number(_strip(_c(text), "₿,")).try_cast("long"), F.lit(0))


def signed_change(text, direction) -> Column:
    """Put the sign of a direction marker on a percent text; only percent texts count."""
    t, d = F.trim(_c(text)), F.lower(F.coalesce(_c(direction), F.lit("")))
    down = d.rlike("red|negative|down|loss")
    up = ~down & d.rlike("green|positive|up|gain")
    value = (F.when(down & ~t.startswith("-"), F.concat(F.lit("-"), t))
             .when(up & t.startswith("-"), F.substring(t, F.lit(2), F.length(t))).otherwise(t))
    return F.when(t.rlike(r"[+-]?\d+\.?\d*%"), value).otherwise("")


# ---------------------------------------------------------------- names

# fixed values: company suffixes in removal order
COMPANY_SUFFIXES = (
    r"\s+CORPORATION$", r"\s+CORP\.?$", r"\s+INC\.?$", r"\s+LTD\.?$", r"\s+LLC$", r"\s+LP$",
    r"\s+PLC$", r"\s+LIMITED$", r"\s+COMPANY$", r"\s+CO\.?$", r"\s+GROUP$", r"\s+HOLDINGS?$",
    r"\s+&\s+CO\.?$", r"\s+S\.A\.?$", r"\s+N\.V\.?$", r"\s+A\.G\.?$")

# fixed values: wrongly decoded characters and what they stand for
MOJIBAKE = (("癡", "è"), ("脙", "Ã"), ("陇", "ç"), ("Ã¨", "è"), ("Ã©", "é"), ("Ã§", "ç"), ("Ã¡", "á"),
            ("Ã­", "í"), ("Ã³", "ó"), ("Ãº", "ú"), ("Ã±", "ñ"), ("羹", "ü"), ("脛", "ä"),
            ("枚", "ö"), ("脽", "ß"))

# fixed values: flags in holder names (their UTF-8 bytes read as Latin-1) and the country codes that replace them
FLAGS = (("ð\x9f\x87ºð\x9f\x87¸", "US"), ("ð\x9f\x87¨ð\x9f\x87¦", "CA"), ("ð\x9f\x87¯ð\x9f\x87µ", "JP"),
         ("ð\x9f\x87¨ð\x9f\x87³", "CN"), ("ð\x9f\x87©ð\x9f\x87ª", "DE"), ("ð\x9f\x87\xadð\x9f\x87°", "HK"),
         ("ð\x9f\x87¬ð\x9f\x87§", "GB"), ("ð\x9f\x87¸ð\x9f\x87¬", "SG"), ("ð\x9f\x87¦ð\x9f\x87º", "AU"),
         ("ð\x9f\x87³ð\x9f\x87±", "NL"), ("ð\x9f\x87¸ð\x9f\x87ª", "SE"), ("ð\x9f\x87³ð\x9f\x87´", "NO"),
         ("ð\x9f\x87°ð\x9f\x87·", "KR"), ("ð\x9f\x87¨ð\x9f\x87¾", "CY"), ("ð\x9f\x87§ð\x9f\x87²", "BM"),
         ("ð\x9f\x87»ð\x9f\x87¬", "VG"), ("ð\x9f\x87°ð\x9f\x87¾", "KY"), ("ð\x9d\x87°ð\x9d\x87¾", "KY"))


def normalize_company(name) -> Column:
    """Upper case, corporate suffixes off in order, punctuation to spaces, squeezed."""
    out = F.upper(_c(name))
    for suffix in COMPANY_SUFFIXES:
        out = F.regexp_replace(out, "(?U)" + suffix, "")
    out = F.regexp_replace(out, r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


CONTROLS = r"[\x00-\x1F\x7F]"


def repair_text(text) -> Column:
    """Undo known mojibake and drop ASCII control characters."""
    out = _c(text)
    for bad, good in MOJIBAKE:
        out = F.replace(out, F.lit(bad), F.lit(good))
    return F.regexp_replace(out, CONTROLS, "")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it, so this one runs on Arrow batches."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def normalize_text(text) -> Column:
    """Repaired and composed.  ASCII text has neither mojibake nor anything to compose and stays in the JVM."""
    text = _c(text)
    return F.trim(F.coalesce(nfc(F.when(text.rlike(r"[^\x00-\x7F]"), repair_text(text))), F.regexp_replace(text, CONTROLS, "")))


def clean_holder(name) -> Column:
    """Rank digits and tags off, flags to country codes, other non-ASCII to spaces."""
    out = F.regexp_replace(F.trim(_c(name)), r"^\d+\s*", "")
    out = F.replace(F.replace(out, F.lit("Update "), F.lit("")), F.lit("New "), F.lit(""))
    for flag, code in FLAGS:
        out = F.replace(out, F.lit(flag), F.lit(f"{code} "))
    out = F.regexp_replace(out, r"[^\x00-\x7F]+", " ")
    out = F.regexp_replace(out, r"[^\w\s&.-]", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def strip_rank_noise(name) -> Column:
    """Drop a trailing line of digits and leading digits."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(name), r"\n\d+$", ""), r"^\d+\s*", ""))


def name_and_ticker(text) -> tuple[Column, Column]:
    """Split 'Name 12TICK' into name and ticker, with fallbacks on the last word."""
    t = F.trim(F.replace(_c(text), F.lit("\n"), F.lit(" ")))
    full = r"^(.*?)\s+(\d{1,3})([A-Z0-9.\-]+)$"
    words = F.split(t, r"\s+")
    many = F.size(words) >= 2
    last = F.element_at(words, -1)
    tail = r"^(\d{1,2})(\d*[A-Z0-9.\-]+)$"
    name = (F.when(t.rlike(full), F.regexp_extract(t, full, 1))
            .when(many, F.array_join(F.slice(words, 1, F.size(words) - 1), " ")).otherwise(t))
    ticker = (F.when(t.rlike(full), F.regexp_extract(t, full, 3))
              .when(many & last.rlike(tail), F.regexp_extract(last, tail, 2))
              .when(many, last).otherwise("UNKNOWN"))
    return F.trim(name), ticker


# ---------------------------------------------------------------- documents, keys, dates


def split_items(text, marker: str = "NEWS ITEM") -> Column:
    """Array of the non-empty parts between markers."""
    parts = F.transform(F.split(_c(text), marker), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def article_fields(item) -> dict[str, Column]:
    """First three lines as headline, subtitle and contents, and the first address."""
    lines = F.split(_c(item), "\n")

    def line(n):
        return F.trim(F.coalesce(F.try_element_at(lines, F.lit(n)), F.lit("")))
    url = F.regexp_extract(_c(item), r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+", 0)
    return {"headline": F.trim(F.regexp_replace(line(1), r"^(?i)headline:", "")), "subtitle": line(2),
            "table_content": line(3), "url_link": F.when(url != "", url)}


# fixed value: the DNS namespace of name-based UUIDs (RFC 4122)
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(*cols, sep: str = "-") -> Column:
    """Name-based UUID (version 5) of the joined fields, without Python."""
    text = F.concat_ws(sep, *[_c(c).cast("string") for c in cols])
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_DNS)), F.encode(text, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"),
                    F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"),
                    F.substring(h, 21, 12))


def to_utc(ts, zone: str | None = None) -> Column:
    """Timestamp in UTC; text without a zone counts as UTC."""
    t = F.try_to_timestamp(_c(ts)) if zone is None else F.to_utc_timestamp(_c(ts), zone)
    return t


def event_ts(month_day, clock, page_month: str, today) -> Column:
    """'Jan 5' and '8:30am' to a timestamp; a next-month page may belong to the next year."""
    day = _c(today)
    year = F.year(day)
    if page_month != "this":
        following = F.add_months(F.date_trunc("month", day), 1)
        year = year + F.when(F.month(following) < F.month(day), 1).otherwise(0)
    text = F.concat_ws(" ", year.cast("string"), _c(month_day), F.upper(_c(clock)))
    return F.try_to_timestamp(text, F.lit("yyyy MMM d h:mma"))


def params_json(*cols: str) -> Column:
    return F.to_json(F.struct(*cols))


def clamp_bigint(x) -> Column:
    return F.when(_c(x) >= float(BIGINT_MAX), F.lit(BIGINT_MAX)).otherwise(_c(x).try_cast("long"))
