"""Numeric guards and formats (plain column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
VOLUME_LIMIT = 999_999_999.0
STORE_VOLUME_LIMIT = 99_999_999.0
BIGINT_MAX = 9_223_372_036_854_775_807


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_numeric(c, default: float = 0.0) -> Column:
    """NULL, NaN and the infinities become ``default``."""
    c = _c(c)
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(c)


def store_volume(c) -> Column:
    """Volume as the result store takes it: upper clamp, then the store's own range."""
    return F.greatest(F.lit(0.0), F.least(F.least(safe_numeric(c), F.lit(VOLUME_LIMIT)),
                                          F.lit(STORE_VOLUME_LIMIT)))


def safe_float(c, default: float | None = None) -> Column:
    return F.coalesce(_c(c).try_cast("double"), F.lit(default))


def safe_int(c, default: int | None = None) -> Column:
    return F.coalesce(_c(c).try_cast("double").try_cast("long"), F.lit(default))


def bigint_or_null(c) -> Column:
    """Number clamped to the bigint maximum; unreadable text becomes NULL."""
    x = _c(c).try_cast("double")
    return F.when(x >= float(BIGINT_MAX), F.lit(BIGINT_MAX)).otherwise(x.try_cast("long"))


def pct(a, b) -> Column:
    """Change from b to a in percent."""
    return (F.try_divide(_c(a), _c(b)) - 1) * 100


def share_pct(part, whole) -> Column:
    return F.try_divide(_c(part), _c(whole)) * 100


def ratio_of_ratios(a, b, c, d) -> Column:
    return F.try_divide(F.try_divide(_c(a), _c(b)), F.try_divide(_c(c), _c(d)))


def prev_close(price, change_pct) -> Column:
    """Previous close implied by a percent change; the price itself if the change is 0."""
    price, change_pct = _c(price), _c(change_pct)
    return F.when(change_pct != 0, F.try_divide(price, 1 + change_pct / 100)).otherwise(price)


def pct_change_from_close(price, close) -> Column:
    price, close = _c(price), _c(close)
    return F.when(close > 0, F.try_divide(price - close, close) * 100).otherwise(F.lit(0.0))


def format_large(c) -> Column:
    """1.2T / 3.4B / 5.6M / 7.8K text."""
    x = _c(c)
    return (F.when(x >= 1e12, F.format_string("%.2fT", x / 1e12))
            .when(x >= 1e9, F.format_string("%.2fB", x / 1e9))
            .when(x >= 1e6, F.format_string("%.2fM", x / 1e6))
            .when(x >= 1e3, F.format_string("%.2fK", x / 1e3))
            .otherwise(F.format_string("%.2f", x)))


def format_large_usd(c) -> Column:
    """$1.2T / $3.4B / $5.6M, whole dollars below."""
    x = _c(c)
    return (F.when(x >= 1e12, F.format_string("$%.1fT", x / 1e12))
            .when(x >= 1e9, F.format_string("$%.1fB", x / 1e9))
            .when(x >= 1e6, F.format_string("$%.1fM", x / 1e6))
            .otherwise(F.format_string("$%.0f", x)))


def truncate(c, n: int, ellipsis: bool = False) -> Column:
    c = _c(c)
    if not ellipsis:
        return F.substring(c, 1, n)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 3), F.lit("...")))


def season(alt_share) -> Column:
    """Season name from the share in percent held by everything but the leading asset."""
    s = _c(alt_share)
    return F.when(s > 75, "Altcoin Season").when(s < 25, "Bitcoin Season").otherwise("Neutral")


def ratio_level(ratio) -> Column:
    r = _c(ratio)
    return F.when(r > 0.15, "high").when(r < 0.10, "low").otherwise("normal")


def trend_label(direction) -> Column:
    d = F.lower(_c(direction))
    return F.when(d == "up", "BULLISH").when(d == "down", "BEARISH").otherwise("NEUTRAL")
