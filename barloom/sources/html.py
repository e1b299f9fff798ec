"""Rows of HTML tables and lists as Spark rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: entities in texts, the ampersand last
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
HEADER_WORDS = ("rank", "company", "market cap", "price", "name", "symbol", "ticker")


def strip_tags(html: Column) -> Column:
    """Text of a fragment: tags out, entities decoded, white space squeezed."""
    out = F.regexp_replace(html, r"<[^>]*>", "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def table_rows(pages: DataFrame, html: str = "html", key: str = "page_id", row_tag: str = "tr",
               cell_tag: str = "t[dh]", least: int = 4, skip_header: bool = True) -> DataFrame:
    """One row per ``row_tag`` with its cell texts and sort attributes.

    Pages are independent, so the work is a projection over them: whole texts, no
    shuffle.  The tags are parameters because not every source is a table.
    """
    rows = F.regexp_extract_all(html, F.lit(rf"(?is)<{row_tag}\b[^>]*>(.*?)</{row_tag}>"), F.lit(1))
    df = pages.select(key, F.posexplode(rows).alias("row_no", "_row"))
    cell = rf"(?is)(<{cell_tag}\b[^>]*>.*?</{cell_tag}>)"
    raw = F.regexp_extract_all("_row", F.lit(cell), F.lit(1))
    df = df.withColumn("_cells", raw).filter(F.size("_cells") >= least)
    attr = r"(?is)^<[^>]*\bdata-sort=[\"']([^\"']*)[\"']"
    mark = r"(?is)\bclass=[\"']([^\"']*)[\"']"
    df = df.withColumns({
        "cells": F.transform("_cells", strip_tags),
        "attrs": F.transform("_cells", lambda c: F.nullif(F.regexp_extract(c, attr, 1), F.lit(""))),
        "classes": F.transform("_cells", lambda c: F.array_join(
            F.regexp_extract_all(c, F.lit(mark), F.lit(1)), " "))})
    df = df.withColumn("row_text", F.array_join("cells", " "))
    if skip_header:
        first = F.lower(F.array_join(F.slice("cells", 1, 4), " "))
        df = df.filter((F.col("row_no") > 0) | ~first.rlike("|".join(HEADER_WORDS)))
    return df.drop("_row", "_cells")


def list_items(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Linked list items of a page: position, address and text."""
    items = F.regexp_extract_all(html, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))
    df = pages.select(key, F.posexplode(items).alias("row_no", "_i"))
    return df.select(key, "row_no", F.regexp_extract("_i", r"href=\"([^\"]*)\"", 1).alias("href"),
                     strip_tags(F.col("_i")).alias("item_text"))


def company_rows(rows: DataFrame) -> DataFrame:
    """Cells of a company table to typed columns (name, ticker, cap, price, change)."""
    from ..functions.text import name_and_ticker, normalize_text, parse_money, parse_price, signed_change
    c = F.col("cells")

    def cell(n):
        return F.coalesce(F.try_element_at(c, F.lit(n + 1)), F.lit(""))
    name, ticker = name_and_ticker(cell(2))
    cap = F.when(cell(3).rlike(r"\$[\d,]+\.?\d*\s*[TMB]"), cell(3)).otherwise("")
    price = F.when(cell(4).rlike(r"\$[\d,]+\.?\d*$"), cell(4)).otherwise("")
    return rows.withColumns({
        "name": normalize_text(name), "ticker": ticker, "market_cap": cap, "market_cap_raw": parse_money(cap),
        "price": price, "price_raw": parse_price(price),
        "today": signed_change(cell(5), F.try_element_at(F.col("classes"), F.lit(6)))})


def lending_cards(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Asset cards (heading plus paragraphs) of a lending page, first card per asset."""
    from ..operators.assets import distinct_first
    cards = F.regexp_extract_all(html, F.lit(r"(?is)(<h4\b.*?)(?=<h4\b|$)"), F.lit(1))
    df = pages.select(key, F.posexplode(cards).alias("row_no", "_c"))
    apy = F.regexp_extract_all("_c", F.lit(r"(?is)<p\b[^>]*data-cy=[\"']apy[\"'][^>]*>(.*?)</p>"), F.lit(1))
    none = F.lit("N/A")

    def total(label: str) -> Column:
        text = F.regexp_extract("_c", rf"(?is)>\s*{label}\s*<.*?<p\b[^>]*>(.*?)</p>", 1)
        return F.coalesce(F.nullif(strip_tags(text), F.lit("")), none)
    out = df.select(
        key, "row_no", strip_tags(F.regexp_extract("_c", r"(?is)<h4\b[^>]*>(.*?)</h4>", 1)).alias("asset_name"),
        total("Total supplied").alias("total_supplied"),
        F.coalesce(strip_tags(F.try_element_at(apy, F.lit(1))), none).alias("supply_apy"),
        total("Total borrowed").alias("total_borrowed"),
        F.coalesce(strip_tags(F.try_element_at(apy, F.lit(2))), none).alias("borrow_apy"))
    known = [F.nullif(F.col(c), none) for c in ("total_supplied", "supply_apy", "total_borrowed", "borrow_apy")]
    return distinct_first(out.filter(F.coalesce(*known).isNotNull()), (key, "asset_name"))
