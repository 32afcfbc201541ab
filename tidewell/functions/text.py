"""Cleaning of strings, urls, prices and times.

Java's \\s, \\b and \\d are ASCII unless the pattern says (?U); all patterns on
user text do.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from functools import cache
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dictionaries as D


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def either(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


_ZEROS, _HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")


def unescape(t: str) -> str:
    """Character references decoded; numbers beyond Unicode, of any length, as U+FFFD."""
    return html.unescape(_HUGE.sub("\ufffd", _ZEROS.sub("&#", t)))


@F.arrow_udf(T.StringType())
def _unescape(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unescape(t) for t in texts.to_pylist()], pa.string())


def squeeze(c: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_string(c: Column, references: bool = True) -> Column:
    """STR-1.  `references`: decode character references, in Python, only where there is a '&'."""
    c = c.cast("string")
    if references:
        c = F.when(F.contains(c, F.lit("&")), _unescape(F.when(F.contains(c, F.lit("&")), c))).otherwise(c)
    return blank_to_null(squeeze(c))


def normalize_product_name(c: Column) -> Column:
    """STR-3: leading [tag], trailing '!', 'hit ' and the Korean brand word go."""
    c = F.regexp_replace(c, r"(?U)^\[[^\]]+\]\s*", "")
    c = squeeze(F.regexp_replace(c, r"!+$", ""))
    c = F.regexp_replace(c, r"(?iU)^hit\s+", "")
    return squeeze(F.regexp_replace(c, r"(?U)지포스\s*", ""))


def mall_code(c: Column) -> Column:
    """STR-5."""
    key = F.trim(c)
    codes = F.create_map(*[F.lit(x) for pair in D.MALL_CODES.items() for x in pair])
    return F.when(c != "", F.coalesce(F.try_element_at(codes, key), F.try_element_at(codes, F.upper(key)), F.upper(key)))


def seller_name(c: Column) -> Column:
    """STR-6."""
    return F.when(c != "", F.regexp_replace(c, r"(?U)\s+", ""))


def seller_slug(c: Column) -> Column:
    """STR-7: ASCII letters and digits, else a digest of the name."""
    plain = F.substring(F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", "")), 1, 32)
    return F.coalesce(blank_to_null(plain), F.upper(F.substring(F.sha1(c.cast("binary")), 1, 12)))


def model_slug(c: Column) -> Column:
    """STR-8."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"(?U)\s+", "_"), "[^a-z0-9_]", "")


def slug_token(c: Column) -> Column:
    """STR-9."""
    return F.regexp_replace(F.upper(c), "[^A-Za-z0-9]+", "")


def clean_url(url: str) -> str | None:
    """URL-1 for one url: scheme supplied, tracking parameters dropped, query encoded anew; None if it is malformed, so that its row is invalid."""
    url = url.strip()
    if url.startswith("//"):
        url = "https:" + url
    try:
        parts = urlsplit(url)
        if not parts.scheme:
            parts = urlsplit("https://" + url.lstrip("/"))
    except ValueError:
        return None
    query = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k not in D.TRACKING_KEYS]
    return urlunsplit(parts._replace(query=urlencode(query)))


@F.arrow_udf(T.StringType())
def _clean_urls(urls: pa.Array) -> pa.Array:
    return pa.array([clean_url(u) if u else None for u in urls.to_pylist()], pa.string())


def product_url(c: Column) -> Column:
    """URL-1.  A url with a scheme and no query needs no Python."""
    plain = F.rlike(c, F.lit(r"^https?://[^\s?#;\[\]]*$"))
    return F.when(plain, c).otherwise(_clean_urls(F.when(~plain, c)))


def product_url_native(c: Column, keys: tuple[str, ...] = D.TRACKING_KEYS) -> Column:
    """URL-1 without re-encoding, in SQL functions alone, for urls that are encoded already."""
    c = F.trim(c)
    c = F.when(F.startswith(c, F.lit("//")), F.concat(F.lit("https:"), c)).when(F.rlike(c, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), c).otherwise(
        F.concat(F.lit("https://"), F.regexp_replace(c, "^/+", ""))
    )
    head, query, tail = (F.regexp_extract(c, r"^([^?#]*)(?:\?([^#]*))?(#.*)?$", i) for i in (1, 2, 3))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*keys)), "&")
    return F.when(c.isNotNull(), F.concat(head, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), tail))


def image_url(c: Column) -> Column:
    """URL-2."""
    t = F.trim(c)
    return F.when(c != "", F.when(F.startswith(t, F.lit("//")), F.concat(F.lit("https:"), t)).otherwise(t))


def price_of_text(c: Column) -> Column:
    """NUM-1 for text: its digits, if over zero."""
    n = F.regexp_replace(c, "[^0-9]", "").try_cast("bigint")
    return F.when(n > 0, n)


@cache
def _other_digits() -> tuple[str, str]:
    """All decimal digits of other scripts, and their ASCII ones."""
    found = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)


def shown_price(c: Column) -> Column:
    """SRC-13: the decimal digits of a shown price, of any script, zero included; null without one, or beyond a bigint."""
    return F.regexp_replace(F.translate(c, *_other_digits()), "[^0-9]", "").try_cast("bigint")


def price_of_number(c: Column) -> Column:
    """NUM-1 for numbers: over zero, cut to whole."""
    return F.when(c > 0, c.try_cast("bigint"))


def price_of_variant(v: Column) -> Column:
    """NUM-1 for JSON values: numbers as numbers, texts by their digits, true and false as none."""
    kind = F.schema_of_variant(v)
    whole, number = F.try_variant_get(v, "$", "bigint"), F.try_variant_get(v, "$", "double")
    shown = F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    return (
        F.when(kind == "BIGINT", F.when(whole > 0, whole))
        .when(F.rlike(kind, F.lit("^(DECIMAL|DOUBLE|FLOAT)")), F.when(number > 0, F.least(number, F.lit(9e18)).cast("bigint")))
        .when(kind.isin("BOOLEAN", "VOID"), F.lit(None).cast("bigint")).otherwise(price_of_text(shown))
    )


def price_of(c: Column, kind: str) -> Column:
    return price_of_text(c) if kind == "string" else price_of_variant(c) if kind == "variant" else price_of_number(c)


def crawl_time(c: Column) -> Column:
    """DT-1: ISO date and time; null if it is none."""
    t = F.trim(c)
    return F.coalesce(t.try_cast("timestamp"), F.try_to_timestamp(t, F.lit("yyyyMMdd'T'HHmmss")))


def epoch_millis_id(ts: Column) -> Column:
    """DT-2."""
    return F.unix_millis(ts.cast("timestamp")).cast("string")


def job_id(mall: Column, started: Column) -> Column:
    """DT-3."""
    return F.concat_ws("_", mall, F.date_format(started, "yyyyMMdd_HHmmss"))


def joined_id(*parts: Column) -> Column:
    """ID-1, ID-2: null if any part is null or empty."""
    present = F.lit(True)
    for p in parts:
        present &= p.isNotNull() & (p != "")
    return F.when(present, F.concat_ws("_", *parts))


def lookup(c: Column, table: dict[str, str], default: str = "UNKNOWN") -> Column:
    """STR-12..15: a documented text's code."""
    codes = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, F.lower(F.trim(c))), F.lit(default))


def alias(c: Column, table: dict[str, str]) -> Column:
    """STR-10, STR-11: an alias's main name, any other name as it is."""
    codes = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, F.upper(F.trim(c))), c)


def shipping_fee(c: Column) -> Column:
    """STR-12: free is 0, text without a number unknown."""
    return F.when(F.contains(c, F.lit("무료")), F.lit(0).cast("bigint")).otherwise(F.regexp_replace(c, "[^0-9]", "").try_cast("bigint"))


def final_price(price: Column, fee: Column, discount: Column) -> Column:
    """NUM-4."""
    return price + F.coalesce(fee, F.lit(0)) - F.coalesce(discount, F.lit(0))


def should_retry(status: Column) -> Column:
    """SRC-5 over a column."""
    return F.when(status.isin(*D.NEVER_RETRY), False).otherwise(status.isin(*D.ALWAYS_RETRY) | (status >= 500))


def backoff(attempt: Column, delays: tuple[float, ...] = D.BACKOFF_SECONDS) -> Column:
    """SRC-6 over a column of attempt numbers from 0."""
    if not delays:
        return F.lit(0.0)
    found = F.array(*map(F.lit, delays))
    return F.coalesce(F.try_element_at(found, (attempt + 1).cast("int")), F.try_element_at(found, F.lit(-1)))


def search_url(base: str, keyword: Column) -> Column:
    """SRC-2."""
    return F.concat(F.lit(f"{base}?target=all&query="), F.url_encode(keyword))
