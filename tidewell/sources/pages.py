"""Product units of search-result pages."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import shown_price

UNIT = T.StructType([T.StructField(n, T.StringType()) for n in ("product_id", "product_name", "price_text", "seller", "product_url", "image_url")])
# The classes of a page's elements and what they hold.
UNIT_CLASS = "ssgitem_unit"
TEXTS = {"ssgitem_tit_name": "product_name", "ssgitem_tit_brand": "seller"}
LINKS = {"ssgitem_info": ("href", "product_url"), "ssgitem_thmb_img": ("src", "image_url")}
ID, PRICE = "data-react-unit-id", "data-react-unit-price"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Units(HTMLParser):
    """Collects a record for each element of the unit class, the first of each part counting."""

    def __init__(self) -> None:
        super().__init__()
        self.depth, self.found = 0, []
        self.open: list[tuple[int, dict]] = []
        self.reading: tuple[int, str, dict] | None = None

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        values = {k: v or "" for k, v in attributes}
        classes = values.get("class", "").split()
        if tag not in VOID:
            self.depth += 1
        if UNIT_CLASS in classes:
            unit = {"product_id": values.get(ID), "price_text": values.get(PRICE), "parts": {}}
            self.found.append(unit)
            if tag not in VOID:
                self.open.append((self.depth, unit))
        if not self.open:
            return
        parts = self.open[-1][1]["parts"]
        for c in classes:
            if c in LINKS and LINKS[c][1] not in parts:
                parts[LINKS[c][1]] = values.get(LINKS[c][0])
            if c in TEXTS and TEXTS[c] not in parts and tag not in VOID:
                parts[TEXTS[c]] = []
                self.reading = (self.depth, TEXTS[c], parts)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if self.reading and self.reading[0] == self.depth:
            self.reading = None
        if self.open and self.open[-1][0] == self.depth:
            self.open.pop()
        self.depth -= 1

    def handle_data(self, data: str) -> None:
        if self.reading:
            self.reading[2][self.reading[1]].append(data.strip())


def parse_units(page: str) -> list[dict]:
    """SRC-8, SRC-9: units with an id and a name."""
    reader = _Units()
    reader.feed(page)
    reader.close()
    found = []
    for unit in reader.found:
        parts = {k: "".join(v) if isinstance(v, list) else v for k, v in unit["parts"].items()}
        if unit["product_id"] and parts.get("product_name"):
            row = {"product_id": unit["product_id"], "price_text": unit["price_text"]} | parts
            found.append({f: row.get(f) or None for f in UNIT.names})
    return found


@F.arrow_udf(T.ArrayType(UNIT))
def units(pages: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([(n, pa.string()) for n in UNIT.names]))
    return pa.array([parse_units(p) if p else [] for p in pages.to_pylist()], kind)


def parse_ssg(pages: DataFrame) -> DataFrame:
    """pages (html, crawled_at) -> raw listings; all rows of a page share its time."""
    rows = pages.select("crawled_at", F.posexplode(units("html")).alias("position", "u"))
    # SRC-12: the attribute's number, else its digits
    price = F.coalesce(F.trim("u.price_text").try_cast("bigint"), shown_price(F.col("u.price_text")))
    return rows.select(
        F.lit("SSG").alias("mall"), "position", "u.product_id", "u.product_name", price.alias("price"), "u.seller", "u.product_url", "u.image_url", "crawled_at"
    )


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"SSG": parse_ssg}


def parse_pages(mall: str, pages: DataFrame) -> DataFrame:
    """SRC-11: by the mall's parser."""
    if mall.upper() not in PARSERS:
        raise ValueError(f"no parser for mall {mall!r}")
    return PARSERS[mall.upper()](pages)


def first_product(pages: DataFrame, mall: str = "SSG") -> DataFrame:
    """SRC-10: each page's first product."""
    return parse_pages(mall, pages).where(F.col("position") == 0)
