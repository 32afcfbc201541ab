"""Page layouts as rows of a table, read by one table function: a new mall is rows, not code.

A layout row says where a field of a source is found: `unit` marks the element
that holds one listing, any other field is the text of the element, or the
value of its attribute, that the row names by tag and class (null: any).
Several rows of one field are alternatives; of all elements that fit inside a unit
the first of the page counts.  Which sources are read, and in which order,
tells the registry (source, enabled, type, priority).

Defined results: units without an id or name are none; a unit inside a unit is
one of its own and the outer one's text goes on behind it; pages of a source
that is not enabled, or has no layout, give nothing; a null page has no units.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pages import VOID

LAYOUT = "source string, field string, tag string, class string, attribute string"
REGISTRY = "source string, enabled boolean, type string, priority int"
FIELDS = ("product_id", "product_name", "price_text", "seller", "product_url", "image_url")
UNITS = "source string, page string, position int, " + ", ".join(f"{f} string" for f in FIELDS)


class _Reader(HTMLParser):
    """The units of a page by the rules of its layout: (field, tag, class, attribute)."""

    def __init__(self, rules: list[tuple[str, str | None, str | None, str | None]]):
        super().__init__()
        self.units = [r for r in rules if r[0] == "unit"]
        self.rules = [r for r in rules if r[0] in FIELDS]
        self.path: list[str] = []
        self.found: list[dict] = []
        self.open: list[tuple[int, dict]] = []  # depth of a unit's element, the unit
        self.reading: list[tuple[int, str, dict]] = []  # depth of a field's element, the field, its unit

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        values = {k: v or "" for k, v in attributes}
        classes = values.get("class", "").split()
        fits = lambda rule: rule[1] in (None, tag) and (rule[2] is None or rule[2] in classes)
        if tag not in VOID:
            self.path.append(tag)
        if any(map(fits, self.units)):
            unit: dict = {}
            self.found.append(unit)
            if tag not in VOID:
                self.open.append((len(self.path), unit))
            else:  # an element without content still has attributes
                self._take(unit, values, fits, tag)
        if self.open:
            self._take(self.open[-1][1], values, fits, tag)

    def _take(self, unit: dict, values: dict, fits, tag: str) -> None:
        for rule in filter(fits, self.rules):
            field, attribute = rule[0], rule[3]
            if field in unit:
                continue
            if attribute is not None:
                if values.get(attribute):
                    unit[field] = values[attribute]
            elif tag not in VOID:
                unit[field] = []
                self.reading.append((len(self.path), field, unit))

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.path:
            return
        while self.path:  # elements that were left open end with this one
            depth, last = len(self.path), self.path.pop()
            self.reading = [r for r in self.reading if r[0] != depth]
            self.open = [o for o in self.open if o[0] != depth]
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        for _, field, unit in self.reading:
            unit[field].append(data.strip())


def read_units(html: str, rules: list[tuple]) -> Iterator[dict]:
    reader = _Reader(rules)
    reader.feed(html)
    reader.close()
    for unit in reader.found:
        row = {f: "".join(v) if isinstance(v := unit.get(f), list) else v for f in FIELDS}
        if row["product_id"] and row["product_name"]:
            yield {f: v or None for f, v in row.items()}


@F.udtf(returnType="position int, " + ", ".join(f"{f} string" for f in FIELDS))
class Units:
    """(html, layout) -> its units; layout is an array of (field, tag, class, attribute)."""

    def eval(self, html: str | None, layout: list) -> Iterator[tuple]:
        rules = [(r["field"], r["tag"], r["class"], r["attribute"]) for r in layout or []]
        for position, unit in enumerate(read_units(html or "", rules)):
            yield (position, *unit.values())


def sources(registry: DataFrame, layouts: DataFrame, kind: str = "html") -> DataFrame:
    """(source, priority, layout) of the enabled sources of a kind that have a layout; a row a source."""
    held = layouts.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("field", "tag", "class", "attribute"))).alias("layout"))  # a few rows each
    return registry.where(F.col("enabled") & (F.col("type") == kind)).select("source", "priority").join(held, "source")


def read_pages(pages: DataFrame, registry: DataFrame, layouts: DataFrame, page: str = "page", kept: tuple[str, ...] = ("crawled_at",)) -> DataFrame:
    """Raw listings of pages (source, page id, html, kept columns): every unit of the enabled sources, with its place in the page."""
    known = pages.join(sources(registry, layouts), "source").select("source", "priority", F.col(page), *kept, "html", "layout")
    return known.lateralJoin(Units(F.col("html").outer(), F.col("layout").outer())).drop("html", "layout")
