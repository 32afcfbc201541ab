"""Layouts as rows, sources chosen by the registry, and stored raw rows run again under other rules."""

import pytest
from pyspark.sql import functions as F

from tidewell.plans import listing, reprocess
from tidewell.sources import files, layouts

A = """<ul><li class="item big" data-id="1" data-cost="1,000"><a class="go" href="/p/1"><b class="t">RTX <i>5080</i></b></a><img src="//i/1.jpg"><span class="shop">S1</span></li>
<li class="item" data-id="2"><b class="t">Two<br></b><b class="t">not this</b><em>9 won</em><li class="item" data-id="3"><b class="t">Three</b></li><li class="item"><b class="t">no id</b></li></ul>"""
B = """<div id=x><article sku="b1"><h3>Card &amp; co</h3><p>12,000</p><article sku="b2"><h3>Inner</h3></article><footer>shop B</footer></article><input class=u sku=b3><h3>outside</h3></div>"""
LAYOUTS = [
    ("a", "unit", "li", "item", None), ("a", "product_id", None, "item", "data-id"), ("a", "product_name", None, "t", None), ("a", "product_url", "a", "go", "href"),
    ("a", "image_url", "img", None, "src"), ("a", "seller", None, "shop", None), ("a", "price_text", "li", None, "data-cost"), ("a", "price_text", "em", None, None),
    ("b", "unit", "article", None, None), ("b", "product_id", "article", None, "sku"), ("b", "product_name", "h3", None, None), ("b", "price_text", "p", None, None), ("b", "seller", "footer", None, None),
    ("off", "unit", "li", None, None), ("off", "product_id", "li", None, "data-id"), ("off", "product_name", "b", None, None),
]
REGISTRY = [("a", True, "html", 2), ("b", True, "html", 1), ("off", False, "html", 0), ("api", True, "api", 0), ("bare", True, "html", 3)]


@pytest.fixture
def tables(spark):
    return spark.createDataFrame(REGISTRY, layouts.REGISTRY), spark.createDataFrame(LAYOUTS, layouts.LAYOUT)


def test_two_layouts(spark, tables):
    pages = spark.createDataFrame([("a", "p1", A, "t1"), ("b", "p2", B, "t2"), ("off", "p3", A, "t"), ("api", "p4", A, "t"), ("bare", "p5", A, "t"), ("a", "p6", None, "t"), (None, "p7", A, "t")], "source string, page string, html string, crawled_at string")
    got = sorted(tuple(r) for r in layouts.read_pages(pages, *tables).drop("priority").collect())
    assert got == [
        ("a", "p1", "t1", 0, "1", "RTX5080", "1,000", "S1", "/p/1", "//i/1.jpg"), ("a", "p1", "t1", 1, "2", "Two", "9 won", None, None, None), ("a", "p1", "t1", 2, "3", "Three", None, None, None, None),
        ("b", "p2", "t2", 0, "b1", "Card & co", "12,000", "shop B", None, None), ("b", "p2", "t2", 1, "b2", "Inner", None, None, None, None),
    ]


def test_an_enabled_source_is_a_row(spark, tables):
    registry, rows = tables
    assert [r.source for r in layouts.sources(registry, rows).orderBy("priority").collect()] == ["b", "a"]
    on = registry.withColumn("enabled", F.lit(True))
    pages = spark.createDataFrame([("off", "p", A, "t")], "source string, page string, html string, crawled_at string")
    assert [r.product_name for r in layouts.read_pages(pages, on, rows).orderBy("position").collect()] == ["RTX 5080".replace(" ", ""), "Two", "Three"]
    assert layouts.read_pages(pages.limit(0), on, rows).isEmpty() and layouts.read_pages(pages, on, rows.limit(0)).isEmpty()


@pytest.mark.parametrize("html", ["<li class=item data-id=1><b class=t>x" * 3000, "<li class=item data-id=1>" + "<b class=t>" * 5000, "</b>" * 5000 + A, "<" * 5000, ""])
def test_broken_pages_end(html):
    list(layouts.read_units(html, [r[1:] for r in LAYOUTS if r[0] == "a"]))


# ---- reprocessing --------------------------------------------------------------
GOOD = dict(mall="SSG", product_name="HIT ZOTAC GAMING RTX 5080 SOLID CORE 16GB", price="2,429,000", seller="s", product_url="//www.ssg.com/i?itemId=1", crawled_at="2026-08-19T10:00:00Z")
RAW = [
    GOOD | {"seq": 1, "product_id": "1"}, GOOD | {"seq": 2, "product_id": "2", "product_name": "RTX 5080 laptop 16GB ASUS"}, GOOD | {"seq": 3, "product_id": "3", "price": "none"},
    GOOD | {"seq": 4, "product_id": "4", "crawled_at": "2026-08-21T10:00:00Z"}, GOOD | {"seq": 5, "product_id": "5", "mall": "11번가", "product_name": "keyboard"},
]


def strict(raw):
    """Rules that tell laptops from cards and take a missing price as the least one."""
    rows = listing.process(raw)
    laptop = F.contains(F.upper("raw_product_name"), F.lit("LAPTOP"))
    rows = rows.withColumn("error", F.when(F.col("error").isNull() & laptop, listing.error("FILTERED", "gpu", "not a card")).otherwise(F.col("error")))
    no_price = F.col("error")["field"] == "price"
    return rows.withColumns({"price": F.when(no_price, 1).otherwise(F.col("price")), "error": F.when(no_price, None).otherwise(F.col("error"))})


@pytest.fixture(scope="module")
def raw_folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "raw")
    names = [c.split()[0] for c in listing.RAW.split(", ")]
    files.write_raw(spark.createDataFrame([tuple(r.get(n) for n in names) for r in RAW], listing.RAW), path)
    return path


def test_two_versions_of_the_rules(spark, raw_folder, tmp_path):
    raw = reprocess.read_raw(spark, raw_folder)
    one, two = reprocess.run(raw, "1"), reprocess.run(raw, "2", strict)
    assert {(r.rules_version, r.status) for r in reprocess.outcomes(one).where("seq IN (1, 3)").collect()} == {("1", "VALID"), ("1", "INVALID")}
    feed = reprocess.difference(reprocess.outcomes(one), reprocess.outcomes(two))
    got = {r.seq: (r.change, r.changed, r.old.status, r.new.status) for r in feed.collect()}
    assert got == {2: ("CHANGED", ["status", "field"], "VALID", "FILTERED"), 3: ("CHANGED", ["status", "field", "price"], "INVALID", "VALID")}
    assert {r.move: r.rows for r in reprocess.moved(feed).collect()} == {"VALID -> FILTERED": 1, "INVALID -> VALID": 1}
    for version in (one, two, two):  # a repeated run changes nothing
        reprocess.write(version, str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert {r.rules_version: r["count"] for r in stored.groupBy("rules_version").count().collect()} == {1: 5, 2: 5}


def test_a_run_reads_the_folders_it_is_asked_for(spark, raw_folder):
    some = reprocess.read_raw(spark, raw_folder, ["SSG"], "2026-08-20", "2026-08-31")
    assert [r.seq for r in some.collect()] == [4]
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "crawl_date" in plan.split("PartitionFilters: [")[1].split("]")[0] and "mall" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert reprocess.read_raw(spark, raw_folder, []).isEmpty()
