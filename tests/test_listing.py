"""Golden rows of the cleaning, extraction, identity and validation chain."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions import gpu, text
from tidewell.operators import history
from tidewell.plans import listing


@pytest.fixture(scope="module")
def process(spark):
    def run(**given):
        row = dict(
            seq=1, mall="SSG", product_id="1", product_name="HIT ZOTAC GAMING 지포스 RTX 5080 SOLID CORE OC D7 16GB", price="2,429,000원", seller="히트정보",
            product_url="https://www.ssg.com/item/itemView.ssg?itemId=1&click=itemMidArea02", image_url="//img.example.com/1.jpg", crawled_at="2026-08-19T10:00:00+00:00",
        ) | given
        names = [c.split()[0] for c in listing.RAW.split(", ")]
        return listing.process(spark.createDataFrame([tuple(row.get(n) for n in names)], listing.RAW)).first()

    return run


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_a_whole_listing(process):
    r = process()
    assert r.error is None and (r.brand, r.gpu_series, r.gpu_model, r.gpu_model_id, r.vram_gb) == ("ZOTAC", "RTX", "RTX 5080", "rtx_5080", 16)
    assert r.canonical_product_id == "ZOTAC-RTX5080-SOLIDCORE-16GB" and r.seller_id == "SSG_48DAC5EF21D9" and r.price == 2429000
    assert r.normalized_product_name == "ZOTAC GAMING RTX 5080 SOLID CORE OC D7 16GB"
    assert r.product_url == "https://www.ssg.com/item/itemView.ssg?itemId=1" and r.image_url == "https://img.example.com/1.jpg"


@pytest.mark.parametrize(
    "given, status, field",
    [
        ({"price": "0"}, "INVALID", "price"), ({"product_id": None}, "INVALID", "product_id"), ({"product_name": "일반 키보드"}, "FILTERED", "gpu"),
        ({"product_name": "RTX 5080D 16GB"}, "INVALID", "gpu"), ({"product_name": "SAPPHIRE RX-7900XTX 24GB"}, "INVALID", "gpu"), ({"product_name": "  "}, "INVALID", "product_name"),
        ({"price": "999999999"}, "INVALID", "price"),
    ],
)
def test_first_failure(process, given, status, field):
    e = process(**given).error
    assert (e.status, e.field) == (status, field)


@pytest.mark.parametrize(
    "name, model, memory",
    [
        ("MSI 지포스 RTX 4070 SUPER 12GB", "RTX 4070 SUPER", 12), ("RX 7900 XTX 24GB", "RX 7900 XTX", 24), ("RTX 5070 Ti SUPER 16G", "RTX 5070 TI", 16),
        ("RTX5080 16기가", "RTX 5080", 16), ("hit  arc b580 12GB", "Arc B580", 12), ("일반 USB 케이블 1m", None, None),
    ],
)
def test_extraction(spark, name, model, memory):
    found = one(spark, name, lambda c: gpu.model(text.normalize_product_name(c)))
    assert (found and found.model) == model and one(spark, name, gpu.memory_gb) == memory


@pytest.mark.parametrize("price, want", [("2,429,000원", 2429000), ("₩2,429,000", 2429000), ("2.429.000", 2429000), ("-100", 100), ("none", None), ("0", None)])
def test_prices(spark, price, want):
    assert one(spark, price, text.price_of_text) == want


def test_small_texts(spark):
    assert one(spark, "[특가] X!!!", text.normalize_product_name) == "X"
    assert [one(spark, m, text.mall_code) for m in ("신세계몰", "11번가", "foo")] == ["SSG", "ELEVENST", "FOO"]
    assert one(spark, "/item/itemView.ssg?itemId=1", text.product_url) == "https://item/itemView.ssg?itemId=1"


@pytest.mark.parametrize(
    "observed, stored",
    [
        ([(1, 100000)], [(1, 100000, None)]), ([(1, 100000), (1, 100000)], [(1, 100000, None)]), ([(1, 100000), (2, 110000), (3, 110000)], [(1, 100000, None), (2, 110000, 100000)]),
        ([(10, 100), (30, 110), (20, 105), (40, 110)], [(10, 100, None), (20, 105, 110), (30, 110, 100)]),
    ],
)
def test_price_history(spark, observed, stored):
    rows = spark.createDataFrame([("x", i, t, p) for i, (t, p) in enumerate(observed)], "listing_id string, seq bigint, at_ms bigint, price bigint")
    empty = spark.createDataFrame([], "listing_id string, at_ms bigint, history_id string, seq bigint, price bigint, previous_price bigint, price_change bigint")
    got = history.merge_history(empty, history.replay(rows, empty)).orderBy("at_ms").collect()
    assert [(r.at_ms, r.price, r.previous_price) for r in got] == stored
