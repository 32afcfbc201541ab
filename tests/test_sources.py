"""Files, pages and searches; exact urls and prices against plain Python."""

import http.server
import json
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from tidewell.functions import dictionaries as D
from tidewell.functions import gpu, text
from tidewell.plans import listing
from tidewell.sources import files, pages, search

UNIT = """<li><div class="x ssgitem_unit" data-react-unit-id="{id}" data-react-unit-price="{price}"><a class="ssgitem_info" href="//www.ssg.com/i?itemId={id}">
<img class="ssgitem_thmb_img" src="//img/{id}.jpg"><em class="ssgitem_tit_brand"> {seller} </em><p class="ssgitem_tit_name">{name}</p></a></div></li>"""
PAGE = "<ul>" + "".join(
    UNIT.format(id=i, price=p, seller=s, name=n) for i, p, s, n in (("10", "2429000", "히트정보", "RTX <b>5080</b> &amp; more"), ("11", "1,234원", "", "RTX 5070"), ("", "5", "x", "no id"), ("12", "", "y", " "), ("13", "none", "y", "z"))
) + "</ul>"


def test_pages(spark):
    df = spark.createDataFrame([(PAGE, "2026-08-19T10:00:00Z"), ("<p>none", "t"), (None, "t")], "html string, crawled_at string")
    got = pages.parse_pages("ssg", df).orderBy("position").collect()
    assert [(r.position, r.product_id, r.product_name, r.price, r.seller, r.crawled_at[:4]) for r in got] == [
        (0, "10", "RTX5080& more", 2429000, "히트정보", "2026"), (1, "11", "RTX 5070", 1234, None, "2026"), (2, "13", "z", None, "y", "2026"),
    ]
    assert got[0].product_url == "//www.ssg.com/i?itemId=10" and got[0].image_url == "//img/10.jpg" and got[0].mall == "SSG"
    assert [r.product_id for r in pages.first_product(df).collect()] == ["10"]
    with pytest.raises(ValueError):
        pages.parse_pages("elsewhere", df)


def answers(*given):
    given = list(given)

    def opener(url, timeout):
        found = given.pop(0)
        if isinstance(found, Exception):
            raise found
        return found, "body", url

    return opener


@pytest.mark.parametrize(
    "given, result, slept",
    [
        ((200,), "body", []), ((500, 200), "body", [1.0]), ((429, TimeoutError(), 200), "body", [1.0, 2.0]), ((404,), "HTTPError", []), ((302,), "HTTPError", []),
        ((503,) * 4, "RetryExhausted", [1.0, 2.0, 4.0]), ((TimeoutError(),) * 4, "Timeout", [1.0, 2.0, 4.0]), ((OSError("no route"),) * 4, "RetryExhausted", [1.0, 2.0, 4.0]),
    ],
)
def test_fetch(given, result, slept):
    waits = []
    try:
        got = search.fetch("http://x", opener=answers(*given), sleep=waits.append)[1]
    except search.FetchError as e:
        got = e.kind
    assert (got, waits) == (result, slept)


def test_search_source(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            query = urllib.parse.parse_qs(urllib.parse.urlsplit(self.path).query)
            body = PAGE.encode()
            self.send_response(404 if query["query"] == ["nothing"] else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(search.MallSearch)
    found = spark.read.format("mall_search").option("base_url", f"http://127.0.0.1:{server.server_port}/s").option("keywords", "rtx 5080,nothing").load()
    got = {r.keyword: r for r in found.collect()}
    server.shutdown()
    assert got["rtx 5080"].status_code == 200 and got["rtx 5080"].html == PAGE and got["rtx 5080"].url.endswith("?target=all&query=rtx+5080")
    assert got["nothing"].status_code == 404 and got["nothing"].html is None and "HTTPError" in got["nothing"].error


PRICES = [2429000, 2429000.0, 1234.5, 0.5, -100, -1.5, 0, True, False, None, "2,429,000원", "-100", "none", "", 10**25, 1e300, [1, 2], "2429000.0"]


def plain_price(v):
    if v is None or isinstance(v, bool):
        return None
    if isinstance(v, (int, float)):
        return min(int(v), 9 * 10**18) if v > 0 else None
    digits = "".join(c for c in (v if isinstance(v, str) else json.dumps(v)) if c in "0123456789")
    return int(digits) if digits and int(digits) > 0 else None


def test_prices_keep_their_json_kind(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"seq": i, "price": p, "unknown": 1}) for i, p in enumerate(PRICES)))
    rows = files.read_json(spark, str(tmp_path))
    got = {r.seq: r.price for r in rows.select("seq", text.price_of(F.col("price"), "variant").alias("price")).collect()}
    assert got == {i: plain_price(p) for i, p in enumerate(PRICES)}
    errors = {r.seq: r.error for r in listing.process(rows.withColumns({c: F.lit("x") for c in ("product_id", "product_name", "mall", "product_url")})).collect()}
    assert (errors[3].field, errors[3].message) == ("price", "price must be > 0")  # 0.5 is a price of 0
    assert errors[9].message == "price is required" and errors[15].message.startswith("price exceeds") and errors[0].field == "gpu"


def test_json_answers(spark):
    body = json.dumps([{"seq": 1, "product_id": "7", "price": 99.0}, {"product_id": "8", "price": "1,000"}])
    got = files.json_listings(spark.createDataFrame([(body,), (None,), ("not json",)], "body string"))
    got = got.select("product_id", text.price_of(F.col("price"), "variant").alias("price")).where("product_id IS NOT NULL").collect()
    assert [(r.product_id, r.price) for r in got] == [("7", 99), ("8", 1000)]


def test_csv_and_raw_folders(spark, tmp_path):
    (tmp_path / "in.csv").write_text("source,original_product_name,original_price,seller,url,collected_at\nSSG,ZOTAC RTX 5080 16GB,\"2,429,000\",s,//u?a=1,2026-08-19T10:00:00Z\n", encoding="utf-8")
    raw = files.read_csv(spark, str(tmp_path / "in.csv"))
    assert raw.first().price == "2,429,000" and raw.first().mall == "SSG"
    whole = raw.select(F.lit(1).alias("seq"), "*", *[F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in listing.RAW.split(", ")) if c not in (*raw.columns, "seq")])
    valid, _ = listing.split(listing.process(whole.withColumn("product_id", F.lit("1"))))
    files.write_csv(valid, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().price == "2429000"
    files.write_raw(raw, str(tmp_path / "raw"))
    files.write_raw(raw, str(tmp_path / "raw"))
    again = spark.read.json(str(tmp_path / "raw")).where("mall = 'SSG' AND crawl_date = DATE '2026-08-19'")
    assert again.count() == 2 and "PartitionFilters: [isnotnull(mall" in again._jdf.queryExecution().toString()


def test_enabled_sources(spark):
    rows = spark.createDataFrame([("b", True, 2), ("a", True, 1), ("c", False, 0)], "source string, enabled boolean, priority int")
    assert [r.source for r in files.enabled_sources(rows).collect()] == ["a", "b"]


def plain_url(url):
    url = url.strip()
    url = "https:" + url if url.startswith("//") else url
    try:
        parts = urllib.parse.urlsplit(url)
        parts = parts if parts.scheme else urllib.parse.urlsplit("https://" + url.lstrip("/"))
    except ValueError:
        return None
    kept = [(k, v) for k, v in urllib.parse.parse_qsl(parts.query, keep_blank_values=True) if k not in D.TRACKING_KEYS]
    return urllib.parse.urlunsplit((*parts[:3], urllib.parse.urlencode(kept), parts.fragment))


URLS = ["http://[bad", "//a.b/c?x=1&click=2", "a.b/c", "/p?q", "https://a.b", "https://a.b/?q=한글&siteNo=1#f", "http://a/b;c?d=e f", "https://a.b/x?k=&taste=1&k=2", " https://a.b/c ", "mailto:x@y", "https://[::1]/x?a=%20"]


def test_urls(spark):
    got = spark.createDataFrame([(u,) for u in [*URLS, None, ""]], "u string").select(text.product_url(F.col("u")).alias("r")).collect()
    assert [r.r for r in got] == [plain_url(u) for u in URLS] + [None, None]


def test_references_of_any_length(spark):
    got = spark.createDataFrame([("&#" + "9" * 9000 + ";&#" + "0" * 9000 + "65; &amp;  b",)], "t string").select(text.clean_string(F.col("t")).alias("r")).first().r
    assert got == "�A & b"


@pytest.mark.parametrize(
    "mpn, model, brand, chip, memory, name, want",
    [
        ("zt-b50800j 10p", "m", "b", "c", 8, "n", "ZTB50800J10P"), (None, "ZT b508", "b", "c", 8, "n", "ZTB508"), ("", "--", "Zotac", "RTX 5080", 16, "solid core", "ZOTAC-RTX5080-SOLIDCORE-16GB"),
        (None, None, "b", None, 8, "n", "NAME-D1854CAE891EC7B2"), (None, None, None, None, None, "", None),
    ],
)
def test_canonical_ids(spark, mpn, model, brand, chip, memory, name, want):
    row = spark.createDataFrame([(mpn, model, brand, chip, memory, name)], "a string, b string, c string, d string, e int, f string")
    assert row.select(gpu.canonical_id(*map(F.col, "abcdef")).alias("r")).first().r == want


GOOD = dict(product_id="1", product_name="n", raw_product_name="n RTX", normalized_product_name="n", mall="SSG", mall_id="SSG", product_url="u", price=5, gpu_model="RTX 1", brand="b", gpu_model_id="m", vram_gb=8,
            canonical_product_id="c", board_partner_id="b", seller_id="s")


@pytest.mark.parametrize(
    "bad, error, persist",
    [
        ({}, None, None), ({"normalized_product_name": ""}, "normalized_product_name", "normalized_product_name"), ({"mall": None, "mall_id": None}, "mall", "mall_id"), ({"price": 0}, "price", "price"),
        ({"price": -1}, "price", "price"), ({"canonical_product_id": None}, "canonical_product_id", "canonical_product_id"), ({"seller_id": None}, None, "seller_id"), ({"board_partner_id": ""}, None, "board_partner_id"),
    ],
)
def test_single_rules(spark, bad, error, persist):
    kinds = {"price": "bigint", "vram_gb": "int"}
    row = GOOD | bad
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in row))
    r = df.select(listing.validation_error().alias("e"), listing.persist_error().alias("p")).first()
    assert (r.e and r.e.field, r.p and r.p.field) == (error, persist)
