"""Batches and streams into the catalog: repeated, failed and late ones give the tables of a clean run."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tidewell.operators import joblog, refdata, upsert
from tidewell.plans import ingest, listing
from tidewell.sources.tables import Store
from tidewell.streaming.ingest import ingest as ingest_stream
from tidewell.streaming.ingest import listing_stream

def as_of(day=1):
    return F.lit(f"2026-09-0{day} 00:00:00").cast("timestamp")


NAME = "HIT ZOTAC GAMING 지포스 RTX 5080 SOLID CORE OC D7 16GB"
READ = {"products": ingest.PRODUCTS, "listings": ingest.LISTINGS, "latest_prices": ingest.LATEST, "malls": ingest.MALLS, "sellers": ingest.SELLERS}


def item(seq, product="1", price="2,429,000원", at="2026-08-19T10:00:00Z", **more):
    return dict(seq=seq, mall="SSG", product_id=product, product_name=NAME, price=price, seller="히트정보", product_url=f"//www.ssg.com/i?itemId={product}",
                image_url="//img.example.com/1.jpg", crawled_at=at) | more


def raw(spark, rows):
    names = [c.split()[0] for c in listing.RAW.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], listing.RAW)


@pytest.fixture(scope="module")
def masters(spark):
    return refdata.seed(spark, allow_seed=True)


def tables(store):
    found = {n: store.read(n, s) for n, s in READ.items()} | {"price_history": ingest.price_history(store)}
    found |= {n: store.read_all(n, s) for n, s in (("crawl_jobs", ingest.CRAWL_JOBS), ("crawl_logs", ingest.CRAWL_LOGS), ("validation_logs", "log_id string"))}
    return {n: sorted(map(str, df.select(*sorted(df.columns)).collect())) for n, df in found.items()}


BATCHES = [
    [item(1), item(2, "2", "100"), item(3, "3", "nothing"), item(4, product_name="RTX 5080 laptop")],
    [item(5, price="2,400,000원", at="2026-08-20T10:00:00Z", image_url=None), item(6, "2", "100", at="2026-08-20T10:00:00Z"), item(7, "9", "500", brand="NOBODY", product_name="RTX 5080 16GB")],
    [item(8, price="2,300,000원", at="2026-08-18T10:00:00Z"), item(9, price="2,500,000원", at="2026-08-20T10:00:00Z")],
]


def run(spark, store, masters, i):
    return ingest.run_batch(store, raw(spark, BATCHES[i]), masters, i + 1, f"job{i}", "SSG", as_of(), keyword="RTX 5080")


@pytest.fixture(scope="module")
def clean(spark, masters, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("clean")), parts=2)
    for i in range(3):
        run(spark, store, masters, i)
    return store


def test_tables_of_a_clean_run(spark, clean):
    history = {(r.listing_id, r.at_ms): (r.price, r.previous_price) for r in ingest.price_history(clean).collect()}
    day = lambda d: 1787047200000 + (d - 18) * 86_400_000
    assert history == {
        ("SSG_1", day(19)): (2429000, None), ("SSG_1", day(18)): (2300000, 2400000), ("SSG_1", day(20)): (2500000, 2400000), ("SSG_2", day(19)): (100, None),
    }
    assert {r.listing_id: r.stored_price for r in clean.read("latest_prices", "").collect()} == {"SSG_1": 2500000, "SSG_2": 100}
    listings = {r.listing_id: r for r in clean.read("listings", "").collect()}
    assert listings["SSG_1"].current_price == 2500000 and listings["SSG_1"].image_url == "https://img.example.com/1.jpg" and set(listings) == {"SSG_1", "SSG_2"}
    product = clean.read("products", "").first()
    assert product.canonical_product_id == "ZOTAC-RTX5080-SOLIDCORE-16GB" and product.active and product.created_at == product.updated_at
    assert [r.code for r in clean.read("malls", "").collect()] == ["SSG"] and [r.slug for r in clean.read("sellers", "").collect()] == ["SSG_48DAC5EF21D9"]
    logs = clean.read_all("crawl_logs", "")
    assert logs.groupBy("batch").count().count() == 3 and logs.where("level = 'WARN'").count() == 3 - 1
    assert [r.details.field for r in clean.read_all("validation_logs", "").orderBy("log_id").collect()].count("price") == 1


def test_a_batch_that_runs_again_changes_nothing(spark, masters, clean, tmp_path):
    store = Store(spark, str(tmp_path), parts=2)
    for i in (0, 1, 1, 0, 2, 2):
        assert run(spark, store, masters, i).count() == len(BATCHES[i])
    assert tables(store) == tables(clean)


def test_a_batch_that_failed_half_way_runs_again(spark, masters, clean, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path), parts=2)
    run(spark, store, masters, 0)
    before = tables(store)

    def broken(*args):
        return joblog.batch_status(args[0]).select(F.raise_error(F.lit("lost")).alias("log_id"))

    with monkeypatch.context() as m:
        m.setattr(joblog, "validation_logs", broken)
        with pytest.raises(Exception, match="lost"):
            run(spark, store, masters, 1)
    assert tables(store) == before
    for i in (1, 2):
        run(spark, store, masters, i)
    assert tables(store) == tables(clean)


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def job(spark, n):
    return spark.createDataFrame([(f"job{n}",)], "job_id string")


def put(spark, store, rows, batch):
    new = spark.createDataFrame(rows, "k string, v int")
    store.update("t", "k string, v int", "k", new, batch, lambda now: upsert.merge(now, new, ["k"]))


def test_a_batch_writes_the_parts_that_it_touches(spark, tmp_path):
    store = Store(spark, str(tmp_path), parts=8)
    keys = [f"k{i}" for i in range(100)]
    put(spark, store, [(k, 1) for k in keys], 1)
    store.complete(job(spark, 1), 1)
    before = files(tmp_path / "t")
    put(spark, store, [("k7", 2), ("k7", 2)][:1], 2)
    store.complete(job(spark, 2), 2)
    after = files(tmp_path / "t")
    assert before.items() <= after.items() and len({f.split("/")[0] for f in after.keys() - before.keys()}) == 1
    assert {r.k: r.v for r in store.read("t", "").collect()} == {k: 2 if k == "k7" else 1 for k in keys}
    assert {r.v for r in store.read("t", "", before=2).collect()} == {1}


def test_nothing_of_a_batch_is_seen_before_it_is_complete(spark, tmp_path):
    store = Store(spark, str(tmp_path), parts=2)
    put(spark, store, [("a", 1)], 1)
    store.append("log", spark.range(3), 1)
    assert (store.last(), store.committed(1), store.read("t", "").count(), store.read_all("log", "").count()) == (0, False, 0, 0)
    store.complete(job(spark, 1), 1)
    put(spark, store, [("a", 2), ("b", 2)], 2)  # fails before its end
    store.append("log", spark.range(5), 2)
    assert (store.last(), store.read("t", "").collect(), store.read_all("log", "").count()) == (1, [("a", 1)], 3)
    put(spark, store, [("a", 3), ("b", 3)], 2)  # and runs again
    store.append("log", spark.range(4), 2)
    store.complete(job(spark, 2), 2)
    assert {tuple(r) for r in store.read("t", "").collect()} == {("a", 3), ("b", 3)} and store.read_all("log", "").where("batch = 2").count() == 4
    with pytest.raises(ValueError):
        store.complete(job(spark, 1), 1)
    assert store.read("none", "id bigint").columns == ["id"] and store.read_all("none", "id bigint").columns == ["id", "batch"]


def test_old_versions_go(spark, tmp_path):
    store = Store(spark, str(tmp_path), parts=1)
    for n in range(1, 5):
        put(spark, store, [("a", n)], n)
        store.complete(job(spark, n), n, ["t"])
    assert {f.split("/")[1] for f in files(tmp_path / "t")} == {"batch=3", "batch=4"}
    assert store.read("t", "").collect() == [("a", 4)]


def test_batches_run_in_order(spark, masters, clean, tmp_path):
    store = Store(spark, str(tmp_path), parts=2)
    run(spark, store, masters, 2)
    with pytest.raises(ValueError):
        run(spark, store, masters, 0)


def test_fail_stores_what_came_before_the_first_bad_row(spark, masters, tmp_path):
    rows = [item(1), item(2, "2", seller=None), item(3, "3")]
    for policy, want in (("isolate", {"SSG_1", "SSG_3"}), ("fail", {"SSG_1"})):
        store = Store(spark, f"{tmp_path}/{policy}", parts=2)
        got = ingest.run_batch(store, raw(spark, rows), masters, 1, "j", "SSG", as_of(), on_persist_error=policy)
        assert [r.persist_error.field for r in got.where("persist_error IS NOT NULL").collect()] == ["seller_id"]
        assert {r.listing_id for r in store.read("listings", "").collect()} == want


def test_stream_stopped_between_store_and_checkpoint(spark, masters, tmp_path):
    source, check = tmp_path / "in", tmp_path / "check"
    source.mkdir()
    store = Store(spark, str(tmp_path / "store"), parts=2)

    def feed(n):
        rows = [dict(item(r["seq"]), **r) for r in BATCHES[n]]
        (source / f"{n}.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")

    def go():
        ingest_stream(listing_stream(spark, str(source)), store, masters, str(check), "SSG").awaitTermination()

    feed(0)
    go()
    feed(1)
    go()
    before = tables(store)
    for name in ("1", ".1.crc"):
        os.remove(check / "commits" / name)
    go()
    assert tables(store) == before and store.last() == 2
    shutil.rmtree(check)


def test_upsert_products(spark):
    columns = "seq bigint, canonical_product_id string, brand string, board_partner_id string, gpu_model_id string, normalized_product_name string, vram_gb int, manufacturer_part_number string, image_url string"
    first = upsert.upsert_products(spark.createDataFrame([], ingest.PRODUCTS), spark.createDataFrame([(1, "A", "x", "x", "m", "n", 8, "MP", "u"), (2, "A", "y", "x", "m", "n2", 8, None, "")], columns), as_of(1))
    r = first.first()
    assert (r.brand, r.normalized_product_name, r.manufacturer_part_number, r.image_url, r.active) == ("y", "n2", "MP", "u", True)
    second = upsert.upsert_products(first, spark.createDataFrame([(3, "A", "z", "x", "m", "n", 8, None, "v"), (4, "B", "z", "x", "m", "n", 8, None, None)], columns), as_of(2))
    r = {x.canonical_product_id: x for x in second.collect()}
    assert (r["A"].brand, r["A"].manufacturer_part_number, r["A"].image_url) == ("z", "MP", "v")
    assert str(r["A"].created_at)[:10] == "2026-09-01" and str(r["A"].updated_at)[:10] == str(r["B"].created_at)[:10] == "2026-09-02"


def test_seed_is_asked_for(spark):
    with pytest.raises(PermissionError):
        refdata.seed(spark)
    counts = {r.table: r.n for r in refdata.master_count(refdata.seed(spark, allow_seed=True)).collect()}
    assert counts == {"gpu_vendors": 1, "gpu_families": 1, "gpu_models": 1, "board_partners": 1}
