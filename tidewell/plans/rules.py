"""Rules of the listing chain and its sources one by one, exercised over the driver's tables, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gpu, text
from ..operators import refdata, upsert
from ..sources import pages
from . import listing
from .conformance import _raw_parts
from .registry import query, table


def _names(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# ---- canonical identity (IDN-1..4) ---------------------------------------------
@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'ZTB5080' || p_partkey WHEN 1 THEN '' WHEN 2 THEN 'ZTB50' || p_partkey
  WHEN 3 THEN upper(p_brand) || '-RTX' || (4000 + p_size) || CASE WHEN p_partkey % 4 = 0 THEN '-WINDFORCE' WHEN p_partkey % 4 = 1 THEN '-GAMINGOC' ELSE '' END || '-' || p_size || 'GB'
  WHEN 4 THEN 'NAME-' || upper(left(sha1(p_name), 16)) END AS canonical_product_id FROM part""")
def canonical_id_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By part number, even one that leaves nothing, model name, structured parts and name; each identifier outranks those after it."""
    k, level = F.col("p_partkey"), F.col("p_partkey") % 6
    mpn = F.when(level == 0, F.concat(F.lit("zt-b5080/"), k.cast("string"))).when(level == 1, "--")
    model = F.when(level == 2, F.concat(F.lit("zt b50-"), k.cast("string"))).when(level == 3, "-/-").when(level < 2, "other")
    whole = level <= 3
    variant = F.when(k % 4 == 0, "Wind Force ").when(k % 4 == 1, "gaming oc ").otherwise("")
    name = F.when(level == 3, F.concat(F.lit("card "), variant, F.lit("of parts"))).when(level == 5, "").otherwise(F.col("p_name"))
    found = gpu.canonical_id(mpn, model, F.when(whole, F.col("p_brand")), F.when(whole, F.concat(F.lit("RTX "), (F.col("p_size") + 4000).cast("string"))), F.when(whole, F.col("p_size")), name)
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("canonical_product_id"))


# ---- single rules of validation (VAL-1..11) and of storing (VAL-13) --------------
_FINE = {
    "product_id": "1", "raw_product_name": "RTX 5080", "normalized_product_name": "RTX 5080", "mall_id": "SSG", "product_url": "https://x/1", "price": 1000, "gpu_model": "RTX 5080",
    "gpu_model_id": "rtx_5080", "brand": "ZOTAC", "vram_gb": 16, "canonical_product_id": "C", "board_partner_id": "ZOTAC", "seller_id": "S", "mall": "SSG",
}
_BROKEN = (
    {"product_id": None}, {"raw_product_name": ""}, {"normalized_product_name": None}, {"mall_id": ""}, {"product_url": None}, {"price": None}, {"price": 0}, {"price": -1},
    {"price": 100_000_001}, {"gpu_model": None, "raw_product_name": "keyboard", "normalized_product_name": "keyboard"}, {"brand": ""}, {"gpu_model_id": None}, {"vram_gb": None},
    {"canonical_product_id": ""}, {"price": 0, "mall_id": None, "canonical_product_id": None}, {"product_id": "", "price": None},
)
_FIELDS = ("product_id", "product_name", "normalized_product_name", "mall", "product_url", "price", "price", "price", "price", "gpu", "gpu", "gpu", "gpu", "canonical_product_id", "mall", "product_id")
_MESSAGES = (
    *[f"{f} is required" for f in _FIELDS[:6]], "price must be > 0", "price must be > 0", "price exceeds maximum (100000000)", "GPU keyword not detected",
    *["structured GPU information is incomplete"] * 3, "canonical_product_id generation failed", "mall is required", "product_id is required",
)


def _broken(parts: DataFrame, ways: tuple[dict, ...]) -> DataFrame:
    """A listing a part that is fine but for one way of being broken; the last of every turn is fine."""
    way = F.col("p_partkey") % (len(ways) + 1)

    def value(c: str, fine: str | int) -> Column:
        fine = F.lit(fine)
        for n, given in enumerate(ways):
            fine = F.when(way == n, F.lit(given[c])).otherwise(fine) if c in given else fine
        return fine.alias(c)

    return parts.select("p_partkey", *[value(c, fine) for c, fine in _FINE.items()])


@query(f"""
SELECT p_partkey, CASE WHEN k = {len(_BROKEN)} THEN NULL WHEN k = 9 THEN 'FILTERED' ELSE 'INVALID' END AS status, {_names(_FIELDS)}[k + 1] AS field, {_names(_MESSAGES)}[k + 1] AS message
FROM (SELECT p_partkey, p_partkey % {len(_BROKEN) + 1} AS k FROM part)""")
def validation_single_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule by itself, and the first of several."""
    found = _broken(table(spark, sf_dir, "part"), _BROKEN).withColumn("e", listing.validation_error())
    return found.select("p_partkey", "e.status", "e.field", "e.message")


_STORED = (
    "canonical_product_id", "mall_id", "product_id", "raw_product_name", "normalized_product_name", "brand", "board_partner_id", "gpu_model_id", "vram_gb", "price", "product_url",
)
_UNSTORED = (*[{f: None} for f in _STORED], {"price": 0}, {"price": -3}, {"seller_id": ""}, {"seller_id": None}, {"vram_gb": None, "mall_id": "", "seller_id": None})
_UNSTORED_MESSAGES = (*[f"{f} is required to persist" for f in _STORED], *["price must be a positive integer"] * 2, *["seller_id is required to persist"] * 2, "mall_id is required to persist")


@query(f"""
SELECT p_partkey, {_names((*_STORED, "price", "price", "seller_id", "seller_id", "mall_id"))}[k + 1] AS field, {_names(_UNSTORED_MESSAGES)}[k + 1] AS message
FROM (SELECT p_partkey, p_partkey % {len(_UNSTORED) + 1} AS k FROM part)""")
def storing_single_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _broken(table(spark, sf_dir, "part"), _UNSTORED).withColumn("e", listing.persist_error())
    return found.select("p_partkey", "e.field", "e.message")


@query("SELECT p_partkey, p_partkey % 3 <> 1 AS availability, CASE WHEN p_partkey % 4 = 0 THEN 'SOLD' ELSE 'AVAILABLE' END AS status FROM part")
def listing_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-2: what a listing does not tell."""
    k = F.col("p_partkey")
    raw = _raw_parts(spark, sf_dir).withColumns({"availability": F.when(k % 3 == 0, True).when(k % 3 == 1, False), "status": F.when(k % 4 == 0, "SOLD")})
    return listing.process(raw).select("p_partkey", "availability", "status")


# ---- reference data (SRC-20, SRC-21, JN-1..4, JN-7, AGG-5, UPS-9) ------------------
def _referring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as listings to store: of many malls and sellers, some of a partner or model that no seed knows."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey", k.alias("seq"), F.when(k % 3 == 0, "NOBODY").otherwise("ZOTAC").alias("board_partner_id"), F.when(k % 5 == 0, "rtx_1").otherwise("rtx_5080").alias("gpu_model_id"),
        F.concat(F.lit("M"), F.floor(k / 10).cast("string")).alias("mall_id"), F.lower(F.col("p_type")).alias("mall"), F.col("p_brand").alias("seller"),
        F.concat(F.lit("S"), F.floor(k / 2).cast("string")).alias("seller_id"),
    )


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    masters = refdata.seed(spark, allow_seed=True)
    return refdata.resolve(_referring(spark, sf_dir), *[masters[k] for k in ("board_partners", "gpu_models", "gpu_vendors", "gpu_families")])


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'board_partner_id' WHEN p_partkey % 5 = 0 THEN 'gpu_model_id' END AS field,
  CASE WHEN p_partkey % 3 = 0 THEN 'unknown partner' WHEN p_partkey % 5 = 0 THEN 'unknown model' END AS message FROM part""")
def resolve_against_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("p_partkey", F.col("resolve_error")["field"].alias("field"), F.col("resolve_error")["message"].alias("message"))


@query("""
SELECT 'mall' AS kind, 'M' || p_partkey // 10 AS id, arg_min(lower(p_type), p_partkey) AS name FROM part GROUP BY 2
UNION ALL SELECT 'seller', 'S' || p_partkey // 2, arg_min(p_brand, p_partkey) FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 GROUP BY 2""")
def malls_outlive_unresolved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-7: the mall of a listing is kept though its partner or model is unknown, its seller is not."""
    rows = _resolved(spark, sf_dir)
    malls, sellers = refdata.malls(rows), refdata.sellers(rows.where("resolve_error IS NULL"))
    malls = refdata.insert_absent(malls.drop("seq").limit(0), malls, "code").select(F.lit("mall").alias("kind"), F.col("code").alias("id"), F.col("display_name").alias("name"))
    return malls.unionAll(refdata.insert_absent(sellers.drop("seq").limit(0), sellers, "slug").select(F.lit("seller"), "slug", "seller_name"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in ("region", "nation", "supplier", "part")))
def master_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refdata.master_count({t: table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "part")})


@query("""
SELECT coalesce(n_nationkey, code) AS code, CASE WHEN code IS NULL THEN n_name ELSE name END AS name, n_regionkey AS region
FROM nation FULL JOIN (SELECT s_nationkey + s_suppkey % 2 * 10 AS code, arg_max(s_name, s_suppkey) AS name FROM supplier GROUP BY 1) ON n_nationkey = code""")
def plain_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPS-7, UPS-9: a row's columns replace those of its key, others stay, new keys are added."""
    existing = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("code"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    rows = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") + F.col("s_suppkey") % 2 * 10).cast("bigint").alias("code"), F.col("s_name").alias("name"), "s_suppkey")
    return upsert.merge(existing, upsert.fold(rows, ["code"], ["name"], seq="s_suppkey"), ["code"], keep=())


# ---- result pages and requests (SRC-2, SRC-8..13) ----------------------------------
def _result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result page a part: two whole units, and two without an id or a name."""
    k, name = F.col("p_partkey").cast("string"), F.col("p_name")

    def unit(key: Column, price: Column, named: Column) -> Column:
        return F.concat(
            F.lit('<div class="box ssgitem_unit" data-react-unit-id="'), key, F.lit('" data-react-unit-price="'), price, F.lit('"><a class="ssgitem_info" href="/i?id='), key,
            F.lit('&amp;c=1"><img class="ssgitem_thmb_img" src="//i/'), key, F.lit('.jpg"><br><b class="ssgitem_tit_brand"> '), "p_brand", F.lit(' </b><p class="ssgitem_tit_name">'), named, F.lit("</p></a></div>"),
        )

    cents = F.floor(F.col("p_retailprice")).cast("string")
    units = (unit(F.concat(F.lit("a"), k), cents, name), unit(F.lit(""), cents, name), unit(F.concat(F.lit("b"), k), F.concat(F.lit("₩1,"), cents), F.concat(F.lit("<i>two</i> "), name)), unit(k, cents, F.lit(" ")))
    html = F.concat(F.lit("<html><body><ul>"), *units, F.lit("</ul></body></html>"))
    return table(spark, sf_dir, "part").select(html.alias("html"), F.concat(F.lit("t"), k).alias("crawled_at"))


_UNITS_SQL = """
SELECT 'SSG' AS mall, 0 AS position, 'a' || p_partkey AS product_id, trim(p_name) AS product_name, floor(p_retailprice)::BIGINT AS price, p_brand AS seller,
  '/i?id=a' || p_partkey || '&c=1' AS product_url, '//i/a' || p_partkey || '.jpg' AS image_url, 't' || p_partkey AS crawled_at FROM part"""


@query(f"""{_UNITS_SQL} UNION ALL
SELECT 'SSG', 1, 'b' || p_partkey, 'two' || trim(p_name), ('1' || floor(p_retailprice)::BIGINT)::BIGINT, p_brand, '/i?id=b' || p_partkey || '&c=1', '//i/b' || p_partkey || '.jpg', 't' || p_partkey FROM part""")
def units_of_result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.parse_pages("ssg", _result_pages(spark, sf_dir))


@query(_UNITS_SQL)
def first_unit_of_result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.first_product(_result_pages(spark, sf_dir))


@query("SELECT p_partkey, 'https://www.example.com/search?target=all&query=' || replace(url_encode(p_name || ' 그래픽 & ' || p_partkey), '%20', '+') AS url FROM part")
def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyword = F.concat("p_name", F.lit(" 그래픽 & "), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", text.search_url("https://www.example.com/search", keyword).alias("url"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE floor(p_retailprice)::BIGINT END AS price FROM part""")
def shown_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13: zero stays, text without digits and none are null, digits are of any script."""
    whole, k = F.floor("p_retailprice").cast("string"), F.col("p_partkey") % 5
    wide = F.translate(whole, "0123456789", "０１２３４５６７８９")
    shown = F.when(k == 0, "0원").when(k == 1, "품절").when(k == 3, F.concat(F.lit("₩ "), wide, F.lit("-"))).when(k == 4, F.concat(whole, F.lit(" won")))
    return table(spark, sf_dir, "part").select("p_partkey", text.shown_price(shown).alias("price"))
