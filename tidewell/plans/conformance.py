"""Operators exercised over the driver's tables, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions import gpu, text
from ..operators import analytics, catalog, history, joblog, matching, refdata, upsert
from . import listing
from .ingest import LATEST, LISTINGS, PRODUCTS
from .registry import SQL, query, table


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as price observations of a user's listing, in steps of 50."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("listing_id"), "event_id", "ts", F.floor(F.col("value") / 50).cast("bigint").alias("price"))


PRICES = "(SELECT user_id AS listing_id, event_id, ts, trunc(value / 50)::BIGINT AS price FROM events)"


# ---- history ---------------------------------------------------------------
@query(f"""
SELECT listing_id, event_id, price, previous_price, price - previous_price AS price_change
FROM (SELECT *, lag(price) OVER (PARTITION BY listing_id ORDER BY ts, event_id) AS previous_price FROM {PRICES})
WHERE previous_price IS NULL OR previous_price <> price""")
def price_history_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.change_points(_prices(spark, sf_dir), "listing_id", "ts", "price", "event_id")
    return found.select("listing_id", "event_id", "price", "previous_price", "price_change")


@query(f"""
WITH RECURSIVE a AS (
  SELECT listing_id::VARCHAR AS listing_id, row_number() OVER (PARTITION BY listing_id ORDER BY (event_id * 7919) % 1000003, event_id) AS rn,
         epoch_us(ts) // 1000 AS at_ms, price, (event_id * 7919) % 1000003 AS seq FROM {PRICES}),
f AS (
  SELECT listing_id, rn, seq, at_ms, price, at_ms AS mx, price AS cur, NULL::BIGINT AS prev, TRUE AS kept FROM a WHERE rn = 1
  UNION ALL
  SELECT a.listing_id, a.rn, a.seq, a.at_ms, a.price,
         CASE WHEN a.price <> f.cur AND a.at_ms >= f.mx THEN a.at_ms ELSE f.mx END,
         CASE WHEN a.price <> f.cur AND a.at_ms >= f.mx THEN a.price ELSE f.cur END, f.cur, a.price <> f.cur
  FROM f JOIN a ON a.listing_id = f.listing_id AND a.rn = f.rn + 1)
SELECT listing_id, at_ms, at_ms::VARCHAR AS history_id, seq, price, prev AS previous_price, price - prev AS price_change
FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, at_ms ORDER BY rn DESC) AS k FROM f WHERE kept) WHERE k = 1""")
def price_history_replay_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All listings; they arrive in an order that has nothing to do with time."""
    arrivals = _prices(spark, sf_dir).select(
        F.col("listing_id").cast("string").alias("listing_id"), ((F.col("event_id") * 7919) % 1_000_003).alias("seq"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "price",
    )
    return history.replay(arrivals)


@query(f"SELECT listing_id::VARCHAR AS listing_id, epoch_us(max(ts)) // 1000 AS stored_at, arg_max(price, ts) AS stored_price FROM {PRICES} GROUP BY listing_id")
def listing_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prices(spark, sf_dir).select(F.col("listing_id").cast("string").alias("listing_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "price")
    return history.latest_stored(rows)


@query(f"SELECT NOT coalesce(bool_or(late), FALSE) AS in_order FROM (SELECT lag(ts) OVER (PARTITION BY listing_id ORDER BY event_id) > ts AS late FROM {PRICES})")
def history_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.in_order(_prices(spark, sf_dir), "listing_id", "ts", "event_id")


# ---- reads and top-k -------------------------------------------------------
@query("""
SELECT l_partkey, l_suppkey, s_name, l_extendedprice, l_orderkey, l_linenumber
FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_suppkey, l_orderkey, l_linenumber) AS k FROM lineitem)
JOIN supplier ON s_suppkey = l_suppkey WHERE k = 1""")
def lowest_listing_per_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowest = catalog.lowest_per(table(spark, sf_dir, "lineitem"), "l_partkey", "l_extendedprice", "l_suppkey", "l_orderkey", "l_linenumber")
    suppliers = table(spark, sf_dir, "supplier")
    found = lowest.join(suppliers, lowest.l_suppkey == suppliers.s_suppkey)
    return found.select("l_partkey", "l_suppkey", "s_name", "l_extendedprice", "l_orderkey", "l_linenumber")


@query("""
SELECT l_partkey, min(effective) AS effective_price FROM (
  SELECT l_partkey, l_extendedprice + CASE WHEN l_tax > 0.04 THEN 2500 ELSE 0 END AS effective FROM lineitem WHERE l_linestatus = 'O')
GROUP BY l_partkey""")
def lowest_effective_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_extendedprice", F.when(F.col("l_tax") > 0.04, 2500).alias("fee"), (F.col("l_linestatus") == "O").alias("in_stock"), "l_orderkey", "l_linenumber"
    )
    found = catalog.lowest_effective(offers, "l_partkey", "l_extendedprice", "fee", "in_stock", "l_orderkey", "l_linenumber")
    return found.select("l_partkey", "effective_price")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem WHERE l_partkey = 7")
def listings_of_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.by_key(table(spark, sf_dir, "lineitem"), l_partkey=7)
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").orderBy("l_extendedprice")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small') OR starts_with(p_name, 'red w')")
def product_name_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    found = catalog.name_prefix(parts, "p_name", "small").unionAll(catalog.name_prefix(parts, "p_name", "red w"))
    return found.select("p_partkey", "p_name")


@query("""
SELECT o_orderpriority, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders)
WHERE place <= 10""")
def recent_jobs_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.recent_per(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_orderkey", n=10)
    return found.select("o_orderpriority", "o_orderkey", F.col("place").cast("bigint").alias("place"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def recent_jobs_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.recent(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", n=20).select("o_orderkey")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand, s_name, n_name
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey""")
def listing_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"))
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    lines = lines.join(suppliers.select(F.col("s_suppkey").alias("seller_id"), F.col("s_nationkey").alias("mall_id")), "seller_id", "left")
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("canonical_product_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("gpu_model_id"), F.col("p_size").alias("vram_gb")
    )
    sellers = suppliers.select(F.col("s_suppkey").alias("slug"), F.col("s_name").alias("seller_name"))
    malls = nations.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("display_name"))
    found = catalog.display(lines, parts, sellers, malls)
    return found.select(
        "l_orderkey", "l_linenumber", F.col("product_id").alias("l_partkey"), F.col("seller_id").alias("l_suppkey"), F.col("brand").alias("p_brand"),
        F.col("seller_name").alias("s_name"), F.col("mall_name").alias("n_name"),
    )


# ---- statistics ------------------------------------------------------------
CENTS = "(SELECT *, round(l_extendedprice * 100)::BIGINT AS cents, l_orderkey * 10 + l_linenumber AS tie FROM lineitem)"
_STATS = """min(cents) AS min_price, max(cents) AS max_price, avg(cents) AS avg_price, median(cents) AS median_price, max(cents) - min(cents) AS price_range,
  round((arg_max(cents, (l_shipdate, tie)) - arg_min(cents, (l_shipdate, tie))) / arg_min(cents, (l_shipdate, tie)), 9) AS change_rate"""


def _price_stats(spark: SparkSession, sf_dir: str, key: list[str]) -> DataFrame:
    """In whole cents, whose sums are exact in any order."""
    lines = table(spark, sf_dir, "lineitem").withColumns(
        {"tie": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "cents": F.round(F.col("l_extendedprice") * 100).cast("bigint")}
    )
    found = analytics.price_stats(lines, key, "cents", "l_shipdate", "tie", "l_suppkey")
    return found.withColumn("change_rate", F.round("change_rate", 9))


@query(f"SELECT l_partkey, {_STATS}, count(DISTINCT l_suppkey) AS sellers, count(*) AS observations FROM {CENTS} GROUP BY l_partkey")
def price_stats_per_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _price_stats(spark, sf_dir, ["l_partkey"])


@query(f"SELECT l_partkey, l_suppkey, {_STATS}, count(*) AS observations FROM {CENTS} GROUP BY l_partkey, l_suppkey")
def seller_price_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _price_stats(spark, sf_dir, ["l_partkey", "l_suppkey"]).drop("sellers")


@query("""
SELECT n_name, s_name, count(*) AS observations, avg(round(l_extendedprice * 100)::BIGINT) AS avg_price
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ROLLUP (n_name, s_name)""")
def price_rollup_mall_seller(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, suppliers, nations = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    rows = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.rollup("n_name", "s_name").agg(F.count(F.lit(1)).alias("observations"), F.avg(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("avg_price"))


@query("""
SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, round(cume_dist() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice), 9) AS percentile FROM lineitem""")
def price_percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.percentile_of(table(spark, sf_dir, "lineitem"), "l_partkey", "l_extendedprice")
    return found.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", F.round("percentile", 9).alias("percentile"))


_FRAME = "OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts) RANGE BETWEEN INTERVAL {n} DAYS PRECEDING AND CURRENT ROW)"


@query(
    "SELECT event_id, "
    + ", ".join(f"min(cents) {_FRAME.format(n=n)} AS min_{n}d, avg(cents) {_FRAME.format(n=n)} AS avg_{n}d" for n in (7, 30, 90))
    + " FROM (SELECT *, round(value * 100)::BIGINT AS cents FROM events)"
)
def rolling_7_30_90(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    found = analytics.rolling(events, "user_id", "ts", "cents")
    return found.select("event_id", *[f"{kind}_{n}d" for n in (7, 30, 90) for kind in ("min", "avg")])


@query("""
SELECT user_id, points, CASE WHEN points < 5 OR slope / mean IS NULL THEN 'UNKNOWN' WHEN deviation / mean >= 0.6 THEN 'VOLATILE'
  WHEN slope / mean >= 0.002 THEN 'UP' WHEN slope / mean <= -0.002 THEN 'DOWN' ELSE 'STABLE' END AS trend
FROM (SELECT user_id, count(value) AS points, avg(value) AS mean, stddev_samp(value) AS deviation,
             regr_slope(value, epoch(date_trunc('second', ts)) / 86400) AS slope FROM events GROUP BY user_id)""")
def trend_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.trend(table(spark, sf_dir, "events"), "user_id", "ts", "value")


@query(f"""
SELECT event_id, CASE WHEN value <= lowest * 1.1 THEN 'BUY' WHEN value >= mean * 1.2 THEN 'AVOID' ELSE 'WAIT' END AS signal
FROM (SELECT event_id, value, min(value) {_FRAME.format(n=30)} AS lowest, avg(value) {_FRAME.format(n=30)} AS mean FROM events)""")
def buy_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.rolling(table(spark, sf_dir, "events"), "user_id", "ts", "value", (30,))
    return rows.select("event_id", analytics.signal(F.col("value"), F.col("min_30d"), F.col("avg_30d")).alias("signal"))


@query("""
SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 500 THEN 11 ELSE floor(value / 50)::BIGINT + 1 END AS bin, count(*) AS n FROM events GROUP BY 1""")
def price_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.histogram(table(spark, sf_dir, "events"), "value", 0.0, 500.0, 10)


@query("SELECT user_id, ts::DATE AS day, arg_max(value, (ts, event_id)) AS close_price, count(*) AS observations FROM events GROUP BY 1, 2")
def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.daily_series(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value")


@query("""
SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM lineitem JOIN (SELECT l_partkey, median(l_extendedprice) AS m FROM lineitem GROUP BY 1) USING (l_partkey)
WHERE l_extendedprice > m * 2 OR l_extendedprice * 2 < m""")
def price_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.anomalies(table(spark, sf_dir, "lineitem"), "l_partkey", "l_extendedprice", 2.0)
    return found.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")


@query(f"SELECT l_partkey, change_rate FROM (SELECT l_partkey, {_STATS} FROM {CENTS} GROUP BY l_partkey) WHERE change_rate < 0 ORDER BY change_rate, l_partkey LIMIT 20")
def deal_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.deals(_price_stats(spark, sf_dir, ["l_partkey"]), "change_rate", "l_partkey", 20).select("l_partkey", "change_rate")


@query("""
SELECT mall_id, listing_id, last_seen_at::VARCHAR AS last_seen_at, jobs_since,
  CASE WHEN jobs_since >= 10 THEN 'DISCONTINUED' WHEN jobs_since >= 3 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS status
FROM (SELECT event_type AS mall_id, user_id::VARCHAR AS listing_id, max(ts) AS last_seen_at,
        (SELECT count(*) FROM (SELECT unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-15', INTERVAL 1 DAY)) AS at) j WHERE j.at >= max(e.ts)) AS jobs_since
      FROM events e GROUP BY 1, 2)""")
def listing_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("mall_id"), F.col("user_id").cast("string").alias("listing_id"), F.col("ts").alias("crawled_at"))
    days = F.sequence(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.lit("2024-02-14 00:00:00").cast("timestamp_ntz"), F.expr("INTERVAL 1 DAY"))
    jobs = events.select("mall_id").distinct().select("mall_id", F.explode(days).alias("started_at"))
    return analytics.unseen(events, jobs).withColumn("last_seen_at", F.col("last_seen_at").cast("string"))


# ---- text, urls, extraction ------------------------------------------------
_SPACES = r"'[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'"


@query(rf"""
SELECT doc_id, nullif(trim(regexp_replace(replace(coalesce(text, ''), ' ', '  '), {_SPACES}, ' ', 'g')), '') AS cleaned FROM documents""")
def clean_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit("  "))
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_string(spaced, references=False).alias("cleaned"))


@query(rf"""
WITH a AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace('[sale] hit ' || p_name || '!!', '^\[[^\]]+\]\s*', ''), '!+$', ''), {_SPACES}, ' ', 'g')) AS n FROM part)
SELECT p_partkey, trim(regexp_replace(n, '^hit\s+', '', 'i')) AS name FROM a""")
def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", text.normalize_product_name(F.concat(F.lit("[sale] hit "), "p_name", F.lit("!!"))).alias("name"))


@query(r"""
SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_type)), '\s+', '_', 'g'), '[^a-z0-9_]', '', 'g') AS model_slug,
  regexp_replace(upper(p_name), '[^A-Za-z0-9]+', '', 'g') AS token, substr(upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')), 1, 32) AS seller_slug,
  upper(p_brand) || '-' || upper(replace(p_type, ' ', '')) || CASE WHEN contains(replace(upper(p_name), ' ', ''), 'SUPER') THEN '-SUPER' ELSE '' END || '-' || p_size || 'GB' AS canonical_id,
  'NAME-' || upper(substr(sha1(p_name), 1, 16)) AS name_id FROM part""")
def slug_and_sha1_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    return parts.select(
        "p_partkey", text.model_slug(F.col("p_type")).alias("model_slug"), text.slug_token(F.col("p_name")).alias("token"), text.seller_slug(F.col("p_brand")).alias("seller_slug"),
        gpu.canonical_id(none, none, F.col("p_brand"), F.col("p_type"), F.col("p_size"), F.col("p_name")).alias("canonical_id"),
        gpu.canonical_id(none, none, none, none, none, F.col("p_name")).alias("name_id"),
    )


@query("""
WITH q AS (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) AS head, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query, regexp_extract(url, '(#.*)$', 1) AS tail FROM pages),
k AS (SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ('utm_source', 'ref')), '&') AS kept FROM q)
SELECT page_id, head || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END || tail AS url FROM k""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.product_url_native(F.col("url"), ("utm_source", "ref")).alias("url"))


@query()
def url_normalize_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL-1 with re-encoding; tested against the standard library on a fixture."""
    return table(spark, sf_dir, "pages").select("page_id", text.product_url(F.concat("url", F.lit("&click=1"))).alias("url"))


_BRANDS = tuple(sorted(D.BOARD_PARTNERS, key=len, reverse=True))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN contains(upper(text), '{b}') THEN '{b}'" for b in _BRANDS) + " END AS brand FROM documents")
def brand_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", gpu.brand(F.col("text")).alias("brand"))


@query("SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(upper(text), '{k}')" for k in D.KEYWORDS))
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(gpu.has_keyword(F.col("text"))).select("doc_id")


@query(r"""
SELECT p_partkey, list_max(list_transform(regexp_extract_all(p_name || ' ' || p_size || 'GB x ' || (p_partkey % 97) || ' g', '(?i)\b([0-9]{1,3})\s*(?:GB|G)\b', 1), lambda x: x::INT)) AS vram_gb,
  nullif(regexp_extract(upper(p_brand || ' AB-' || p_size || '12345'), '\b([A-Z]{2,3}-[A-Z0-9-]{5,})\b', 1), '') AS part_number FROM part""")
def regex_extract_max_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    named = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("GB x "), (F.col("p_partkey") % 97).cast("string"), F.lit(" g"))
    number = F.concat("p_brand", F.lit(" AB-"), F.col("p_size").cast("string"), F.lit("12345"))
    return parts.select("p_partkey", gpu.memory_gb(named).alias("vram_gb"), gpu.part_number(number).alias("part_number"))


@query(r"""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'RTX' WHEN 1 THEN 'RX' ELSE 'Arc' END AS series,
  CASE p_partkey % 3 WHEN 0 THEN 'RTX ' || (4000 + p_size) || ' TI' WHEN 1 THEN 'RX ' || (7000 + p_size) || ' XT' ELSE 'Arc B' || p_size END AS model FROM part""")
def gpu_model_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, size = table(spark, sf_dir, "part"), F.col("p_size")
    named = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("new rtx"), (size + 4000).cast("string"), F.lit(" Ti OC")))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("RX  "), (size + 7000).cast("string"), F.lit("xt")))
        .otherwise(F.concat(F.lit("intel arc b"), size.cast("string")))
    )
    return parts.select("p_partkey", gpu.model(named).alias("m")).select("p_partkey", "m.*")


@query("""
SELECT event_id, nullif(try_cast(regexp_replace(value::DECIMAL(12,2)::VARCHAR || ' KRW', '[^0-9]', '', 'g') AS BIGINT), 0) AS text_price,
  CASE WHEN value > 0 THEN trunc(value)::BIGINT END AS number_price FROM events""")
def price_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.col("value").cast("decimal(12,2)").cast("string"), F.lit(" KRW"))
    return table(spark, sf_dir, "events").select("event_id", text.price_of_text(shown).alias("text_price"), text.price_of_number(F.col("value")).alias("number_price"))


@query("""
SELECT event_id, (epoch_us(ts) // 1000)::VARCHAR AS history_id, event_type || '_' || strftime(ts, '%Y%m%d_%H%M%S') AS job_id,
  strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS crawled_at FROM events""")
def time_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    shown = F.date_format("ts", "yyyyMMdd'T'HHmmss")
    return events.select(
        "event_id", text.epoch_millis_id(F.col("ts")).alias("history_id"), text.job_id(F.col("event_type"), F.col("ts")).alias("job_id"),
        F.date_format(text.crawl_time(shown), "yyyy-MM-dd HH:mm:ss").alias("crawled_at"),
    )


@query("""
SELECT page_id, CASE WHEN page_id % 700 IN (400, 401, 403, 404) THEN FALSE WHEN page_id % 700 IN (408, 429) THEN TRUE ELSE page_id % 700 >= 500 END AS retry,
  CASE WHEN page_id % 5 = 0 THEN 1.0 WHEN page_id % 5 = 1 THEN 2.0 ELSE 4.0 END::DOUBLE AS delay FROM pages""")
def retry_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.should_retry(F.col("page_id") % 700).alias("retry"), text.backoff(F.col("page_id") % 5).alias("delay"))


# ---- validation and operations ---------------------------------------------
_RAW_SQL = """
SELECT p_partkey, CASE
  WHEN p_partkey % 17 = 0 THEN 'product_id' WHEN p_partkey % 13 = 0 THEN 'product_name' WHEN p_partkey % 11 = 0 THEN 'product_url'
  WHEN p_partkey % 7 = 0 THEN 'price' WHEN p_partkey % 5 = 0 THEN 'gpu' WHEN p_partkey % 3 = 0 THEN 'gpu' END AS field,
  CASE WHEN p_partkey % 17 = 0 OR p_partkey % 13 = 0 OR p_partkey % 11 = 0 OR p_partkey % 7 = 0 THEN 'INVALID'
       WHEN p_partkey % 5 = 0 THEN 'FILTERED' WHEN p_partkey % 3 = 0 THEN 'INVALID' END AS status FROM part"""


def _raw_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as raw listings, of which many fail in one way each or in several."""
    parts, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = (
        F.when(k % 13 == 0, F.lit("  ")).when(k % 5 == 0, F.lit("HDMI cable"))
        .when(k % 3 == 0, F.concat(F.lit("RTX 5080 card "), k.cast("string")))
        .otherwise(F.concat(F.lit("[new] HIT ZOTAC RTX "), (F.col("p_size") + 4000).cast("string"), F.lit(" SOLID CORE 16GB!")))
    )
    made = {
        "seq": k, "mall": F.lit("쓱닷컴"), "product_id": F.when(k % 17 != 0, k.cast("string")), "product_name": name,
        "price": F.when(k % 7 != 0, F.concat(F.lit("₩ "), F.floor("p_retailprice").cast("string"))), "seller": F.lit("히트 정보"),
        "product_url": F.when(k % 11 != 0, F.concat(F.lit("//www.example.com/p?click=1&id="), k.cast("string"))), "crawled_at": F.lit("2026-08-19T10:00:00Z"),
    }
    columns = [c.split() for c in listing.RAW.split(", ")]
    return parts.select("p_partkey", *[made.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in columns])


@query(_RAW_SQL)
def validation_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listing.process(_raw_parts(spark, sf_dir))
    return found.select("p_partkey", F.col("error")["field"].alias("field"), F.col("error")["status"].alias("status"))


@query("""
SELECT p_partkey, 'ZOTAC RTX ' || (p_size + 4000) || ' SOLID CORE 16GB' AS normalized_product_name, 'ZOTAC-RTX' || (p_size + 4000) || '-SOLIDCORE-16GB' AS canonical_product_id,
  'SSG_48DAC5EF21D9' AS seller_id, 'https://www.example.com/p?id=' || p_partkey AS product_url, nullif(floor(p_retailprice)::BIGINT, 0) AS price
FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 3 <> 0""")
def validated_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listing.process(_raw_parts(spark, sf_dir)).where("error IS NULL")
    return found.select("p_partkey", "normalized_product_name", "canonical_product_id", "seller_id", "product_url", "price")


@query(f"""
SELECT round(avg((status IS NULL)::INT), 9) AS validation_success, round(avg((p_partkey % 13 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 3 <> 0)::INT), 9) AS matching_success, round(1 - count(DISTINCT 'SSG' || coalesce('_' || CASE WHEN p_partkey % 17 <> 0 THEN p_partkey END, ''))
  / count(*), 9) AS duplicate_rate FROM ({_RAW_SQL})""")
def validation_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = joblog.kpis(listing.process(_raw_parts(spark, sf_dir)))
    return found.select(*[F.round(c, 9).alias(c) for c in ("validation_success", "matching_success", "duplicate_rate")])


@query(f"SELECT count(*) AS items, count(status) AS failures, CASE WHEN count(*) > 0 AND count(status) = count(*) THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM ({_RAW_SQL})")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joblog.batch_status(listing.process(_raw_parts(spark, sf_dir)))


@query(f"""
SELECT level, count(*) AS n FROM (SELECT CASE WHEN status IS NULL THEN 'INFO' ELSE 'WARN' END AS level FROM ({_RAW_SQL}) UNION ALL SELECT 'INFO' UNION ALL SELECT 'INFO'
  UNION ALL SELECT (SELECT CASE WHEN count(*) > 0 AND count(status) = count(*) THEN 'ERROR' ELSE 'INFO' END FROM ({_RAW_SQL}))) GROUP BY level""")
def crawl_log_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = joblog.crawl_logs(listing.process(_raw_parts(spark, sf_dir)), "j", "SSG", None, F.current_timestamp())
    return logs.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT field, status AS validation_status, count(*) AS n FROM ({_RAW_SQL}) WHERE status IS NOT NULL GROUP BY ALL")
def validation_log_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = joblog.validation_logs(listing.process(_raw_parts(spark, sf_dir)), "pipeline", F.current_timestamp())
    return logs.groupBy("details.field", "details.validation_status").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT conv_id::VARCHAR AS job_id, arg_max(CASE WHEN role = 'assistant' THEN 'COMPLETED' ELSE 'RUNNING' END, turn) AS status, min(turn) AS started_at,
  max(CASE WHEN role = 'assistant' THEN turn END) AS completed_at FROM conversations GROUP BY conv_id""")
def job_state_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("job_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "assistant", "COMPLETED").otherwise("RUNNING").alias("status"), F.col("turn").alias("at")
    )
    return joblog.latest_jobs(events)


# ---- reference data and upserts --------------------------------------------
@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN s_suppkey IS NULL THEN 'board_partner_id' WHEN p_partkey IS NULL THEN 'gpu_model_id'
  WHEN n_nationkey IS NULL THEN 'vendor_id' WHEN r_regionkey IS NULL THEN 'family_id' END AS missing
FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 5 <> 0) ON s_suppkey = l_suppkey LEFT JOIN (SELECT * FROM part WHERE p_partkey % 7 <> 0) ON p_partkey = l_partkey
LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 6 <> 0) ON n_nationkey = p_size % 25 LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) ON r_regionkey = p_size % 5""")
def resolve_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_suppkey").alias("board_partner_id"), F.col("l_partkey").alias("gpu_model_id"))
    partners = table(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("slug"))
    models = table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(
        F.col("p_partkey").alias("slug"), (F.col("p_size") % 25).alias("vendor_id"), (F.col("p_size") % 5).alias("family_id")
    )
    vendors = table(spark, sf_dir, "nation").where("n_nationkey % 6 <> 0").select(F.col("n_nationkey").alias("code"))
    families = table(spark, sf_dir, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").alias("code"))
    found = refdata.resolve(rows, partners, models, vendors, families)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("resolve_error")["field"].alias("missing"))


@query("""
SELECT s_suppkey AS slug, s_name AS name FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT slug, arg_min(name, seq) AS name FROM (
  SELECT l_suppkey AS slug, 'seller ' || l_orderkey AS name, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey % 100000 AS seq FROM lineitem)
WHERE slug NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) GROUP BY slug""")
def ensure_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("slug"), F.col("s_name").alias("name"))
    incoming = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("slug"), F.concat(F.lit("seller "), F.col("l_orderkey").cast("string")).alias("name"),
        (F.col("l_orderkey") * 1_000_000 + F.col("l_linenumber") * 100_000 + F.col("l_partkey") % 100_000).alias("seq"),
    )
    return refdata.insert_absent(existing, incoming, "slug")


@query("""
WITH i AS (SELECT l_partkey AS k, arg_max(l_extendedprice, seq) AS price, arg_max(note, seq) FILTER (note IS NOT NULL) AS note FROM (
  SELECT l_partkey, l_extendedprice, CASE WHEN l_linenumber = 2 THEN l_returnflag || l_suppkey END AS note, l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey AS seq FROM lineitem)
  GROUP BY 1),
e AS (SELECT p_partkey * 2 AS k, p_name, p_retailprice AS price, CASE WHEN p_partkey % 3 = 0 THEN 'old' END AS note FROM part)
SELECT coalesce(i.k, e.k) AS k, p_name, coalesce(i.price, e.price) AS price, coalesce(i.note, e.note) AS note FROM e FULL JOIN i ON i.k = e.k""")
def merge_upsert_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the existing side are doubled, so that some are on one side alone."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("k"), F.col("l_extendedprice").alias("price"), F.when(F.col("l_linenumber") == 2, F.concat("l_returnflag", F.col("l_suppkey").cast("string"))).alias("note"),
        (F.col("l_orderkey") * 1_000_000 + F.col("l_linenumber") * 100_000 + F.col("l_suppkey")).alias("seq"),
    )
    existing = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") * 2).alias("k"), "p_name", F.col("p_retailprice").alias("price"), F.when(F.col("p_partkey") % 3 == 0, "old").alias("note")
    )
    return upsert.merge(existing, upsert.fold(lines, ["k"], ["price", "note"], keep=["note"]), ["k"], keep=["note"])


@query("SELECT p_brand, p_type, p_size, count(*) AS listings, count(DISTINCT p_name) AS names FROM part GROUP BY ALL")
def crosswalk_canonical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDN-7: rows of one canonical id are one product."""
    none = F.lit(None).cast("string")
    parts = table(spark, sf_dir, "part").withColumn("id", gpu.canonical_id(none, none, F.col("p_brand"), F.col("p_type"), F.col("p_size"), F.lit("")))
    return parts.groupBy("id").agg(
        F.any_value("p_brand").alias("p_brand"), F.any_value("p_type").alias("p_type"), F.any_value("p_size").alias("p_size"),
        F.count(F.lit(1)).alias("listings"), F.count_distinct("p_name").alias("names"),
    ).drop("id")


@query("""
SELECT a.p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 1 WHEN p_partkey % 5 = 1 THEN 2 WHEN p_partkey % 5 = 2 THEN 4 ELSE 3 END AS level,
  CASE WHEN p_partkey % 5 = 0 THEN 1.0 WHEN p_partkey % 5 = 1 THEN 0.95 WHEN p_partkey % 5 = 2 THEN 0.5 ELSE 0.8 END::DOUBLE AS confidence, p_partkey % 5 = 2 AS review FROM part a""")
def match_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    level = gpu.match_level(F.when(k == 0, "AB-12345"), F.when(k == 1, F.col("p_name")), F.col("p_brand"), F.when(k != 2, F.col("p_type")), F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", level.alias("m")).select("p_partkey", "m.*")


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT q.vec_id AS "query", v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS cosine FROM v JOIN v q ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id
WHERE list_cosine_similarity(q.e, v.e) >= 0.2""")
def similarity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDN-9: every vector whose id is divisible by 20 against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    found = analytics.similar(vectors, "vec_id", "embedding", vectors.where("vec_id % 20 = 0"), 0.2)
    return found.withColumn("cosine", F.round("cosine", 6))


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'IN_STOCK' WHEN 'F' THEN 'OUT_OF_STOCK' ELSE 'UNKNOWN' END AS stock,
  CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 3 = 1 THEN 2500 END AS fee, round(o_totalprice + CASE WHEN o_orderkey % 3 = 1 THEN 2500 ELSE 0 END, 4) AS final_price FROM orders""")
def offer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    stock = F.when(F.col("o_orderstatus") == "O", "판매중").when(F.col("o_orderstatus") == "F", " Out of stock ").otherwise("?")
    fee = text.shipping_fee(F.when(k == 0, "무료배송").when(k == 1, "2,500원").otherwise("문의"))
    total = text.final_price(F.col("o_totalprice"), fee, F.lit(None))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.lookup(stock, D.STOCK_STATES).alias("stock"), fee.alias("fee"), F.round(total, 4).alias("final_price"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN nullif(trunc(value)::BIGINT, 0) WHEN event_id % 4 = 1 AND value > 0 THEN trunc(value)::BIGINT WHEN event_id % 4 = 2 THEN NULL ELSE nullif(trunc(value)::BIGINT, 0) END AS price FROM events")
def json_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM-1, SRC-14: prices as JSON whole numbers, fractions, negative numbers and texts."""
    k, whole = F.col("event_id") % 4, F.floor("value").cast("bigint").cast("string")
    shown = F.when(k == 0, whole).when(k == 1, F.col("value").cast("decimal(12,2)").cast("string")).when(k == 2, F.concat(F.lit("-1"), whole)).otherwise(F.concat(F.lit('"₩ '), whole, F.lit('"')))
    events = table(spark, sf_dir, "events").select("event_id", F.parse_json(shown).alias("price"))
    return events.select("event_id", text.price_of(F.col("price"), "variant").alias("price"))


# ---- further reads, joins and lookups ---------------------------------------
@query("SELECT p_partkey, p_brand, p_type FROM part WHERE p_size > 10")
def active_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RD-1."""
    return catalog.active(table(spark, sf_dir, "part").withColumn("active", F.col("p_size") > 10)).select("p_partkey", "p_brand", "p_type")


@query("SELECT p_partkey, p_brand, p_name FROM part WHERE p_size = 20")
def products_of_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RD-2."""
    return catalog.by_key(table(spark, sf_dir, "part"), p_size=20).orderBy("p_brand", "p_partkey").select("p_partkey", "p_brand", "p_name")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_suppkey = 3")
def listings_of_mall_by_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RD-4."""
    found = catalog.by_price(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_orderkey", "l_linenumber", l_suppkey=3)
    return found.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(f"SELECT listing_id, event_id, price FROM {PRICES} WHERE listing_id = 5")
def price_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RD-7."""
    return catalog.chart(_prices(spark, sf_dir), "ts", "event_id", listing_id=5).select("listing_id", "event_id", "price")


@query("SELECT o_orderkey, o_orderstatus, l_linenumber, l_linestatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def logs_of_failed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-10: orders as jobs, their lines as logs."""
    jobs = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")
    logs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_linestatus")
    return catalog.logs_of_jobs(jobs, logs, "o_orderkey")


@query("SELECT p_partkey, p_partkey % 4 IN (1, 2) AS other FROM part")
def not_a_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-15."""
    k = F.col("p_partkey") % 4
    tail = F.when(k == 0, " 16GB").when(k == 1, " 노트북").when(k == 2, " power Cable").otherwise(" OC")
    return table(spark, sf_dir, "part").select("p_partkey", gpu.not_a_card(F.concat(F.lit("rtx 5080 "), "p_brand", tail)).alias("other"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'ASUS' WHEN 1 THEN 'MSI' WHEN 2 THEN 'ZOTAC' ELSE o_orderpriority END AS brand,
  CASE o_orderkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  CASE o_orderkey % 4 WHEN 0 THEN 'NEW' WHEN 1 THEN 'USED' WHEN 2 THEN 'OPEN_BOX' ELSE 'UNKNOWN' END AS condition,
  CASE o_orderkey % 4 WHEN 0 THEN 'OFFICIAL' WHEN 1 THEN 'PARALLEL_IMPORT' ELSE 'UNKNOWN' END AS import,
  CASE o_orderkey % 4 WHEN 2 THEN 'HITINFO' ELSE o_clerk END AS seller
FROM (SELECT *, 'Clerk ' || o_custkey AS o_clerk FROM orders)""")
def documented_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-10, 11, 14, 15: aliases of brands and sellers, source confidence, condition and import."""
    k = F.col("o_orderkey") % 4
    pick = lambda *names: F.when(k == 0, names[0]).when(k == 1, names[1]).when(k == 2, names[2])
    seller = F.when(k == 2, " 히트정보 ").otherwise(F.concat(F.lit("Clerk "), F.col("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.alias(pick("AsusTek", "Micro-Star", "조텍").otherwise(F.col("o_orderpriority")), D.BRAND_ALIASES).alias("brand"),
        text.lookup(pick("official", "Marketplace", "?").otherwise(F.lit("")), D.CONFIDENCE, "LOW").alias("confidence"),
        text.lookup(pick("신품", " USED", "open box").otherwise(F.lit("?")), D.CONDITIONS).alias("condition"),
        text.lookup(pick("정품", "Parallel", "?").otherwise(F.lit("")), D.IMPORTS).alias("import"), text.alias(seller, {"히트정보": "HITINFO"}).alias("seller"),
    )


@query("SELECT user_id, day, price, count(*) AS records FROM (SELECT user_id, ts::DATE AS day, trunc(value / 50)::BIGINT AS price FROM events) GROUP BY ALL HAVING count(*) > 1")
def repeated_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-16: price records of one day and price stored more than once."""
    rows = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.floor(F.col("value") / 50).cast("bigint").alias("price"))
    return analytics.repeated_prices(rows, "user_id", "day", "price")


_OFFERS_SQL = """
SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'AB ' || p_size || p_brand END AS mpn, upper(p_brand) AS brand, CASE WHEN p_partkey % 5 <> 4 THEN upper(replace(p_type, ' ', '')) END AS chip,
  p_size AS vram, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' OC' ELSE '' END AS name, p_partkey % 2 = 0 AS oc, p_partkey % 7 = 0 AS used FROM part"""


@query(f"""
WITH l AS ({_OFFERS_SQL}), r AS (SELECT * REPLACE (id + 1000000 AS id, id % 3 = 0 AS used) FROM l),
m AS (
  SELECT l.id AS left_id, r.id AS right_id, 1 AS level FROM l JOIN r ON l.used = r.used AND upper(regexp_replace(l.mpn, '[^A-Za-z0-9]+', '', 'g')) = upper(regexp_replace(r.mpn, '[^A-Za-z0-9]+', '', 'g'))
  UNION ALL SELECT l.id, r.id, 3 FROM l JOIN r ON l.used = r.used AND l.brand = r.brand AND l.chip = r.chip AND l.vram = r.vram AND l.oc = r.oc
  UNION ALL SELECT l.id, r.id, 4 FROM l JOIN r ON l.used = r.used AND upper(trim(l.name)) = upper(trim(r.name)) AND l.vram = r.vram AND l.oc = r.oc)
SELECT left_id, b.right_id, b.level, CASE b.level WHEN 1 THEN 1.0 WHEN 3 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence, b.level = 4 AS review
FROM (SELECT left_id, arg_min({{'level': level, 'right_id': right_id}}, level * 100000000 + right_id) AS b FROM m GROUP BY left_id)""")
def match_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDN-8, IDN-10: parts as offers of two sources, which differ in what is used."""
    parts, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    none = F.lit(None).cast("string")
    left = parts.select(
        k.alias("id"), F.when(k % 5 == 0, F.concat(F.lit("ab-"), F.col("p_size").cast("string"), "p_brand")).alias("mpn"), none.alias("model_name"), F.col("p_brand").alias("brand"),
        F.when(k % 5 != 4, F.col("p_type")).alias("gpu_model"), F.col("p_size").alias("vram_gb"), F.concat("p_name", F.when(k % 2 == 0, " OC").otherwise("")).alias("name"),
        F.when(k % 7 == 0, "used").alias("condition"),
    )
    right = left.withColumns({"condition": F.when(F.col("id") % 3 == 0, "USED").otherwise("new"), "id": F.col("id") + 1_000_000})
    return matching.match_sources(left, right)


_UPSERTS_SQL = "SELECT p_partkey AS k, 'SSG_' || p_partkey AS listing_id, 'ZOTAC-RTX' || (p_size + 4000) || '-SOLIDCORE-16GB' AS product_id, nullif(floor(p_retailprice)::BIGINT, 0) AS price FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 3 <> 0"


def _two_batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The valid parts, and half of them again at another price without an image."""
    valid = listing.process(_raw_parts(spark, sf_dir).withColumn("image_url", F.lit("//i/1.jpg"))).where("error IS NULL")
    again = valid.where("p_partkey % 2 = 0").withColumns({"price": F.col("price") + 1000, "image_url": F.lit(None).cast("string"), "seq": F.col("seq") + 10_000_000})
    return [valid, again]


@query(f"SELECT listing_id, product_id, price + CASE WHEN k % 2 = 0 THEN 1000 ELSE 0 END AS current_price, 'https://i/1.jpg' AS image_url, CASE WHEN k % 2 = 0 THEN '2026-09-02' ELSE '2026-09-01' END AS updated FROM ({_UPSERTS_SQL})")
def listing_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPS-3, JN-8: listings after two batches."""
    now = spark.createDataFrame([], LISTINGS)
    for day, batch in enumerate(_two_batches(spark, sf_dir), 1):
        now = upsert.upsert_listings(now, batch, F.lit(f"2026-09-0{day} 00:00:00").cast("timestamp"))
    return now.select("listing_id", "product_id", "current_price", "image_url", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query(f"SELECT product_id AS canonical_product_id, 'ZOTAC' AS brand, TRUE AS active, '2026-09-01' AS created, CASE WHEN bool_or(k % 2 = 0) THEN '2026-09-02' ELSE '2026-09-01' END AS updated FROM ({_UPSERTS_SQL}) GROUP BY 1")
def product_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPS-2, JN-7: products after two batches."""
    now = spark.createDataFrame([], PRODUCTS)
    for day, batch in enumerate(_two_batches(spark, sf_dir), 1):
        now = upsert.upsert_products(now, batch, F.lit(f"2026-09-0{day} 00:00:00").cast("timestamp"))
    return now.select("canonical_product_id", "brand", "active", *[F.date_format(f"{c}_at", "yyyy-MM-dd").alias(c) for c in ("created", "updated")])


@query(f"""
SELECT 'SSG_' || user_id AS listing_id, at_ms, price, previous_price, price - previous_price AS price_change
FROM (SELECT *, epoch_us(ts) // 1000 AS at_ms, lag(price) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_price FROM (SELECT user_id, event_id, ts, trunc(value / 50)::BIGINT AS price FROM events))
WHERE previous_price IS NULL OR previous_price <> price""")
def price_history_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPS-4, AGG-1: history of two batches, the second over the latest prices after the first, in the order of time."""
    rows = _prices(spark, sf_dir).select(F.concat(F.lit("SSG_"), F.col("listing_id").cast("string")).alias("listing_id"), F.row_number().over(Window.partitionBy("listing_id").orderBy("ts", "event_id")).cast("bigint").alias("seq"),
                                         F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "price", "ts")
    early = rows.where("ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'").drop("ts")
    latest = history.merge_latest(spark.createDataFrame([], LATEST), first := history.replay(early))
    second = history.replay(rows.where("ts >= TIMESTAMP_NTZ '2024-01-15 00:00:00'").drop("ts"), latest=latest)
    both = first.withColumn("batch", F.lit(1)).unionByName(second.withColumn("batch", F.lit(2)))
    return history.newest(both).select("listing_id", "at_ms", "price", "previous_price", "price_change")


@query(SQL["similarity_match"])
def similarity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDN-9: the same search under the name it was first registered by."""
    return similarity_match(spark, sf_dir)
