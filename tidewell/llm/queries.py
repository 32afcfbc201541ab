"""The registered queries of the operators and their SQL, over whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import byte_bpe
from .chat import conversation_digests, windows
from .divergence import divergence
from .exact_dedup import exact_dedup
from .html_extract import default_field, extract_text
from .mixing import DEFAULT_WEIGHT, MAX_EPOCHS, WEIGHTS, mix
from .mixing import SEED as MIX_SEED
from .packing import pack
from .phrases import phrases
from .quality import quality
from .scratch import Scratch
from .sharding import BITS, LIMIT, shard
from .simhash_dedup import near_duplicates
from .toxicity import score_toxicity
from .toxicity import train as train_toxicity
from .url_filter import filter_urls, labelled_urls, train

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark))
    return found.select("doc_id", "fingerprint", "component_id")


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), Scratch(spark))


SQL["op3_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), Scratch(spark))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), Scratch(spark))


def _share_sql(parent: str, child: str, level: str, weights: dict[str, int]) -> str:
    """A level of the budget tree: `{parent}_b` has the parents' budgets, `{child}_b` gets the children's."""
    path = {"root": "root", "dom": "root, domain", "lng": "root, domain, language", "org": "root, domain, language, origin"}
    weight = " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in weights.items())
    same = " AND ".join(f"c.{x.strip()} IS NOT DISTINCT FROM p.{x.strip()}" for x in path[parent].split(","))
    names = ", ".join("c." + x.strip() for x in path[child].split(","))
    return f"""
{child}_c AS (SELECT {names}, c.cap, p.budget, c.weight
  FROM (SELECT {path[child]}, sum(cap)::HUGEINT AS cap, CASE {weight} ELSE {DEFAULT_WEIGHT} END::HUGEINT AS weight
        FROM leaf GROUP BY {path[child]}) c JOIN {parent}_b p ON {same}),
{child}_w AS (SELECT *,
    coalesce(sum(cap) OVER (PARTITION BY {path[parent]} ORDER BY cap / weight, {level} NULLS FIRST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(weight) OVER (PARTITION BY {path[parent]} ORDER BY cap / weight, {level} NULLS FIRST
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {child}_c),
{child}_f AS (SELECT *, cap * rest + filled * weight <= budget * weight AS full_ FROM {child}_w),
{child}_b AS (SELECT {path[child]}, least(greatest(CASE WHEN full_ THEN cap ELSE
    ((budget - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER (PARTITION BY {path[parent]})) * weight)
    // sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (PARTITION BY {path[parent]}) END, 0), cap) AS budget
  FROM {child}_f)"""


SQL["op4_mixing"] = f"""
WITH doc AS (
  SELECT doc_id, lang AS language, source AS origin,
         CASE source {" ".join(f"WHEN 'src{i}' THEN 'd{zlib.crc32(f'src{i}'.encode()) % 4}'" for i in range(20))} END AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens, md5(coalesce(text, '')) AS text_md5
  FROM documents),
leaf AS (SELECT '' AS root, domain, language, origin, sum(tokens) AS tokens, sum(tokens) * {MAX_EPOCHS} AS cap
  FROM doc GROUP BY domain, language, origin),
root_b AS (SELECT '' AS root, sum(tokens)::HUGEINT AS budget FROM doc),
{",".join(_share_sql(p, c, level, WEIGHTS[level]) for p, c, level in
          (("root", "dom", "domain"), ("dom", "lng", "language"), ("lng", "org", "origin")))},
plan AS (SELECT l.domain, l.language, l.origin, (b.budget // greatest(l.tokens, 1))::BIGINT AS epochs,
    (b.budget % greatest(l.tokens, 1))::BIGINT AS rest
  FROM leaf l JOIN org_b b USING (domain, language, origin)),
keyed AS (SELECT d.*, p.epochs, p.rest, md5(concat_ws(':', '{MIX_SEED}', p.epochs::VARCHAR, d.doc_id::VARCHAR, d.text_md5)) AS key
  FROM doc d JOIN plan p USING (domain, language, origin)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, origin ORDER BY key) AS upto FROM keyed)
SELECT doc_id, domain, language, origin, tokens::BIGINT AS tokens,
       unnest(range(0, epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END))::BIGINT AS epoch
FROM summed
"""


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), Scratch(spark))


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), Scratch(spark))


SQL["op2_sharding"] = f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS bytes,
         bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, {BITS // 4}))::UBIGINT) AS b
  FROM documents),
h AS (SELECT doc_id, bytes, lpad(b, {BITS}, '0') AS hash FROM d),
deep AS (SELECT *, unnest(range(0, {BITS} + 1)) AS depth FROM h),
total AS (SELECT substr(hash, 1, depth) AS shard, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM deep GROUP BY 1),
fit AS (SELECT d.doc_id, d.bytes, d.depth, t.* FROM deep d JOIN total t ON t.shard = substr(d.hash, 1, d.depth)
        WHERE t.shard_bytes <= {LIMIT} OR d.depth = {BITS})
SELECT doc_id, bytes, '/' || arg_min(shard, depth) AS shard, arg_min(shard_bytes, depth) AS shard_bytes,
       arg_min(shard_rows, depth) AS shard_rows
FROM fit GROUP BY doc_id, bytes
"""


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-1, 0, 'user', '{said}'), (-1, 1, 'assistant', '{said}') AS v(conv_id, turn, role, text)")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digests(windows(conversations.unionAll(extra)))


_url_models: dict[str, tuple] = {}  # application -> what the default labelled urls give, fitted once


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, application = table(spark, sf_dir, "pages"), spark.sparkContext.applicationId
    if application not in _url_models:
        _url_models[application] = train(labelled_urls(spark))
    return filter_urls(pages, *_url_models[application])


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_toxicity(documents, train_toxicity(documents, table(spark, sf_dir, "labels")))


@query
def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"), default_field())


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"), Scratch(spark))


SQL["op11_phrases"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3)) AS sizes(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY lang, k, phrase),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cut AS (
  SELECT lang, k, phrase, f AS a, cut, string_split(phrase, ' ') AS w
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1 AND f >= 10)),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')),
candidate AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase
    FROM candidate WHERE k = 3) GROUP BY lang, phrase)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.phrase) AS rank
  FROM candidate c LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a) JOIN total USING (lang)
WHERE rank <= 2000
"""


@query
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"), Scratch(spark))


SQL["op12_divergence"] = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
holds AS (SELECT lang, unnest(list_distinct(terms)) AS term FROM d),
kept AS (SELECT lang, term FROM holds GROUP BY lang, term HAVING count(*) >= 10),
uses AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) JOIN kept USING (lang, term) GROUP BY ALL),
alluses AS (SELECT lang, term, sum(n) AS n FROM uses GROUP BY ALL),
langs AS (SELECT lang, coalesce(v, 0) AS v, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS total FROM alluses GROUP BY lang) USING (lang)),
groups AS (SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM uses GROUP BY ALL) USING (lang, source)),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 2)) // (g.total + 2 * l.v) AS p, 1 + (1000000000::HUGEINT * (a.n + 2)) // (l.total + 2 * l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) JOIN alluses a USING (lang, term) LEFT JOIN uses u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source JOIN langs l ON l.lang = a.lang WHERE v = 0),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", byte_bpe.encode(F.col("text")).alias("ids"))
    ids, digest = F.col("ids"), lambda c: F.sha2(c, 256)
    return documents.select(
        "doc_id", F.size(ids).cast("bigint").alias("n_tokens"), digest(byte_bpe.packed(ids)).alias("ids_sha256"), digest(byte_bpe.decode(ids)).alias("decoded_sha256")
    )
