"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, packing.

Each stage takes the documents that its predecessor kept and returns those it
keeps, with the same columns; the last returns the packed pieces.  A near copy
is one of similarity 0.8 in five-word shingles: fingerprints of these find
the first by op1's covering tables, exact prefixes those that are further apart;
op1's contract of four words and four bits binds its query alone.  A mixture
may take a document in several epochs, so mixing may return a row repeatedly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.exact_dedup import exact_dedup
from tidewell.llm.mixing import mix
from tidewell.llm.near_copies import near_copies
from tidewell.llm.packing import pack
from tidewell.llm.quality import quality
from tidewell.llm.scratch import Scratch
from tidewell.session import for_documents, ship


# the operators name columns of their own; any other column of docs stands aside under a free name
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


_held: dict[str, list[Scratch]] = {}  # application -> tables of stages whose results may still be read


def _scratch(spark: SparkSession, docs: DataFrame) -> Scratch:
    """Tables of a stage; those of stages before it go, unless docs still reads them."""
    held = _held.setdefault(spark.sparkContext.applicationId, [])
    files = docs.inputFiles() if held else []
    for old in [x for x in held if not any(x.root.rsplit("/", 1)[-1] in f for f in files)]:
        old.clear()
        held.remove(old)
    held.append(Scratch(ship(for_documents(spark))))
    return held[-1]


def _beside(docs: DataFrame, operate: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """operate(docs, its columns) with the columns of docs alone, each under its own name."""
    names = [c if c in DOCUMENT else f"beside_{i}" for i, c in enumerate(docs.columns)]
    return operate(docs.toDF(*names), names).select(names).toDF(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _beside(docs, lambda d, names: quality(d, _scratch(spark, docs), carry=names).where("kept"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _beside(docs, lambda d, names: exact_dedup(d, _scratch(spark, docs), carry=names).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _beside(docs, lambda d, names: near_copies(d, _scratch(spark, docs), carry=names).where(F.col("first")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _beside(docs, lambda d, names: mix(d, _scratch(spark, docs), carry=names))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, _scratch(spark, docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # quality rules, fingerprints and packing are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents; each stage is written and read again."""
    scratch = Scratch(ship(for_documents(spark)))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
    for done in _held.pop(spark.sparkContext.applicationId, []):  # the last result is written, too
        done.clear()
    return docs
