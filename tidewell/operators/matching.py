"""Products of two sources matched level by level: IDN-8, with the cases of IDN-10 kept apart.

Levels: 1 part number, 2 model number, 3 structured parts, 4 exact name.  New
and used are never one product, whatever the level; a name with OC and one
without, or two memory sizes, are none at the levels that have no identifier.
Of the right source one row a key is kept before the join (that with the
smallest id), so a key that many rows share makes no pairs among them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, slug_token

CONFIDENCE = (1.0, 0.95, 0.8, 0.5)  # the documented examples
REVIEW_UNDER = 0.8


def overclocked(name: Column) -> Column:
    return F.coalesce(F.rlike(F.upper(name), F.lit(r"(?U)\bO(C|\d+G)\b")), F.lit(False))


def level_keys() -> list[Column]:
    """A text for each level, null where a row has none; rows with equal texts match."""
    state = F.upper(F.coalesce("condition", F.lit("NEW")))
    oc = overclocked(F.col("name")).cast("string")
    memory = F.coalesce(F.col("vram_gb").cast("string"), F.lit(""))

    def key(*parts: Column) -> Column:
        present = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
        return F.when(present, F.concat_ws("|", state, *parts))

    return [
        key(blank_to_null(slug_token(F.col("mpn")))), key(blank_to_null(slug_token(F.col("model_name")))),
        key(F.upper("brand"), F.upper(F.replace("gpu_model", F.lit(" "))), F.col("vram_gb").cast("string"), oc),
        key(blank_to_null(F.upper(F.trim("name"))), memory, oc),
    ]


def match_sources(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, level, confidence, review) of each left row that matches: its best level, there the smallest id.

    Both have id, mpn, model_name, brand, gpu_model, vram_gb, name, condition.
    """

    def dealt(df: DataFrame, name: str) -> DataFrame:
        df = df.select(F.col("id").alias(name), F.posexplode(F.array(*level_keys())).alias("level", "key"))
        return df.where(F.col("key").isNotNull())

    first = dealt(right, "right_id").groupBy("level", "key").agg(F.min("right_id").alias("right_id"))
    best = dealt(left, "left_id").join(first, ["level", "key"]).groupBy("left_id").agg(F.min(F.struct("level", "right_id")).alias("m"))
    confidence = F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.col("m.level") + 1)
    return best.select("left_id", "m.right_id", (F.col("m.level") + 1).alias("level"), confidence.alias("confidence"), (confidence < REVIEW_UNDER).alias("review"))
