"""Extraction of structured attributes from names, and canonical identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dictionaries as D
from .text import blank_to_null, slug_token

MODELS = (
    (r"(?iU)\b(RTX|GTX)\s*(\d{4})(?:\s*(Ti|SUPER))?\b", None),
    (r"(?iU)\b(RX)\s*(\d{4})(?:\s*(XT|XTX))?\b", None),
    (r"(?iU)\b(Arc)\s*([A-Za-z]\d+)\b", "Arc"),
)
MEMORY = r"(?iU)\b(\d{1,3})\s*(?:GB|G|기가)\b"
PART_NUMBER = r"(?U)\b([A-Z]{2,3}-[A-Z0-9-]{5,})\b"
FULL_WIDTH = "０１２３４５６７８９"


def first_contained(text: Column, names: tuple[str, ...]) -> Column:
    found = F.lit(None).cast("string")
    for name in reversed(names):
        found = F.when(F.contains(text, F.lit(name)), name).otherwise(found)
    return found


def brand(text: Column) -> Column:
    """EXT-1: the longest partner name contained, whatever the case."""
    return first_contained(F.upper(text), tuple(sorted(D.BOARD_PARTNERS, key=len, reverse=True)))


def model(text: Column) -> Column:
    """EXT-2..5: struct (series, model), null if there is none."""
    found = F.lit(None).cast("struct<series:string,model:string>")
    for pattern, fixed in reversed(MODELS):
        parts = [F.upper(F.regexp_extract(text, pattern, i)) for i in ((1, 2) if fixed else (1, 2, 3))]
        series = F.lit(fixed) if fixed else parts[0]
        name = F.concat_ws(" ", series, *[blank_to_null(p) for p in parts[1:]])
        found = F.when(parts[0] != "", F.struct(series.alias("series"), name.alias("model"))).otherwise(found)
    return found


def memory_gb(text: Column) -> Column:
    """EXT-6: the largest size named."""
    sizes = F.regexp_extract_all(text, F.lit(MEMORY), F.lit(1))
    return F.array_max(F.transform(sizes, lambda s: F.translate(s, FULL_WIDTH, "0123456789").try_cast("int")))


def part_number(text: Column) -> Column:
    """EXT-7."""
    return blank_to_null(F.regexp_extract(F.upper(text), PART_NUMBER, 1))


def has_keyword(text: Column) -> Column:
    """EXT-8: a substring will do."""
    return F.rlike(F.upper(text), F.lit("|".join(D.KEYWORDS)))


def not_a_card(text: Column) -> Column:
    """VAL-15: the keyword is there, but the name is of something else."""
    named = F.lit(False)
    for word in D.NOT_CARDS:
        named = named | F.contains(F.upper(text), F.lit(word))
    return has_keyword(text) & named


def variant(name: Column) -> Column:
    """EXT-10."""
    return first_contained(F.replace(F.upper(name), F.lit(" "), F.lit("")), D.VARIANTS)


def memory_type(text: Column) -> Column:
    """EXT-11."""
    return blank_to_null(F.regexp_extract(F.upper(text), r"(?U)\b(GDDR\d[A-Z]?|HBM\d?[A-Z]?)\b", 1))


def canonical_id(mpn: Column, model_name: Column, brand: Column, gpu_model: Column, vram: Column, name: Column) -> Column:
    """IDN-1..4: part number, model number, structured parts, digest of the name."""
    by_model = blank_to_null(slug_token(model_name))
    compact = F.upper(F.replace(gpu_model, F.lit(" "), F.lit("")))
    parts = F.concat_ws("-", F.upper(brand), compact, variant(F.coalesce(name, F.lit(""))), F.concat(vram.cast("string"), F.lit("GB")))
    whole = (F.coalesce(brand, F.lit("")) != "") & (F.coalesce(gpu_model, F.lit("")) != "") & vram.isNotNull()
    digest = F.concat(F.lit("NAME-"), F.upper(F.substring(F.sha1(name.cast("binary")), 1, 16)))
    return (
        F.when(mpn != "", slug_token(mpn)).when(by_model.isNotNull(), by_model).when(whole, parts).when(name != "", digest)
    )


def match_level(mpn: Column, model_name: Column, brand: Column, gpu_model: Column, vram: Column) -> Column:
    """IDN-8: struct (level, confidence, review); the confidences are the documented examples."""
    structured = brand.isNotNull() & gpu_model.isNotNull() & vram.isNotNull()
    level = F.when(mpn != "", 1).when(blank_to_null(slug_token(model_name)).isNotNull(), 2).when(structured, 3).otherwise(4)
    confidence = F.element_at(F.array(*map(F.lit, (1.0, 0.95, 0.8, 0.5))), level)
    return F.struct(level.alias("level"), confidence.alias("confidence"), (confidence < 0.8).alias("review"))
