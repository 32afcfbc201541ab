"""Exact deduplication by distributed MSD radix partitioning.

The radix key of a text is its byte length followed by its bytes, A-Z
lower-cased.  Round 0 groups all rows by the length and the first bytes; each
later round splits the groups that are still open by their next bytes, with a
digit that grows sixteenfold, so the number of rounds is logarithmic in the
longest text.  A group leaves when it is a singleton or when its texts have
ended; texts are compared byte by byte and no digest decides anything.

A round is one aggregation (pre-summed in the tasks, so a group of copies is
one row per task) and one equi-join back, which AQE may split where a group is
hot; the joins are sort-merge at every size, so that a small run moves the same
share of its input as a large one.  No round gathers a group.  Only open rows
keep their text between rounds.

Defined results: null text counts as empty; empty texts equal each other;
repeated rows are copies, of which exactly one is kept; null doc_id sorts below
every other; an empty table gives an empty result; extra columns may be carried
along, except those named like a result column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

FIRST_DIGIT = 56
SECOND_DIGIT = 1024
GROWTH = 16
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


@F.arrow_udf(T.BinaryType())
def lower_bytes(b: pa.Array) -> pa.Array:
    """A-Z to a-z, byte by byte; a digit may start or end inside a character."""
    return pc.ascii_lower(b.view(pa.string())).view(pa.binary())


@F.arrow_udf(T.StringType())
def lower_sha256(b: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x.lower()).hexdigest() for x in b.to_pylist()], pa.string())


def _bytes() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).cast("binary")


def _digit(offset: int, width: int) -> Column:
    return lower_bytes(F.substring(_bytes(), offset + 1, width))


def exact_dedup(docs: DataFrame, scratch: Scratch, carry: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Every row of docs (its carried columns) with keep_id, group_size, kept, text_sha256."""
    carry = [c for c in carry if c not in RESULT]
    own = [c for c in carry if c != "text"]
    rows = docs.select("text", F.col("doc_id").alias("id"), F.struct(F.lit(0).alias("_"), *own).alias("row"))
    rows = rows.withColumn("length", F.octet_length(_bytes())).withColumn("digit", _digit(0, FIRST_DIGIT))

    groups = rows.groupBy("length", "digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = scratch.cut(groups.select("length", "digit", F.monotonically_increasing_id().alias("gid")), "groups0")

    def still_open(is_open: Column) -> Column:
        return F.col("text") if "text" in carry else F.when(is_open, F.col("text"))

    table = scratch.cut(
        rows.join(groups.hint("merge"), ["length", "digit"], "left").select(
            F.monotonically_increasing_id().alias("rid"), "id", "row", "length", "gid",
            lower_sha256(_bytes()).alias("text_sha256"), still_open(F.col("gid").isNotNull()).alias("text"),
        ),
        "rows0",
    )
    done = [table.where("gid is null").select("*", F.lit(1).cast("long").alias("n"), F.struct("id", "rid").alias("keep"))]

    offset, width, step = FIRST_DIGIT, SECOND_DIGIT, 0
    while not (still := table.where("gid is not null")).isEmpty():
        step += 1
        still = still.select("rid", "id", "row", "length", "gid", "text_sha256", "text", _digit(offset, width).alias("digit"))
        groups = still.groupBy("gid", "digit").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "rid")).alias("keep"))
        groups = scratch.cut(groups.withColumn("next", F.monotonically_increasing_id()), f"groups{step}")
        is_open = (F.col("n") > 1) & (F.col("length") > offset + width)
        table = scratch.cut(
            still.join(groups.hint("merge"), ["gid", "digit"]).select(
                "rid", "id", "row", "length", F.when(is_open, F.col("next")).alias("gid"), "text_sha256",
                still_open(is_open).alias("text"), "n", "keep",
            ),
            f"rows{step}",
        )
        scratch.drop(f"groups{step}")
        done.append(table.where("gid is null"))
        offset, width = offset + width, width * GROWTH

    columns = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in carry]
    out = [
        t.select(*columns, F.col("keep")["id"].alias("keep_id"), F.col("n").alias("group_size"),
                 (F.col("keep")["rid"] == F.col("rid")).alias("kept"), "text_sha256")
        for t in done
    ]
    result = out[0]
    for more in out[1:]:
        result = result.unionAll(more)
    return result
