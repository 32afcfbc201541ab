"""Price statistics from sketches of a day, merged for any period.

A day's prices of a key become one row: a KLL sketch of the prices, an HLL
sketch of the sellers, and exact count, sum, least and greatest.  Any period is
then a merge of its days' rows, so that rolling or repeated questions read one
small row a key and day and never the prices again.  Sketches have a bounded
size, and a hot key is summed in the tasks before it moves.

Bounds: with k = 200 the rank of a quantile is off by at most RANK_ERROR of the
observations (twice the error of 99 % of sketches), less with a larger k; up to
k observations it is exact.  With 2^12 registers the number of sellers is off by
at most SELLERS_ERROR of it, six standard errors; of some hundreds it is nearly exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 200
REGISTERS = 12  # as a power of two
RANK_ERROR = 0.0266
SELLERS_ERROR = 0.1


def daily(rows: DataFrame, key: list[str], time: str, price: str, seller: str, k: int = K, registers: int = REGISTERS) -> DataFrame:
    """A row a key and day: observations, total, min_price, max_price, prices (KLL), sellers (HLL); rows without a price or time are no observations."""
    known = rows.where(F.col(price).isNotNull() & F.col(time).isNotNull())
    p = F.col(price).cast("double")
    return known.groupBy(*key, F.to_date(time).alias("day")).agg(
        F.count(F.lit(1)).alias("observations"), F.sum(price).alias("total"), F.min(price).alias("min_price"), F.max(price).alias("max_price"),
        F.kll_sketch_agg_double(p, F.lit(k)).alias("prices"), F.hll_sketch_agg(seller, F.lit(registers)).alias("sellers"),
    )


def merged(days: DataFrame, by: list[Column | str], k: int = K) -> DataFrame:
    """The rows of several days as one row for each value of `by`: any period, any coarser key."""
    return days.groupBy(*by).agg(
        F.sum("observations").alias("observations"), F.sum("total").alias("total"), F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price"),
        F.kll_merge_agg_double("prices", F.lit(k)).alias("prices"), F.hll_union_agg("sellers").alias("sellers"),
    )


def between(days: DataFrame, begin: str, end: str) -> DataFrame:
    """The days from begin up to end, that day not included."""
    return days.where((F.col("day") >= F.lit(begin).cast("date")) & (F.col("day") < F.lit(end).cast("date")))


def statistics(sketched: DataFrame, quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """Rows of `daily` or `merged` with avg_price, the quantiles as q<percent> and the number of sellers, sketches left out."""
    found = {f"q{round(100 * q)}": F.kll_sketch_get_quantile_double("prices", F.lit(q)) for q in quantiles}
    found |= {"avg_price": F.col("total") / F.col("observations"), "seller_count": F.hll_sketch_estimate("sellers")}
    return sketched.withColumns(found).drop("prices", "sellers", "total")
