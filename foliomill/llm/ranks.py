"""Places in a total order, without one task that holds the order.

The order is a 64-bit hash. Its leading bits name a bucket; counts (or weights) of the
buckets are summed up in a small table, and only the rows of one bucket are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket should hold at most, on average.
BUCKET_ROWS = 20_000


def bits_for(rows: int) -> int:
    """Bits of a bucket's name, so that a bucket stays small however many rows there are."""
    return min(24, max(6, (rows // BUCKET_ROWS).bit_length()))


def with_before(df: DataFrame, keys: list[str], order: str, ties: list[str], weight: Column, bits: int, name: str = "before", kind: str = "long") -> DataFrame:
    """``df`` with ``name``: the weight of all rows of the same keys that come earlier.

    ``order`` is a long column of hashes, compared as unsigned; equal ones go by ``ties``.
    """
    rows = df.withColumn("_bucket", F.shiftrightunsigned(order, 64 - bits)).withColumn("_weight", weight)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_weight").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    # Within a bucket the leading bits agree, so signed comparison of the rest orders alike.
    within = Window.partitionBy(*keys, "_bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum("_weight").over(within), F.lit(0)))
    return rows.join(sums, [*keys, "_bucket"]).withColumn(name, (F.col("_base") + F.col("_own")).cast(kind)).drop("_bucket", "_weight", "_own", "_base")
