"""Order-aware building blocks (WIN-*, SORT-*, SET-05..08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(keys: list[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_sum(value: Column, keys: list[str], order: list[str], inclusive: bool = True) -> Column:
    span = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return F.coalesce(F.sum(value).over(span), F.lit(0))


def same_as_previous(value: str, keys: list[str], order: list[str]) -> Column:
    """Whether a value equals the row before it; a null equals a null, the first row nothing."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (F.row_number().over(w) > 1) & F.col(value).eqNullSafe(F.lag(value).over(w))


def with_island(df: DataFrame, value: str, keys: list[str], order: list[str], name: str = "island") -> DataFrame:
    """Numbers the runs of equal neighbours from 1."""
    fresh = df.withColumn("_fresh", (~same_as_previous(value, keys, order)).cast("int"))
    return fresh.withColumn(name, F.sum("_fresh").over(running(keys, *order))).drop("_fresh")


def consecutive_groups(df: DataFrame, position: str, keys: list[str], name: str = "run") -> DataFrame:
    """Rows whose positions follow one another share ``position - rank``."""
    return df.withColumn(name, F.col(position) - F.row_number().over(Window.partitionBy(*keys).orderBy(position)))


def blank_repeats(value: str, keys: list[str], order: list[str]) -> Column:
    return F.when(same_as_previous(value, keys, order), "").otherwise(F.col(value))


def row_difference(value: str, keys: list[str], order: list[str]) -> Column:
    return F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key; filtering on the rank lets Spark cut early in each task."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first by an explicit order."""
    return top_k(df, keys, order, 1, "_place").drop("_place")


def seeded_order(key: str, seed: int) -> Column:
    """A reproducible shuffle key that other engines compute alike."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def ordered_rank(df: DataFrame, coarse: list[Column], order: list[Column], name: str = "rank") -> DataFrame:
    """Places from 1 in the order of all rows, without one task that sorts them all.

    ``coarse`` are ascending bucket expressions that agree with ``order``: rows of an earlier
    bucket come earlier. Only the table of bucket sizes is summed up in one place.
    """
    keys = [f"_b{i}" for i in range(len(coarse))]
    rows = df.withColumns(dict(zip(keys, coarse)))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_own", own).join(sizes, keys).withColumn(name, (F.col("_base") + F.col("_own")).cast("int")).drop(*keys, "_own", "_base")


def hash_bucket(key: str, buckets: int = 100) -> Column:
    """The first eight hex digits of the key's md5, modulo ``buckets``."""
    return (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold nothing but nulls (one aggregate over the table)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c]])


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of an order; every task hands on ``n`` rows at most."""
    return df.orderBy(*order).limit(n)


def last_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of an ascending order, in that order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows drawn without replacement: those of the smallest seeded hashes of their key."""
    return df.orderBy(seeded_order(key, seed), key).limit(n)
