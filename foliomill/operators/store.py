"""Content-addressed store on tables: lookups, inserts and merges as joins (STO-*).

The functions return the table that a writer then puts in place; last write wins within a
batch by its ordinal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .windows import keep_first


def get(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == value)


def last_of_batch(updates: DataFrame, key: str, ordinal: str) -> DataFrame:
    return keep_first(updates, [key], [F.desc(ordinal)]).drop(ordinal)


def create(table: DataFrame, rows: DataFrame, key: str, override: bool = False, ordinal: str | None = None) -> DataFrame:
    """Insert; an existing key stays, or is replaced with ``override``.

    Of new rows with the same key the last by ``ordinal`` counts, or any one without it.
    Columns that the new rows lack are null.
    """
    rows = last_of_batch(rows, key, ordinal) if ordinal else rows.dropDuplicates([key])
    if override:
        table = table.join(rows.select(key), key, "left_anti")
    else:
        rows = rows.join(table.select(key), key, "left_anti")
    return table.unionByName(rows, allowMissingColumns=True).select(table.columns)


def merge(table: DataFrame, updates: DataFrame, key: str, fields: list[str], ordinal: str) -> DataFrame:
    """Create or update: a field that is null in the update keeps its value, and so do other columns."""
    new = last_non_null(updates, key, fields, ordinal).select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    both = table.join(new, F.col(key) == F.col("_key"), "full")
    value = lambda c: F.coalesce(key, "_key").alias(c) if c == key else F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c)
    return both.select(*[value(c) for c in table.columns])


def last_non_null(updates: DataFrame, key: str, fields: list[str], ordinal: str) -> DataFrame:
    """A batch applied in order to itself: the last non-null value of each field."""
    return updates.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(ordinal))).alias(f) for f in fields])


def update(table: DataFrame, updates: DataFrame, key: str, fields: list[str], strict: bool = False, ordinal: str | None = None) -> DataFrame:
    """Update existing rows by the last non-null value of each field; with ``strict`` a missing key is an error.

    Without an ``ordinal`` a key that is updated twice takes the largest value.
    """
    if strict and (missing := updates.join(table.select(key), key, "left_anti").select(key).first()):
        raise ValueError(f"{key} {missing[0]!r} not found")
    new = last_non_null(updates, key, fields, ordinal) if ordinal else updates.groupBy(key).agg(*[F.max(f).alias(f) for f in fields])
    new = new.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    return table.join(new, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns])


def delete(table: DataFrame, keys: DataFrame, key: str, strict: bool = False) -> DataFrame:
    if strict and (missing := keys.join(table.select(key), key, "left_anti").select(key).first()):
        raise ValueError(f"{key} {missing[0]!r} not found")
    return table.join(keys.select(key), key, "left_anti")


def create_documents(documents: DataFrame, links: DataFrame, new: DataFrame, override: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents (id, name) and ordered links from rows of id, name, paragraph_ids."""
    new = new.dropDuplicates(["id"])
    fresh = new if override else new.join(documents.select("id"), "id", "left_anti")
    made = fresh.select(F.col("id").alias("document_id"), F.posexplode("paragraph_ids").alias("order", "paragraph_id"))
    kept = links.join(fresh.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    return create(documents, fresh.select("id", "name"), "id", override), kept.unionByName(made.select(kept.columns))


def update_documents(documents: DataFrame, links: DataFrame, changes: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents with new names, and new links where ``changes`` (id, name, paragraph_ids) has a list of paragraphs."""
    named = update(documents, changes, "id", ["name"], strict)
    known = changes.dropDuplicates(["id"]).join(documents.select("id"), "id", "left_semi").where("paragraph_ids is not null")
    made = known.select(F.col("id").alias("document_id"), F.posexplode("paragraph_ids").alias("order", "paragraph_id"))
    return named, links.join(known.select(F.col("id").alias("document_id")), "document_id", "left_anti").unionByName(made.select(links.columns))


def document_paragraphs(documents: DataFrame, links: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``document_id, name, order, paragraph_id, text`` of all documents, through the table of links."""
    named = documents.select(F.col("id").alias("document_id"), "name").join(links, "document_id")
    return named.join(paragraphs.select(F.col("id").alias("paragraph_id"), "text"), "paragraph_id").select("document_id", "name", "order", "paragraph_id", "text")


def predict_cached(requests: DataFrame, cache: DataFrame, key: str, predict: Callable[[DataFrame], DataFrame], legacy: bool = False) -> DataFrame:
    """Stored predictions for known keys; distinct unknown ones are predicted once, a null key among them.

    A stored row without a prediction is predicted too; ``legacy`` takes it for a hit.
    """
    usable = cache if legacy else cache.where("prediction is not null")
    known = usable.select(key, "prediction")
    hits = requests.join(known, key)
    unknown = requests.join(known.select(key), key, "left_anti")
    made = predict(unknown.dropDuplicates([key])).select(F.col(key).alias("_key"), "prediction")
    missed = unknown.join(made, unknown[key].eqNullSafe(made["_key"]))
    return hits.select(*requests.columns, "prediction").unionByName(missed.select(*requests.columns, "prediction"))


def read_validation(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The stored validation of each key, null where there is none."""
    return keys.join(table.select(key, "validation"), key, "left")


class TableCache:
    """Tables kept by key as Parquet below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, key: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{hashlib.sha256(key.encode()).hexdigest()}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, key: str) -> bool:
        """Whether a whole table is there: Spark leaves its mark last."""
        path, store = self._path(key)
        return store.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))

    def save(self, key: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(str(self._path(key)[0]))
        return self.load(key)

    def load(self, key: str) -> DataFrame:
        if not self.exists(key):
            raise KeyError(key)
        return self.spark.read.parquet(str(self._path(key)[0]))

    def clear(self, key: str | None = None) -> None:
        """Forget one table, or all of them."""
        path, store = self._path(key or "")
        store.delete(path if key is not None else path.getParent(), True)

    def cached(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        return self.load(key) if self.exists(key) else self.save(key, make())
