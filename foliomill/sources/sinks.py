"""Writers (SNK-01..05, 07); each leaves one file a task, none goes through the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

EXPORT_FORMATS = ("csv", "json")


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    if kind not in EXPORT_FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if kind == "csv" else writer.json(path)


def write_rendered(df: DataFrame, path: str, column: str = "raw") -> None:
    """Rendered text, one row a document."""
    df.select(column).write.mode("overwrite").text(path)


def write_splits(df: DataFrame, path: str, codes: dict[str, int], split: str = "split") -> None:
    """Samples partitioned by split, with the label codes beside them."""
    df.write.mode("overwrite").partitionBy(split).parquet(f"{path}/samples")
    df.sparkSession.createDataFrame([(json.dumps(codes, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/label_mapping")
