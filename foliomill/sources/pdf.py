"""Paragraphs from PDF text blocks (SRC-05..07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.udf import nfkc


def margins(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Median of the positive gaps between neighbouring blocks of a page; 0 where there are none."""
    gap = F.col("y0") - F.lag("y1").over(Window.partitionBy(doc, "page").orderBy("y0", "block_no"))
    return blocks.select(doc, gap.alias("gap")).groupBy(doc).agg(F.coalesce(F.median(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(0.0)).alias("margin"))


def paragraphs(blocks: DataFrame, tolerance: Column | None = None, doc: str = "doc_id") -> DataFrame:
    """``doc, para_idx, text``: blocks are joined until a gap exceeds the tolerance or the page ends.

    Without a tolerance it is the document's median margin, rounded up.
    """
    rows = blocks
    if tolerance is None:
        rows = blocks.join(margins(blocks, doc), doc).withColumn("_tol", F.ceil("margin"))
    else:
        rows = blocks.withColumn("_tol", tolerance)
    order = Window.partitionBy(doc).orderBy("page", "y0", "block_no")
    last = F.lag("y1").over(order)
    fresh = last.isNull() | (F.lag("page").over(order) != F.col("page")) | (F.col("y0") - last > F.col("_tol"))
    rows = rows.withColumn("_fresh", fresh.cast("int"))
    rows = rows.withColumn("para_idx", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "y0", "block_no", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy(doc, "para_idx").agg(text.alias("text"))


def to_text(blocks: DataFrame, tolerance: Column | None = None, doc: str = "doc_id") -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("para_idx", "text")))
    return paragraphs(blocks, tolerance, doc).groupBy(doc).agg(nfkc(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n")).alias("text"))
