"""Vectors and texts: inner products, top-k retrieval, TF-IDF cosine (SUB-06, SIM-*)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import top_k


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def retrieve(queries: DataFrame, options: DataFrame, k: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """The ``k`` options with the largest inner product of each query (ties by id).

    Options reach the tasks in blocks of at most ``block_bytes`` of vectors. A task multiplies
    a batch of queries with a block at once and keeps ``k`` places of each; with several blocks
    these places are merged by query.
    """
    spark = queries.sparkSession
    id_type, query_type = options.schema["option_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_type}, rank int, option_id {id_type}, score double"

    def best_of(block) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, vectors = block.value
            for batch in batches:
                for at in range(0, len(batch), 1024):
                    some = batch.iloc[at : at + 1024]
                    scores = np.round(np.array(some["embedding"].tolist(), dtype=np.float64).reshape(len(some), -1) @ vectors.T, 9)
                    take = min(k, len(names))
                    # Everything from the k-th score on, so that ties are told apart by id.
                    least = np.partition(scores, len(names) - take, axis=1)[:, len(names) - take]
                    rows = [(q, *x) for q, own, low in zip(some["query_id"], scores, least) for x in _places(own, low, names, take)]
                    yield pd.DataFrame(rows, columns=["query_id", "rank", "option_id", "score"])

        return queries.select("query_id", "embedding").mapInPandas(run, schema)

    blocks, held, size = [], [], 0
    for row in options.select("option_id", "embedding").where("embedding is not null").toLocalIterator():
        if held and size + 8 * len(row[1]) > block_bytes:
            blocks.append(held)
            held, size = [], 0
        held.append((row[0], row[1]))
        size += 8 * len(row[1])
    blocks += [held] if held else []
    made = [best_of(spark.sparkContext.broadcast(([x[0] for x in b], np.array([x[1] for x in b], dtype=np.float64)))) for b in blocks]
    if not made:
        return spark.createDataFrame([], schema)
    if len(made) == 1:
        return made[0]
    return top_k(reduce(DataFrame.union, made).drop("rank"), ["query_id"], [F.desc("score"), F.col("option_id")], k).select("query_id", "rank", "option_id", "score")


def _places(scores: np.ndarray, least: float, names: list, k: int) -> list[tuple]:
    near = sorted((-scores[i], names[i]) for i in np.flatnonzero(scores >= least))[:k]
    return [(place + 1, name, float(-s)) for place, (s, name) in enumerate(near)]


_WORD = re.compile(r"\w{2,}")


def term_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, term, tf``: lower-case words of two or more letters, digits or underscores, and their counts.

    Counted row by row in Arrow batches, so that no word is shuffled to be counted; a key stands
    for one row.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                keys, terms, counts = [], [], []
                for k, x in zip(batch["_key"].iloc[at : at + 256], batch["_text"].iloc[at : at + 256]):
                    own = Counter(_WORD.findall((x or "").lower()))
                    keys += [k] * len(own)
                    terms += own.keys()
                    counts += own.values()
                yield pd.DataFrame({key: keys, "term": terms, "tf": counts})

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInPandas(run, f"`{key}` {kind}, term string, tf long")


def tfidf_fit(docs: DataFrame, key: str, text: str = "text", counts: DataFrame | None = None) -> tuple[DataFrame, int]:
    """``term, idf`` with idf = ln((1 + n) / (1 + df)) + 1, and n; ``counts`` are the documents' :func:`term_counts`, if kept."""
    n = docs.count()
    df = (term_counts(docs, key, text) if counts is None else counts).groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf")), n


def tfidf_transform(docs: DataFrame, key: str, idf: DataFrame, text: str = "text") -> DataFrame:
    """``key, term, w`` with vectors of length one."""
    raw = term_counts(docs, key, text).join(idf, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    return raw.withColumn("w", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))).select(key, "term", "w")


def cosine_pairs(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Cosine of every pair that shares a term, through the inverted index."""
    return a.withColumnRenamed("w", "wa").join(b.withColumnRenamed("w", "wb"), "term").groupBy(key_a, key_b).agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))


def best_match(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """The row of ``b`` closest to each row of ``a``, by sums over the terms that they share."""
    pairs = cosine_pairs(a, b, key_a, key_b).withColumn("score", F.round("score", 9))
    return top_k(pairs, [key_a], [F.desc("score"), F.col(key_b)], 1, "_r").drop("_r")


def best_document(items: DataFrame, docs: DataFrame, key_items: str, key_docs: str, idf: DataFrame, text: str = "text", block_terms: int = 1 << 20, counts: DataFrame | None = None) -> DataFrame:
    """The document closest to each item: ``key_items, key_docs, score`` of TF-IDF cosine.

    ``items`` (key, term, w) are the stated side. Their vectors reach the tasks in blocks of
    ``block_terms`` entries with the idf of their terms; one pass over the documents for each
    block scores a document against all of its items and hands on one row an item and task.
    Document vectors have length one over all their terms; only terms of some item are listed.
    """
    spark = items.sparkSession
    wanted = items.select("term").distinct().withColumn("wanted", F.lit(True))
    counts = (term_counts(docs, key_docs, text) if counts is None else counts).join(idf.join(wanted, "term", "left"), "term").withColumn("raw", F.col("tf") * F.col("idf"))
    vectors = counts.groupBy(key_docs).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"), F.collect_list(F.when(F.col("wanted"), F.struct("term", "raw"))).alias("x"))
    vectors = vectors.select(key_docs, "norm", F.transform("x", lambda t: t["term"]).alias("terms"), F.transform("x", lambda t: t["raw"]).alias("raws"))
    return _scan_best(spark, items, vectors, key_items, key_docs, block_terms)


def _scan_best(spark, items: DataFrame, vectors: DataFrame, key_items: str, key_docs: str, block_terms: int) -> DataFrame:
    kinds = {k: df.schema[k].dataType.simpleString() for k, df in ((key_items, items), (key_docs, vectors))}
    schema = f"{key_items} {kinds[key_items]}, {key_docs} {kinds[key_docs]}, score double"

    def pass_over(block) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, number, begin, item, weight = block.value
            best, whose = np.zeros(len(names)), [None] * len(names)
            for batch in batches:
                for key, norm, terms, raws in zip(batch[key_docs], batch["norm"], batch["terms"], batch["raws"]):
                    at = np.array([number.get(t, -1) for t in terms], dtype=np.int64)
                    own, raw = at[at >= 0], np.asarray(raws, dtype=np.float64)[at >= 0] / norm
                    n = begin[own + 1] - begin[own]
                    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[own], n)
                    score = np.round(np.bincount(item[place], weights=weight[place] * np.repeat(raw, n), minlength=len(names)), 9)
                    for i in np.flatnonzero((score >= best) & (score > 0)).tolist():
                        if score[i] > best[i] or key < whose[i]:
                            best[i], whose[i] = score[i], key
            found = [(names[i], k, float(best[i])) for i, k in enumerate(whose) if k is not None]
            yield pd.DataFrame(found, columns=[key_items, key_docs, "score"])

        return vectors.mapInPandas(run, schema)

    made, held = [], []

    def flush() -> None:
        names = sorted({x[0] for x in held})
        place = {n: i for i, n in enumerate(names)}
        rows = sorted((term, place[name], w) for name, term, w in held)
        number = {t: i for i, t in enumerate(dict.fromkeys(r[0] for r in rows))}
        begin = np.searchsorted(np.array([number[r[0]] for r in rows]), np.arange(len(number) + 1))
        made.append(pass_over(spark.sparkContext.broadcast((names, number, begin, np.array([r[1] for r in rows]), np.array([r[2] for r in rows])))))

    for row in items.select(key_items, "term", "w").orderBy(key_items).toLocalIterator():
        if len(held) >= block_terms and held[-1][0] != row[0]:
            flush()
            held = []
        held.append(tuple(row))
    if held:
        flush()
    if not made:
        return spark.createDataFrame([], schema)
    return top_k(reduce(DataFrame.union, made), [key_items], [F.desc("score"), F.col(key_docs)], 1, "_r").drop("_r")
