"""Token alignment of an original and its anonymised copy (ALN-*, ANON-08), one task a pair."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def align_tokens(source: list[str], target: list[str]) -> list[tuple[str, str]]:
    """A row for each source token: its equal token, or all that stands in its place."""
    rows: list[tuple[str, str]] = []
    for kind, a, b, c, d in SequenceMatcher(None, source, target).get_opcodes():
        if kind == "equal":
            rows += zip(source[a:b], target[c:d])
        else:
            rows += [(token, " ".join(target[c:d])) for token in source[a:b]]
    return rows


def tokens_of(text: str) -> list[str]:
    return [t for line in text.splitlines() for t in line.split()]


def align_documents(source: str, target: str) -> list[tuple[str, str]]:
    """Align around the first matching run of lines, the halves apart."""
    a, b = source.splitlines(), target.splitlines()
    block = next((x for x in SequenceMatcher(None, a, b).get_matching_blocks() if x.size), None)
    if block is None:
        return align_tokens(tokens_of(source), tokens_of(target))
    join = "\n".join
    top = align_tokens(tokens_of(join(a[: block.a])), tokens_of(join(b[: block.b])))
    return top + align_tokens(tokens_of(join(a[block.a :])), tokens_of(join(b[block.b :])))


def align(pairs: DataFrame, by_document: bool = False) -> DataFrame:
    """``pair_id, pos, source, target`` of every (pair_id, source_text, target_text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                a, b = row.source_text or "", row.target_text or ""
                made = align_documents(a, b) if by_document else align_tokens(tokens_of(a), tokens_of(b))
                if not made:
                    continue
                yield pd.DataFrame({"pair_id": [row.pair_id] * len(made), "pos": range(len(made)), "source": [x[0] for x in made], "target": [x[1] for x in made]})

    return pairs.select("pair_id", "source_text", "target_text").mapInPandas(run, "pair_id long, pos int, source string, target string")


def alignment_score(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("pair_id").agg(F.avg((F.col("source") == F.col("target")).cast("int")).alias("alignment"), F.count("*").alias("n_tokens"))


def matching_score(aligned: DataFrame, tfidf: DataFrame) -> DataFrame:
    """Alignment times TF-IDF cosine of each pair."""
    return alignment_score(aligned).join(tfidf, "pair_id").withColumn("matching_score", F.col("alignment") * F.col("tfidf"))


def place_tokens(tokens: DataFrame, lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Paragraph of each token: lines (doc_id, line_idx, n_tokens) cover ranges of token ordinals."""
    from .windows import running_sum

    ends = lines.withColumn("_low", running_sum(F.col("n_tokens"), [doc], ["line_idx"], inclusive=False)).withColumn("_high", F.col("_low") + F.col("n_tokens"))
    each = ends.where("n_tokens > 0").select(doc, F.col("line_idx").alias("para_idx"), F.explode(F.sequence("_low", F.col("_high") - 1)).alias("tok_idx"))
    return tokens.join(each, [doc, "tok_idx"])


START, END = "<START>", "<END>"


def targets_of(tokens: list[str], anonymized: str) -> list[str]:
    """What stands for each token in the anonymised text; marks at both ends keep edits there in place."""
    rows = align_tokens([START, *tokens, END], [START, *tokens_of(anonymized), END])[1:-1]
    return [target for _, target in rows]


def place_targets(tokens: DataFrame, anonymized: DataFrame, keys: list[str]) -> DataFrame:
    """``tokens`` (keys, tok_idx, token and more) with the ``target`` of each, from (keys, text) of the anonymised copy.

    A label that stands for several tokens is said once, at the first of them.
    """
    parts = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tok_idx", "token"))).alias("_t")).join(anonymized.select(*keys, F.col("text").alias("_text")), keys)

    @F.pandas_udf("array<string>")
    def targets(words: pd.Series, text: pd.Series) -> pd.Series:
        out = []
        for w, x in zip(words, text):
            own = targets_of(list(w), x or "")
            out.append(["" if i and t == own[i - 1] and t != w[i] and t.startswith("<") else t for i, t in enumerate(own)])
        return pd.Series(out)

    made = parts.withColumn("_w", targets(F.transform("_t", lambda x: x["token"]), F.col("_text")))
    each = made.select(*keys, F.explode(F.arrays_zip(F.transform("_t", lambda x: x["tok_idx"]).alias("tok_idx"), F.col("_w").alias("target"))).alias("x")).select(*keys, "x.tok_idx", "x.target")
    return tokens.join(each, [*keys, "tok_idx"])


def with_separators(tokens: DataFrame, keys: list[str], paragraph: str, position: str = "tok_idx") -> DataFrame:
    """``keys, line, token, label``: the rows of each document with an empty row between paragraphs."""
    order = Window.partitionBy(*keys).orderBy(paragraph, position)
    fresh = F.coalesce((F.col(paragraph) != F.lag(paragraph).over(order)).cast("int"), F.lit(0))
    rows = tokens.withColumn("_fresh", fresh).withColumn("line", (F.row_number().over(order) + F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    blank = rows.where("_fresh = 1").select(*keys, (F.col("line") - 1).alias("line"), F.lit("").alias("token"), F.lit("").alias("label"))
    return rows.select(*keys, "line", "token", "label").unionByName(blank)


def from_separators(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The inverse of :func:`with_separators`: ``keys, para_idx, tok_idx, token, label``; several empty rows part once."""
    order = Window.partitionBy(*keys).orderBy("line")
    empty = (F.trim(F.col("token")) == "").cast("int")
    told = rows.withColumn("_gap", F.coalesce(((empty == 0) & (F.lag(empty, 1, 0).over(order) == 1)).cast("int"), F.lit(0))).withColumn("_empty", empty)
    told = told.withColumn("_para", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_empty = 0")
    first = F.min("_para").over(Window.partitionBy(*keys))
    place = F.row_number().over(Window.partitionBy(*keys, "_para").orderBy("line")) - 1
    return told.withColumn("tok_idx", place.cast("int")).select(*keys, (F.col("_para") - first).cast("int").alias("para_idx"), "tok_idx", "token", "label")


def drop_ambiguous(rows: DataFrame, bad: Column, keys: list[str]) -> DataFrame:
    """Rows of :func:`with_separators` without the paragraphs, between empty rows, that hold a bad row."""
    order = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumn("_para", F.sum((F.trim(F.col("token")) == "").cast("int")).over(order)).withColumn("_bad", bad.cast("int"))
    return told.withColumn("_bad", F.max(F.coalesce("_bad", F.lit(0))).over(Window.partitionBy(*keys, "_para"))).where("_bad = 0").drop("_bad", "_para")
