"""Set operations, membership joins, rule joins and paragraph matching (JOIN-*, SET-*, ANON-05..09, LBL-11)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


MOST_RULES = 200


def left_with_metadata(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Left join that keeps one row a key: the right side is reduced to its first row before the join."""
    from .windows import keep_first

    return left.join(keep_first(right, keys, order), keys, "left")


def inner_with_metadata(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides that agree in all keys."""
    return left.join(right, keys)


def lineage(copies: DataFrame, originals: DataFrame) -> DataFrame:
    """Each copy with the sample that its ``original_hash`` names; the original's columns are its own."""
    return copies.drop("hash").join(originals.withColumnRenamed("hash", "original_hash"), "original_hash")


def present_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_semi")


def absent_from(left: DataFrame, *others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are in none of the others (splits without leakage)."""
    for other in others:
        left = left.join(other.select(*keys), keys, "left_anti")
    return left


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).union(b.exceptAll(a)).distinct()


def membership(values: DataFrame, a: DataFrame, b: DataFrame, column: str, normal) -> DataFrame:
    """Whether each value is in ``a``, in ``b``, and in ``b`` only after normalising."""
    mark = lambda df, c, name: df.select(c.alias("_k")).distinct().withColumn(name, F.lit(True))
    out = values.select(column).distinct()
    for df, name, f in ((a, "in_a", lambda c: c), (b, "in_b", lambda c: c), (b, "_normal", normal)):
        out = out.withColumn("_k", f(F.col(column))).join(mark(df, f(F.col(column)), name), "_k", "left").drop("_k")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.select(column, has("in_a").alias("in_a"), has("in_b").alias("in_b"), (~has("in_b") & has("_normal")).alias("needs_normalizing"))


def first_rule(df: DataFrame, text: Column, rules: DataFrame, key: str) -> DataFrame:
    """The first (by ``ord``) rule that matches a row's text; ``rules`` is ord, pattern, name.

    The rules become one expression that stops at the first hit, so nothing is joined; they are
    a stated list, and more than ``MOST_RULES`` are split into runs of that many.
    """
    listed = [(r["pattern"], r["name"]) for r in rules.orderBy("ord").collect()]
    out = F.lit(None).cast("string")
    for at in range(len(listed) // MOST_RULES * MOST_RULES, -1, -MOST_RULES):
        run = listed[at : at + MOST_RULES]
        later = out
        if run:
            chain = F.when(F.col("_text").rlike(run[0][0]), run[0][1])
            for pattern, name in run[1:]:
                chain = chain.when(F.col("_text").rlike(pattern), name)
            out = chain.otherwise(later)
    return df.withColumn("_text", text).withColumn("rule", out).drop("_text")


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits over the reference's length; an empty reference counts as one character."""
    return F.levenshtein(reference, hypothesis) / F.greatest(F.length(reference), F.lit(1))


def paragraph_key(text: Column) -> Column:
    return F.sha2(F.trim(text), 256)


def match_paragraphs(paragraphs: DataFrame, predictions: DataFrame, doc: str = "doc_id", part_size: int = 64) -> DataFrame:
    """Each paragraph's prediction: equal text first, else the closest unmatched one of its document.

    ``paragraphs`` is doc_id, para_idx, text and ``predictions`` doc_id, pred_idx, text. The
    fallback stays within a document and compares only what no equality settled; where a
    document has no prediction left the result is null.

    A document's paragraphs are dealt to parts of about ``part_size``. Each paragraph goes through its
    predictions from the closest length on and computes no distance beyond the best one so far.
    """
    p = paragraphs.withColumn("_key", paragraph_key(F.col("text")))
    q = predictions.withColumn("_key", paragraph_key(F.col("text"))).withColumnRenamed("text", "pred_text")
    exact = p.join(q.groupBy(doc, "_key").agg(F.min("pred_idx").alias("pred_idx")), [doc, "_key"])
    rest_p = p.join(q.select(doc, "_key"), [doc, "_key"], "left_anti")
    rest_q = q.join(p.select(doc, "_key"), [doc, "_key"], "left_anti")
    sizes = rest_p.groupBy(doc).agg(F.ceil(F.count("*") / part_size).cast("int").alias("_parts"))
    left = rest_p.join(sizes, doc).select(doc, "para_idx", "text", F.pmod(F.hash("para_idx"), F.col("_parts")).alias("_part"))
    right = rest_q.join(sizes, doc).select(doc, "pred_idx", "pred_text", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.select(doc, "para_idx").schema) + f", pred_idx {rest_q.schema['pred_idx'].dataType.simpleString()}, cer double"

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        texts, places = b["pred_text"].tolist(), b["pred_idx"].tolist()
        best = [closest(x, texts, places) for x in a["text"]]
        return pd.DataFrame({doc: a[doc], "para_idx": a["para_idx"], "pred_idx": pd.Series([x[1] for x in best], index=a.index, dtype="Int64"), "cer": [x[0] for x in best]})

    fallback = left.groupBy(doc, "_part").cogroup(right.groupBy(doc, "_part")).applyInPandas(nearest, schema)
    return exact.select(doc, "para_idx", "pred_idx", F.lit(0.0).alias("cer")).union(fallback)


def closest(text: str, others: list[str], places: list[int]) -> tuple[float | None, int | None]:
    """Least error rate against a text and where it is reached, the least place of equal ones."""
    best, at = None, None
    for k in sorted(range(len(others)), key=lambda k: (abs(len(others[k]) - len(text)), places[k])):
        if best is not None and abs(len(others[k]) - len(text)) > best:
            break
        edits = distance(text, others[k], best)
        if edits is not None and (best is None or (edits, places[k]) < (best, at)):
            best, at = edits, places[k]
    return (None, None) if best is None else (best / max(1, len(text)), at)


def distance(a: str, b: str, most: int | None = None) -> int | None:
    """Levenshtein distance by bit-parallel columns; None if it is above ``most``."""
    if a == b:
        return 0
    if not a or not b:
        n = len(a) + len(b)
        return n if most is None or n <= most else None
    if len(a) > len(b):
        a, b = b, a
    top, full = 1 << (len(a) - 1), (1 << len(a)) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down, n = full, 0, len(a)
    for j, c in enumerate(b):
        same = where.get(c, 0)
        across = (((same & up) + up) ^ up) | same | down
        right_up, right_down = down | ~(across | up) & full, up & across
        if right_up & top:
            n += 1
        elif right_down & top:
            n -= 1
        if most is not None and n - (len(b) - 1 - j) > most:
            return None
        right_up = (right_up << 1 | 1) & full
        up, down = (right_down << 1 | ~(across | right_up)) & full, right_up & across
    return n


def aggregate_fragments(tokens: DataFrame) -> DataFrame:
    """Replacement of each XML fragment: targets in order, first start and last end."""
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "target"))), lambda x: x["target"]), " ")
    return tokens.groupBy("xml_file", "paragraph_index", "fragment_index").agg(words.alias("target"), F.min("start").alias("start"), F.max("end").alias("end"))


def option_audit(df: DataFrame, option: str, text: Column) -> DataFrame:
    """Distinct normalised texts that were given each option."""
    return df.select(option, text.alias("_t")).dropDuplicates().groupBy(option).agg(F.count("*").alias("n_texts"), F.array_sort(F.collect_list("_t")).alias("texts"))


def copies(df: DataFrame, n: int) -> DataFrame:
    """``n`` copies of every row, numbered from 1."""
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.lit(n))))


def weighted_resample(df: DataFrame, weight: str, key: str, n: int, seed: int = 7, buckets: int = 1024) -> DataFrame:
    """``n`` draws with replacement, a row's chance being its weight.

    Rows lie on a line in the order of a hash of their key, each as long as its weight. Only
    the weights of hash buckets are summed up in one place. Draws fall on the line, are dealt
    to the buckets and meet only the rows of their own.
    """
    place = F.md5(F.col(key).cast("string"))
    rows = df.where(F.col(weight) > 0).withColumn("_order", place).withColumn("_bucket", (F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") % buckets).cast("int"))
    sums = {r["_bucket"]: r["w"] for r in rows.groupBy("_bucket").agg(F.sum(F.col(weight).cast("double")).alias("w")).collect()}
    total, line = 0.0, []
    for b in sorted(sums):
        line.append((b, total, total + sums[b]))
        total += sums[b]
    if not total:
        return df.limit(0).withColumn("draw", F.lit(0).cast("long"))
    at = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("double") / float(16**12) * F.lit(total)
    ends = F.array(*[F.lit(high) for _, _, high in line])
    names, lows = F.array(*[F.lit(b) for b, _, _ in line]), F.array(*[F.lit(low) for _, low, _ in line])
    which = F.least(F.size(F.filter(ends, lambda e: e <= F.col("_at"))), F.lit(len(line) - 1))
    draws = df.sparkSession.range(n).withColumn("_at", at).withColumn("_which", which)
    draws = draws.select(F.col("id").alias("draw"), F.get(names, F.col("_which")).alias("_bucket"), (F.col("_at") - F.get(lows, F.col("_which"))).alias("_at"))
    order = Window.partitionBy("_bucket").orderBy("_order", key)
    high = F.sum(F.col(weight).cast("double")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_high", high).withColumn("_last", F.lead("_order").over(order).isNull()).withColumn("_low", F.coalesce(F.lag("_high").over(order), F.lit(0.0)))
    hit = (F.col("_at") >= F.col("_low")) & ((F.col("_at") < F.col("_high")) | F.col("_last"))
    return draws.join(rows, "_bucket").where(hit).drop("_bucket", "_at", "_low", "_high", "_order", "_last")
