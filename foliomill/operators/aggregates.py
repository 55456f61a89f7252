"""Grouped summaries (AGG-*, EVAL-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import once

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def to_items(df: DataFrame, keys: list[str], flags: list[str], lists: list[str]) -> DataFrame:
    """One row a key: row count, whether any flag holds, sorted non-null values."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[F.bool_or(c).alias(c) for c in flags], *[F.array_sort(F.collect_list(c)).alias(c) for c in lists])


def to_records(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of a key as an array of structs, in order."""
    rest = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("records"))


def value_counts(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Count and share of each value, over the table or each key (a scan and two small shuffles)."""
    keys = keys or []
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def case_spans(df: DataFrame, key: str, time: str) -> DataFrame:
    """Days from first to last event of each case."""
    return df.groupBy(key).agg(F.datediff(F.max(time), F.min(time)).alias("span_days"), F.count("*").alias("n"))


def case_gaps(df: DataFrame, key: str, time: str) -> DataFrame:
    """Mean seconds between neighbouring events of each case, in time order."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    gap = micros - F.lag(micros).over(Window.partitionBy(key).orderBy(time))
    return df.select(key, (gap / 1e6).alias("gap")).groupBy(key).agg(F.avg("gap").alias("mean_gap"))


def distinct_values(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns])


def collapse_single(df: DataFrame, columns: list[str]) -> DataFrame:
    """Arrays of at most one element as that element."""
    return df.withColumns({c: F.get(F.col(c), 0) for c in columns})


def describe(df: DataFrame, column: str, keys: list[str] | None = None, percentiles=PERCENTILES) -> DataFrame:
    c = F.col(column)
    return df.groupBy(*(keys or [])).agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
        *[F.percentile(c, F.lit(p)).alias(f"p{round(100 * p)}") for p in percentiles], F.max(c).alias("max"),
    )


def percentile_of_score(df: DataFrame, column: str, score: float) -> DataFrame:
    """Percent of values below a score, ties counted by half."""
    c = F.col(column)
    return df.agg((100.0 * (F.count_if(c < score) + F.count_if(c <= score)) / (2.0 * F.count(c))).alias("percentile"))


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    return df.groupBy((F.floor(F.col(column) / width) * width).cast("double").alias("bin")).agg(F.count("*").alias("n"))


def flag_sums(df: DataFrame, flags: list[str]) -> DataFrame:
    return df.agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in flags])


def row_sum(*columns: str) -> Column:
    out = F.lit(0)
    for c in columns:
        out = out + F.coalesce(F.col(c).cast("int"), F.lit(0))
    return out


def label_weights(tags: DataFrame, label: str = "label", ignore: list[str] | None = None) -> DataFrame:
    """Inverse frequency of each label, 1 for the most frequent."""
    counts = tags.where(~F.col(label).isin(*(ignore or ["O"]))).groupBy(label).agg(F.count("*").alias("n"))
    raw = F.sum("n").over(Window.partitionBy()) / F.col("n")
    return counts.withColumn("weight", raw).withColumn("weight", F.col("weight") / F.min("weight").over(Window.partitionBy()))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """``n / (classes * count)`` of each class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return counts.withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))


def adjacent_groups(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Runs of equal neighbours with their sizes, as an unsorted grouping gives them.

    Rows are dealt to ranges of the first order column's values and their runs found there; a
    run that goes on in the next range is stitched from the two ends of each range only.
    """
    cuts = _range_cuts(df, order[0])
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order[0]))) if cuts else F.lit(0)
    from .windows import with_island

    rows = df.withColumn("_part", F.when(F.col(order[0]).isNull(), -1).otherwise(part))
    runs = with_island(rows, key, ["_part"], order, "_run").groupBy("_part", "_run").agg(F.first(key).alias(key), F.count("*").alias("n"))
    ends = runs.groupBy("_part").agg(F.max("_run").alias("runs"), F.min_by(F.struct(key), "_run").alias("head"), F.max_by(F.struct(key), "_run").alias("tail"))
    every = Window.partitionBy(F.lit(0)).orderBy("_part")
    joined = F.lag("tail").over(every).eqNullSafe(F.col("head")) & F.lag("runs").over(every).isNotNull()
    ends = ends.withColumn("_joins", joined.cast("int"))
    before = F.coalesce(F.sum(F.col("runs") - F.col("_joins")).over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("_part", (before - F.col("_joins")).alias("_base"))
    return runs.join(ends, "_part").groupBy((F.col("_base") + F.col("_run")).alias("island")).agg(F.first(key).alias(key), F.sum("n").alias("n"))


def _range_cuts(df: DataFrame, column: str, parts: int = 64) -> list:
    """Values that part a column's range into about equal shares; any type that sorts will do."""
    sample = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).orderBy(F.xxhash64(column)).limit(32 * parts).collect()]
    sample.sort()
    return sorted(set(sample[:: max(1, len(sample) // parts)]))


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    both = df.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("hit")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    sums = both.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("claimed"), F.sum("hit").alias("hits"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = sums.withColumn("precision", safe(F.col("hits"), F.col("claimed"))).withColumn("recall", safe(F.col("hits"), F.col("support")))
    return out.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("claimed", "hits")


def macro_average(report: DataFrame) -> DataFrame:
    return report.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))


def confusion(df: DataFrame, truth: str, predicted: str, normalize: bool = False) -> DataFrame:
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth"))) if normalize else counts


def threshold_sweep(df: DataFrame, truth: str, score: str, steps: int = 100) -> DataFrame:
    """Precision, recall and F1 at each threshold: rows are first counted by the threshold they pass."""
    passed = F.least(F.floor(F.col(score) * steps), F.lit(steps)).cast("int")
    by_step = df.groupBy(passed.alias("step")).agg(F.count("*").alias("n"), F.sum(F.col(truth).cast("int")).alias("pos"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    every = grid.join(by_step, "step", "left").fillna(0)
    up = Window.partitionBy(F.lit(0)).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    out = every.withColumn("claimed", F.sum("n").over(up)).withColumn("hits", F.sum("pos").over(up)).withColumn("truths", F.sum("pos").over(Window.partitionBy(F.lit(0))))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = safe(F.col("hits"), F.col("claimed")), safe(F.col("hits"), F.col("truths"))
    return out.select((F.col("step") / steps).alias("threshold"), p.alias("precision"), r.alias("recall"), safe(2 * p * r, p + r).alias("f1"))


def melt(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "metric", "value")


def match_rates(df: DataFrame, truth: str, predicted: str, keys: list[str], normal=None) -> DataFrame:
    """Exact match rate and the rate after normalising both sides."""
    normal = normal or F.lower
    return df.groupBy(*keys).agg(F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("exact"), F.avg((normal(F.col(truth)) == normal(F.col(predicted))).cast("int")).alias("normalized"), F.count("*").alias("n"))


def top_k_rates(df: DataFrame, truth: str, ranked: str, ks=(1, 2, 3, 5)) -> DataFrame:
    return df.agg(*[F.avg(F.array_contains(F.slice(F.col(ranked), 1, k), F.col(truth)).cast("int")).alias(f"top{k}") for k in ks])


def softmax(logits: Column) -> Column:
    raised = once(F.array_max(logits), lambda peak: F.transform(logits, lambda x: F.exp(x - peak)))
    return once(raised, lambda r: once(F.aggregate(r, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(r, lambda x: x / total)))


def subword_scores(scores: Column, word_ids: Column, how: str = "max") -> Column:
    """A score a word: the largest of its subwords', or the first one's."""
    words = F.array_sort(F.array_distinct(F.filter(word_ids, lambda w: w.isNotNull())))
    own = lambda w: F.transform(F.filter(F.arrays_zip(word_ids.alias("w"), scores.alias("s")), lambda x: x["w"] == w), lambda x: x["s"])
    return F.transform(words, lambda w: F.array_max(own(w)) if how == "max" else F.get(own(w), 0))


def hash_split(key: Column | str, train: int = 80, dev: int = 10) -> Column:
    from .windows import hash_bucket

    bucket = hash_bucket(key)
    return F.when(bucket < train, "train").when(bucket < train + dev, "dev").otherwise("test")


def entity_scores(truth: DataFrame, predicted: DataFrame, on=("doc_id", "first_pos", "last_pos", "label")) -> DataFrame:
    """Entity-level precision, recall and F1 by label: an entity is right if span and label agree."""
    marked = truth.select(*on, F.lit(1).alias("t")).join(predicted.select(*on, F.lit(1).alias("p")), list(on), "full").fillna(0, ["t", "p"])
    sums = marked.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("claimed"), F.sum(F.col("t") * F.col("p")).alias("hits"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = safe(F.col("hits"), F.col("claimed")), safe(F.col("hits"), F.col("support"))
    return sums.select("label", "support", p.alias("precision"), r.alias("recall"), safe(2 * p * r, p + r).alias("f1"))


def argmax_tags(scores: Column, truth: Column, ignore: int = -100) -> Column:
    """``[(truth, predicted), ...]`` of the positions whose true tag counts; a prediction is the class of the largest score."""
    both = F.filter(F.arrays_zip(truth.alias("truth"), scores.alias("scores")), lambda x: x["truth"] != ignore)
    return F.transform(both, lambda x: F.struct(x["truth"].alias("truth"), (F.array_position(x["scores"], F.array_max(x["scores"])) - 1).cast("int").alias("predicted")))


def token_accuracy(df: DataFrame, scores: str, truth: str, ignore: int = -100) -> DataFrame:
    """Share of counted positions whose largest score is the true class's, and their number."""
    each = df.select(F.explode(argmax_tags(F.col(scores), F.col(truth), ignore)).alias("x"))
    return each.agg(F.avg((F.col("x.truth") == F.col("x.predicted")).cast("int")).alias("accuracy"), F.count("*").alias("n_tokens"))


def describe_binned(df: DataFrame, column: str, keys: list[str], percentiles=PERCENTILES, bins: int = 4096) -> DataFrame:
    """:func:`describe` whose percentiles come from two passes of counts, exact to one bin's values.

    The first pass counts bins of the column's range, the second sorts only the rows of the bins
    that hold a wanted place, so a group of any size is no single task.
    """
    c = F.col(column).cast("double")
    low, high = df.agg(F.min(c), F.max(c)).first()
    if low is None:
        return describe(df, column, keys, percentiles)
    width = (high - low) / bins or 1.0
    rows = df.where(c.isNotNull()).select(*keys, c.alias("_x"), F.least(F.floor((c - low) / width), F.lit(bins - 1)).cast("int").alias("_bin"))
    sums = rows.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_bin")
    sums = sums.withColumn("_base", F.sum("_n").over(upto) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    places = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("_all") - 1)).alias("at")) for i, p in enumerate(percentiles)])
    wanted = F.filter(places, lambda x: (F.ceil(x["at"]) >= F.col("_base")) & (F.floor(x["at"]) < F.col("_base") + F.col("_n")))
    sums = sums.withColumn("_places", wanted).where(F.size("_places") > 0)
    sums = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bin").alias("_k"), "_base", "_places")
    same = F.col("_bin") == F.col("_k")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    near = rows.join(sums, same).select(*keys, "_x", "_bin", "_base", "_places")
    near = near.withColumn("_at", F.col("_base") + F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy("_x")) - 1)
    hits = near.select(*keys, "_x", "_at", F.explode("_places").alias("_p")).where((F.col("_at") == F.floor("_p.at")) | (F.col("_at") == F.ceil("_p.at")))
    share = F.when(F.ceil("_p.at") == F.floor("_p.at"), F.lit(1.0)).when(F.col("_at") == F.floor("_p.at"), F.ceil("_p.at") - F.col("_p.at")).otherwise(F.col("_p.at") - F.floor("_p.at"))
    found = hits.groupBy(*keys).agg(*[F.sum(F.when(F.col("_p.i") == i, F.col("_x") * share)).alias(f"p{round(100 * p)}") for i, p in enumerate(percentiles)])
    base = df.groupBy(*keys).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    out = base.crossJoin(found) if not keys else base.join(found, keys, "left")
    return out.select(*keys, "count", "mean", "std", "min", *[f"p{round(100 * p)}" for p in percentiles], "max")
