"""Sharding by balanced label propagation under capacity quotas.

Documents of equal text are linked. A group is a hub with its members' labels (shards) as
counts, so its members see their neighbours' shards without a row for each pair. The few
groups of ``LARGE`` of a shard or more are dealt out beforehand: whole to a shard with room,
or to the fewest shards if there is none. Each round joins every hub that is not yet
in one shard with the label that most of its members have, adds up the flows between shards,
lets the driver find the largest quotas (a table of shards x shards x 64) under which no
shard exceeds its room, and moves the hubs within them. Hubs that are still spread, or that
their shard has no room for, are laid one after the other over the room that is left: only
those on a border between two shards are cut, so fewer than there are shards. Documents
without links then fill the shards up to counts at most one apart (law ``rows``).

All steps after the first scan work on narrow rows or on hubs; places in orders come from
bucketed prefix sums, so neither a hot text nor a shard is a single task.

Defined results: null text counts as empty; repeated rows are separate rows of one group;
rows that differ in nothing may swap slots; fewer rows than shards fill the first shards.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import bits_for, with_before
from .scratch import discard, materialize
from .words import LOWER, SPACED, bounded_batches, encode, gram_hashes, slices, tokenize, word_hashes

QUOTA_STEPS = 64
#: Share of a shard's capacity from which a group is placed before the propagation.
LARGE = 0.4
#: Words of the shingles that make documents related (:func:`least_shingle`).
SHINGLE = 5


def quotas(load: list[int], room: list[int], flows: dict[tuple[int, int, int], int], shards: int) -> list[int]:
    """For each target the number of leading hash steps whose hubs may move.

    ``flows`` are rows by (from, to, step). Starting with all moves, the most overfull shard
    gives up its last step until none is above its ``room``.
    """
    steps = [QUOTA_STEPS] * shards
    into: dict[tuple[int, int], dict[int, int]] = defaultdict(dict)
    for (i, j, step), n in flows.items():
        into[j, step][i] = n
    now = list(load)
    for (_, _), own in into.items():
        for i, n in own.items():
            now[i] -= n
    for (j, _), own in into.items():
        now[j] += sum(own.values())
    while True:
        over = [j for j in range(shards) if now[j] > max(room[j], load[j]) and steps[j] > 0]
        if not over:
            return steps
        j = max(over, key=lambda x: now[x] - room[x])
        steps[j] -= 1
        for i, n in into.get((j, steps[j]), {}).items():
            now[i] += n
            now[j] -= n


def pack(groups: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int]]:
    """``(group, first, last, shard)``: the places of each group (group, members) by shard.

    Largest first; each goes whole to the fullest shard with room for it, else fills the
    emptiest one and goes on with the rest. ``room`` is brought up to date.
    """
    out = []
    for group, n in sorted(groups, key=lambda g: (-g[1], g[0])):
        at = 0
        while at < n:
            fits = [s for s in range(len(room)) if room[s] >= n - at]
            s = min(fits, key=lambda s: room[s]) if fits else max(range(len(room)), key=lambda s: room[s])
            took = min(room[s], n - at)
            if not took:
                break
            out.append((group, at, at + took, s))
            room[s] -= took
            at += took
    return out


def propagate(hubs: DataFrame, shards: int, room: list[int], rounds: int) -> DataFrame:
    """``unit, n, shard``: the hubs and, for those whose members end up in one shard, that shard.

    ``hubs`` is unit, shard, n.
    """
    hubs = materialize(hubs)
    for turn in range(rounds):
        step = F.pmod(F.xxhash64("unit", F.lit(turn)), F.lit(QUOTA_STEPS)).cast("int")
        load = [0] * shards
        for r in hubs.groupBy("shard").agg(F.sum("n").alias("n")).collect():
            load[r["shard"]] = r["n"]
        open_ = F.array(*[F.lit(int(x < y)) for x, y in zip(load, room)])[F.col("shard")]
        wish = hubs.groupBy("unit").agg(F.count("*").alias("parts"), F.max_by("shard", F.struct(open_, "n", F.xxhash64("unit", "shard", F.lit(turn)))).alias("target"))
        wish = wish.where("parts > 1").select("unit", "target", step.alias("step"))
        moves = hubs.join(wish, "unit", "left")
        flows = {(r["shard"], r["target"], r["step"]): r["n"] for r in moves.where("target <> shard").groupBy("shard", "target", "step").agg(F.sum("n").alias("n")).collect()}
        if not flows:
            break
        allowed = quotas(load, room, flows, shards)
        if not any(s < allowed[j] for _, j, s in flows):
            continue  # another turn deals the hubs to other steps
        goes = F.col("step") < F.array(*[F.lit(x) for x in allowed])[F.col("target")]
        after = materialize(moves.withColumn("shard", F.when(goes, F.col("target")).otherwise(F.col("shard"))).groupBy("unit", "shard").agg(F.sum("n").alias("n")))
        discard(hubs)
        hubs = after
    return hubs.groupBy("unit").agg(F.sum("n").alias("n"), F.when(F.count("*") == 1, F.min("shard")).alias("shard"))


def _shard_at(place: Column, room: list[int]) -> Column:
    """The shard that holds a place of the line on which the shards' rooms follow one another."""
    ends, total = [], 0
    for x in room:
        total += x
        ends.append(total)
    return F.least(F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= place)), F.lit(len(room) - 1)).cast("int")


def settle(hubs: DataFrame, room: list[int], bits: int) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """``unit, to`` of the hubs (unit, n, shard) that stay whole, and the pieces of the others as of :func:`pack`.

    ``room`` is brought up to date.
    """
    hubs = materialize(hubs.withColumn("order", F.xxhash64("unit", F.lit(3))))
    lined = with_before(hubs.where("shard is not null"), ["shard"], "order", ["unit"], F.col("n"), bits)
    lined = materialize(lined.withColumn("fits", F.col("before") + F.col("n") <= F.array(*[F.lit(x) for x in room])[F.col("shard")]))
    whole = lined.where("fits").select("unit", F.col("shard").alias("to"))
    for r in lined.where("fits").groupBy("shard").agg(F.sum("n").alias("n")).collect():
        room[r["shard"]] -= r["n"]
    rest = lined.where("not fits").select("unit", "n", "order").union(hubs.where("shard is null").select("unit", "n", "order"))
    rest = with_before(rest, [], "order", ["unit"], F.col("n"), bits)
    rest = materialize(rest.withColumn("to", _shard_at(F.col("before"), room)).withColumn("last", _shard_at(F.col("before") + F.col("n") - 1, room)))
    pieces, line = [], list(room)
    for r in rest.where("to <> last").collect():  # fewer than there are shards
        for s in range(r["to"], r["last"] + 1):
            low, high = max(r["before"], sum(line[:s])), min(r["before"] + r["n"], sum(line[: s + 1]))
            if high > low:
                pieces.append((r["unit"], low - r["before"], high - r["before"], s))
                room[s] -= high - low
    for r in rest.where("to = last").groupBy("to").agg(F.sum("n").alias("n")).collect():
        room[r["to"]] -= r["n"]
    return whole.union(rest.where("to = last").select("unit", "to")), pieces


def assign(docs: DataFrame, shards: int = 16, rounds: int = 8, group: Column | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, linked`` of every row.

    ``group`` says which documents belong together; by default those of equal text.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    key = F.xxhash64(text, F.octet_length(text)) if group is None else F.xxhash64(group)
    slim = materialize(docs.select(F.col("doc_id").cast("long"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), key.alias("unit"), F.xxhash64("doc_id", F.lit(17)).alias("order")))
    total = slim.count()
    capacity, bits = max(1, total // shards), bits_for(total)
    # Written first, so that the joins deal both sides anew and can split a hot group's partition.
    many = materialize(slim.groupBy("unit").agg(F.count("*").alias("members")).where("members > 1"))
    room = [total // shards + (s < total % shards) for s in range(shards)]
    spark = docs.sparkSession
    large = F.col("members") >= max(2.0, LARGE * capacity)
    pieces = pack([(r["unit"], r["members"]) for r in many.where(large).collect()], room)  # shards / LARGE at most
    slim_columns = ["doc_id", "size", "text_crc32", "order"]
    # The others start where the large groups leave room, in proportion to it.
    deal = [s for s in range(shards) for _ in range(round(256 * room[s] / max(1, sum(room))))] or list(range(shards))
    start = F.array(*[F.lit(s) for s in deal])[F.pmod("order", F.lit(len(deal))).cast("int")]
    small = materialize(slim.join(many.where(~large).select("unit"), "unit").select(*slim_columns, "unit", start.alias("shard")))
    hubs = propagate(small.groupBy("unit", "shard").agg(F.count("*").alias("n")), shards, list(room), rounds)
    whole, cut = settle(hubs, room, bits)
    pieces += cut
    placed = small.drop("shard").join(materialize(whole), "unit").select(*slim_columns, F.col("to").alias("shard"))
    if pieces:
        where = F.broadcast(spark.createDataFrame(pieces, "unit long, begin long, until long, to int"))  # a few for each shard
        split = slim.join(F.broadcast(spark.createDataFrame(sorted({(p[0],) for p in pieces}), "unit long")), "unit", "left_semi")
        ranked = with_before(split, ["unit"], "order", ["doc_id", "text_crc32"], F.lit(1), bits).withColumnRenamed("unit", "_unit")
        ranked = ranked.join(where, (F.col("unit") == F.col("_unit")) & (F.col("before") >= F.col("begin")) & (F.col("before") < F.col("until")))
        placed = placed.union(ranked.select(*slim_columns, F.col("to").alias("shard")))
    alone = slim.join(many.select("unit"), "unit", "left_anti").select(*slim_columns)
    alone = with_before(alone, [], "order", ["doc_id", "text_crc32"], F.lit(1), bits)
    settled = placed.withColumn("linked", F.lit(True)).union(alone.select(*slim_columns, _shard_at(F.col("before"), room).alias("shard"), F.lit(False)))
    settled = materialize(settled)
    # A hash of its own: documents were dealt out in the first one's order, so there each shard has few buckets.
    settled = settled.withColumn("place", F.xxhash64("order", F.lit(5)))
    out = with_before(settled, ["shard"], "place", ["doc_id", "text_crc32"], F.lit(1), bits, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked")


def cut_links(rows: DataFrame, group: str = "group", shard: str = "shard") -> DataFrame:
    """``links, cut``: the links that hold the groups together (one less than members), and those between shards."""
    parts = rows.groupBy(group, shard).agg(F.count("*").alias("n")).groupBy(group).agg(F.sum("n").alias("n"), F.count("*").alias("parts"))
    return parts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("links"), F.coalesce(F.sum(F.col("parts") - 1), F.lit(0)).alias("cut"))


@F.pandas_udf(T.LongType())
def _least_shingle(texts: pd.Series) -> pd.Series:
    out = np.zeros(len(texts), dtype=np.uint64)
    for base, chunk in slices(encode(t).translate(LOWER) for t in texts):
        words = tokenize(chunk, SPACED)
        hashes = word_hashes(words)
        grams, first = gram_hashes(hashes, words.doc, SHINGLE)
        if len(grams):
            own = words.doc[first]
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out[base + own[heads]] = np.minimum.reduceat(grams, heads)
        for d in np.flatnonzero(np.diff(words.first) < SHINGLE).tolist():  # fewer words: the whole sequence
            few = hashes[words.first[d] : words.first[d + 1]]
            out[base + d] = gram_hashes(few, np.zeros(len(few), dtype=np.int64), len(few))[0][0] if len(few) else 0
    return pd.Series(out.view(np.int64))


def least_shingle(text: Column | str = "text") -> Column:
    """A group for related documents: the least hash of a text's word shingles, equal as often as these sets are alike.

    Documents without words are one group.
    """
    return _least_shingle(text)
