"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves' members in a tree domain - language - source. The token budget goes
down the tree by weight. A node whose documents can't fill its share (its tokens times the
epochs allowed) is filled completely, and what it leaves goes to its siblings by weight;
only what the siblings can't take either is handed up and spread over the next level. Each
leaf then takes whole epochs and, of the next one, the documents of a seeded order up to its
remaining tokens.

Tokens are words ``[^\\x20\\x09-\\x0D]+``. Only the upper levels (domains and their languages)
are on the driver. Leaves, as many as there are sources, stay on Spark: a node's tokens fill
its leaves up to one level per weight, which prefix sums over the leaves in the order of
their supply per weight tell. A leaf's order of documents is a hash of seed, epoch, doc_id and
text; its prefix is found from sums over hash buckets, so neither a leaf that holds a third of
all rows nor a node with most of the leaves is a single task.

Defined results: null, empty and wordless texts have no tokens and aren't selected; a null
language or source is a leaf of its own (``und``, ``none``); unlisted nodes weigh
``other_weight``; repeated rows are ordered next to each other and each count. Rows are
selected as rows, so a null or repeated doc_id neither loses nor adds any.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import bits_for, with_before
from .scratch import materialize, numbered

NODE, LEVELS = ["domain", "language"], ["domain", "language", "branch"]
#: Leaves that are broadcast to the documents; more are joined by a shuffle.
BROADCAST_LEAVES = 10_000


def default_domain() -> Column:
    """Sources whose name ends in one digit after letters are ``core``, others ``long_tail``."""
    return F.when(F.col("source").rlike("^[A-Za-z]+[0-9]$"), "core").otherwise("long_tail")


@dataclass
class Weights:
    """Weights of the children of each node; the path of a node is a tuple of names."""

    children: dict[tuple[str, ...], dict[str, float]] = field(default_factory=dict)
    other_weight: float = 1.0

    def named(self, parent: tuple[str, ...]) -> dict[str, float]:
        return self.children.get(parent) or self.children.get(("*",) * len(parent)) or {}

    def of(self, parent: tuple[str, ...], name: str) -> float:
        return max(0.0, float(self.named(parent).get(name, self.other_weight)))


#: Production weights: domains, then languages of any domain; sources weigh the same.
DEFAULT = Weights({(): {"core": 0.6, "long_tail": 0.4}, ("*",): {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}})


def budgets(supply: dict[tuple[str, ...], int], total: float, weights: Weights) -> dict[tuple[str, ...], float]:
    """Tokens for each leaf, none above its supply; all of ``total`` if the supply allows."""
    if not supply:
        return {}
    room: dict[tuple[str, ...], float] = defaultdict(float)
    children: dict[tuple[str, ...], set[str]] = defaultdict(set)
    for leaf, tokens in supply.items():
        for depth in range(len(leaf) + 1):
            room[leaf[:depth]] += tokens
        for depth in range(len(leaf)):
            children[leaf[:depth]].add(leaf[depth])
    out: dict[tuple[str, ...], float] = {}

    def spread(node: tuple[str, ...], tokens: float) -> None:
        if node not in children:
            out[node] = min(tokens, room[node])
            return
        names = sorted(children[node])
        share = {n: 0.0 for n in names}
        open_, left = set(names), min(tokens, room[node])
        while open_ and left > 1e-9:
            weight = {n: weights.of(node, n) for n in open_}
            whole = sum(weight.values())
            if not whole:  # only nodes that weigh nothing are left to take it
                weight, whole = {n: 1.0 for n in open_}, float(len(open_))
            full = {n for n in open_ if share[n] + left * weight[n] / whole >= room[(*node, n)]}
            if not full:
                for n in open_:
                    share[n] += left * weight[n] / whole
                break
            for n in full:
                left -= room[(*node, n)] - share[n]
                share[n] = room[(*node, n)]
            open_ -= full
        for n in names:
            spread((*node, n), share[n])

    spread((), float(total))
    return out


def _members(docs: DataFrame, domain: Column, kept: list[str]) -> DataFrame:
    """The columns ``kept``, the three levels, the tokens and a hash of the text of rows with tokens."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    named = docs.select(*kept, F.col("doc_id").cast("long"), domain.alias("domain"), F.coalesce("lang", F.lit("und")).alias("language"), F.coalesce("source", F.lit("none")).alias("branch"), words.cast("long").alias("tokens"), F.xxhash64("text").alias("digest"))
    return named.where("tokens > 0")


def leaf_budgets(leaves: DataFrame, total: float, weights: Weights, epochs: int = 1) -> DataFrame:
    """``leaves`` (the levels, tokens) with ``given``: what :func:`budgets` gives each, computed on Spark."""
    spark = leaves.sparkSession
    parents = [tuple(r) for r in leaves.select(*NODE).distinct().collect()]
    named = [(*p, name, max(0.0, float(w))) for p in parents for name, w in weights.named(p).items()]
    weight = F.lit(max(0.0, float(weights.other_weight)))
    if named:
        own = spark.createDataFrame(named, "domain string, language string, branch string, _own double")
        leaves, weight = leaves.join(own, LEVELS, "left"), F.coalesce("_own", weight)
    # Leaves that weigh nothing take, in equal parts, what all others leave.
    leaves = leaves.withColumn("weight", weight).drop("_own").withColumn("last", F.col("weight") == 0)
    leaves = leaves.withColumn("weight", F.when(F.col("last"), F.lit(1.0)).otherwise(F.col("weight"))).withColumn("room", F.col("tokens") * F.lit(epochs))
    leaves = materialize(leaves.withColumn("ratio", F.col("room") / F.col("weight")))
    sums = leaves.groupBy(*NODE, "last").agg(F.sum("room").alias("room"), F.sum("weight").alias("weight"), F.count("*").alias("n")).collect()
    room: dict[tuple[str, ...], int] = defaultdict(int)
    for r in sums:
        room[r["domain"], r["language"]] += r["room"]
    amounts = budgets(dict(room), total, weights)
    first = {(r["domain"], r["language"]): r["room"] for r in sums if not r["last"]}
    nodes = []
    for r in sums:
        key = (r["domain"], r["language"])
        nodes.append((*key, r["last"], max(0.0, amounts[key] - first.get(key, 0)) if r["last"] else min(amounts[key], float(r["room"])), float(r["weight"])))
    schema = "domain string, language string, last boolean, amount double, whole double"
    keys, bits = [*NODE, "last"], bits_for(sum(r["n"] for r in sums))
    order = leaves.withColumn("_order", (F.log2(F.col("ratio") + 1) * float(1 << 57)).cast("long"))
    order = with_before(order, keys, "_order", ["ratio", "branch"], F.col("room"), bits, "room_before")
    order = with_before(order, keys, "_order", ["ratio", "branch"], F.col("weight"), bits, "weight_before", "double")
    order = order.join(F.broadcast(spark.createDataFrame(nodes, schema)) if len(nodes) <= BROADCAST_LEAVES else spark.createDataFrame(nodes, schema), keys)
    full = F.col("room_before") + F.col("ratio") * (F.col("whole") - F.col("weight_before")) <= F.col("amount") + 1e-6
    order = materialize(order.select(*LEVELS, "last", "tokens", "room", "weight", full.alias("full")))
    filled = {tuple(r[k] for k in keys): (r["room"], r["weight"]) for r in order.where("full").groupBy(*keys).agg(F.sum("room").alias("room"), F.sum("weight").alias("weight")).collect()}
    levels = []
    for *key, amount, whole in nodes:
        held, used = filled.get(tuple(key), (0, 0.0))
        levels.append((*key, max(0.0, amount - held) / (whole - used) if whole - used > 1e-9 else 0.0))
    level = spark.createDataFrame(levels, "domain string, language string, last boolean, level double")
    order = order.join(F.broadcast(level) if len(levels) <= BROADCAST_LEAVES else level, keys)
    return order.select(*LEVELS, "tokens", F.when(F.col("full"), F.col("room").cast("double")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("room"))).alias("given"))


def _told(rows: DataFrame, kept: list[str], weights: Weights, share: float, epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`_members` with ``whole, rest, target``, their ``order`` and the tokens ``before`` them; and the leaves' plan."""
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")))
    count, tokens, n = leaves.agg(F.count("*"), F.sum("tokens"), F.sum("n")).first()
    given = leaf_budgets(leaves.drop("n"), share * (tokens or 0), weights, epochs)
    whole = F.least(F.lit(epochs), F.floor((F.col("given") + 1e-6) / F.col("tokens")).cast("int"))
    plan = given.select(*LEVELS, whole.alias("whole"), F.round(F.col("given") - whole * F.col("tokens")).cast("long").alias("rest"), F.round("given").cast("long").alias("target"))
    plan = materialize(plan)
    told = rows.join(F.broadcast(plan) if count <= BROADCAST_LEAVES else plan, LEVELS).withColumn("order", _order(seed))
    return with_before(told, LEVELS, "order", ["doc_id", *kept], F.col("tokens"), bits_for(n or 0)), plan


def _order(seed: int) -> Column:
    """Place of a document in its leaf's next epoch."""
    return F.xxhash64(F.lit(seed), F.col("whole"), "doc_id", "digest")


def select(docs: DataFrame, weights: Weights = DEFAULT, share: float = 0.7, epochs: int = 2, seed: int = 13, domain: Column | None = None) -> DataFrame:
    """``doc_id, domain, language, branch, tokens, copies, target`` of the selected documents.

    The budget is ``share`` of all tokens; a document is taken at most ``epochs`` times,
    which ``copies`` tells; ``target`` are the tokens its leaf was given.
    """
    rows = materialize(_members(docs, default_domain() if domain is None else domain, []))
    told, _ = _told(rows, [], weights, share, epochs, seed)
    copies = F.col("whole") + (F.col("before") + F.col("tokens") <= F.col("rest")).cast("int")
    return told.withColumn("copies", copies).where("copies > 0").select("doc_id", *LEVELS, "tokens", "copies", "target")


def keep_selected(docs: DataFrame, weights: Weights = DEFAULT, share: float = 0.7, epochs: int = 2, seed: int = 13) -> DataFrame:
    """The rows of ``docs`` that are selected, each as often as it is taken.

    What a leaf takes of its next epoch is a prefix of an order, so the last row taken tells for
    every row whether it belongs: documents meet the table of leaves and are never shuffled.
    """
    every, place = numbered(docs), ["_file", "_at"]
    fields = ["_row.doc_id", "_row.text", "_row.lang", "_row.source"]
    rows = materialize(_members(every.select(*place, *fields), default_domain(), place))
    told, plan = _told(rows, place, weights, share, epochs, seed)
    # As signed longs, hashes compare like unsigned ones once their first bit is turned.
    at = F.struct(F.col("order").bitwiseXOR(F.lit(-(1 << 63))).alias("order"), "doc_id", *place)
    ends = told.where(F.col("before") + F.col("tokens") <= F.col("rest")).groupBy(*LEVELS).agg(F.max(at).alias("end"))
    plan = materialize(plan.join(ends, LEVELS, "left").select(*LEVELS, "whole", "end"))
    named = every.select("*", *fields).where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    named = named.select("_row", *place, F.col("doc_id").cast("long").alias("doc_id"), default_domain().alias("domain"), F.coalesce("lang", F.lit("und")).alias("language"), F.coalesce("source", F.lit("none")).alias("branch"), F.xxhash64("text").alias("digest"))
    taken = named.join(F.broadcast(plan) if plan.count() <= BROADCAST_LEAVES else plan, LEVELS).withColumn("order", _order(seed))
    copies = F.col("whole") + F.coalesce((at <= F.col("end")).cast("int"), F.lit(0))
    return taken.withColumn("copies", copies).where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), "copies"))).select("_row.*")
