"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are made row by row. The top of the hierarchies are masked bit patterns: the 64
bits are cut into ``limit`` + j blocks, and two values that differ in at most ``limit`` bits
agree in some j of them. Distinct fingerprints are dealt to the cells of these patterns; j
grows with the logarithm of their number, so that a cell stays small and a fingerprint goes
to 5, 15 or 35 cells, not to a number that follows the corpus. Each cell sorts its members by
Gray rank and builds the lower nodes: a node holds the bits that all its members share, with
the bits already held by its parent taken out. A search adds up the differing bits on the way
down and drops a whole subtree as soon as they exceed the limit. A cell returns a spanning
forest of its links, never all pairs; components are then found by alternating star
contractions on Spark.

Defined results: a null text counts as empty; a text without words has fingerprint zero and
is linked like any other; rows that repeat a doc_id are one document for components (each
row is returned); a null doc_id never is a component's name unless no member has an id.
``keep_one`` looks at rows and not at ids: one row of each group of alike texts stays, that of
the smallest doc_id (rows without one come last), whether or not ids are null or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize, numbered, without
from .words import LOWER, bounded_batches, encode

BITS = 64


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the XXH64 (seed 42) values of ``width``-word shingles, repeats included."""
    import xxhash

    words = encode(text).translate(LOWER).split()
    if not words:
        return 0
    run = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(run, 42)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_digest
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), 1 << 16):
        raw = b"".join([digest(run[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])])
        ones += np.unpackbits(np.frombuffer(raw, dtype=np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """The columns of ``docs`` but for ``text``, which gives way to ``fp`` (the fingerprint as a signed long)."""
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), width) for t in batch.column(len(kept))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(values.view(np.int64))], names=[*kept, "fp"])

    rows = docs.select(*kept, "text")
    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "text") + ", fp long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray sequence."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchies over fingerprints sorted by (cell, Gray rank), one tree for each cell.

    ``levels[0]`` are the fingerprints; a node of a higher level covers up to ``fan``
    neighbours of the level below. ``mask`` are the bits that a node decides and its parent
    doesn't, ``bits`` their values.
    """

    def __init__(self, cell: np.ndarray, values: np.ndarray, fan: int = 8):
        full = np.full(len(values), ~np.uint64(0))
        masks, bits, self.child, cells = [full], [values], [], [cell]
        while True:
            c = cells[-1]
            fresh = np.concatenate([[True], c[1:] != c[:-1]])
            if fresh.all() and self.child:
                break
            begin = np.flatnonzero(fresh)
            within = np.arange(len(c)) - np.repeat(begin, np.diff(np.append(begin, len(c))))
            heads = np.flatnonzero(within % fan == 0)
            ones = np.bitwise_and.reduceat(bits[-1] | ~masks[-1], heads)
            any_ = np.bitwise_or.reduceat(bits[-1] & masks[-1], heads)
            shared = np.bitwise_and.reduceat(masks[-1], heads) & ~(ones ^ any_)
            masks.append(shared)
            bits.append(ones & shared)
            self.child.append(np.append(heads, len(c)))
            cells.append(c[heads])
        for level in range(len(masks) - 1):  # take out what the parent already holds
            parent = np.repeat(masks[level + 1], np.diff(self.child[level]))
            masks[level] = masks[level] & ~parent
        self.mask, self.bits, self.root_cell = masks, bits, cells[-1]

    def search(self, queries: np.ndarray, roots: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index of a query, index of a fingerprint in its tree) within ``limit`` bits."""
        top = len(self.mask) - 1
        q, node = np.arange(len(queries)), roots
        spent = np.bitwise_count((queries ^ self.bits[top][node]) & self.mask[top][node]).astype(np.int16)
        for level in range(top - 1, -1, -1):
            live = spent <= limit
            q, node, spent = q[live], node[live], spent[live]
            low, high = self.child[level][node], self.child[level][node + 1]
            n = high - low
            q, spent = np.repeat(q, n), np.repeat(spent, n)
            node = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            spent = spent + np.bitwise_count((queries[q] ^ self.bits[level][node]) & self.mask[level][node])
        live = spent <= limit
        return q[live], node[live]


def forest(cell: np.ndarray, values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, value of its root) that connect what links within each cell."""
    order = np.lexsort((gray_rank(values), cell))
    cell, values = cell[order], values[order]
    fresh = np.concatenate([[True], cell[1:] != cell[:-1]])
    many = np.repeat(np.diff(np.append(np.flatnonzero(fresh), len(cell))) > 1, np.diff(np.append(np.flatnonzero(fresh), len(cell))))
    cell, values = cell[many], values[many]
    if not len(cell):
        return values, values
    index = GrayIndex(cell, values)
    roots = np.searchsorted(index.root_cell, cell)
    parent = np.arange(len(cell))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for at in range(0, len(cell), 512):
        q, hit = index.search(values[at : at + 512], roots[at : at + 512], limit)
        q = q + at
        new = q < hit
        a, b = parent[q[new]], parent[hit[new]]
        for x, y in np.unique(np.stack([a[a != b], b[a != b]], axis=1), axis=0).tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        while (flat := parent[parent]).tolist() != parent.tolist():
            parent = flat
    moved = parent != np.arange(len(cell))
    return values[moved], values[parent[moved]]


def patterns(limit: int, agreeing: int) -> list[int]:
    """Masks such that two values within ``limit`` bits are equal under one of them, as signed longs."""
    blocks = limit + agreeing
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    block = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    masks = [sum(x) for x in combinations(block, agreeing)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def agreeing_blocks(fingerprints: int, limit: int, cell_most: int) -> int:
    """Fewest blocks that must agree so that an average cell has at most ``cell_most`` of so many fingerprints."""
    j = 1
    while fingerprints >> (BITS * j // (limit + j)) > cell_most and j < 8:
        j += 1
    return j


def links(fps: DataFrame, limit: int = 4, cell_most: int = 8192, agreeing: int | None = None) -> DataFrame:
    """``a, b``: a spanning set of the links between distinct fingerprints ``fp``.

    A pattern shared by more than ``cell_most`` fingerprints is dealt out by hash to the
    cells of a triangle, so that each pair still meets in one cell of bounded size.
    """
    masks = patterns(limit, agreeing or agreeing_blocks(fps.count(), limit, cell_most))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(m).alias("key")) for i, m in enumerate(masks)]))
    dealt = fps.select("fp", each.alias("e")).select("fp", "e.mask", "e.key")
    hot = dealt.groupBy("mask", "key").count().where(F.col("count") > cell_most).select("mask", "key", F.ceil(F.col("count") / cell_most).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = dealt.join(hot, ["mask", "key"], "left").select("fp", "mask", "key", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit("")))
        .otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda j: F.concat_ws("/", F.least(part, j), F.greatest(part, j))))).alias("sub"))
    cells = cells.select("fp", F.xxhash64("mask", "key", "sub").alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_c, held_v, size = [], [], 0

        def flush(c: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            a, b = forest(c, v.view(np.uint64), limit)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held_c.append(batch.column(0).to_numpy())
            held_v.append(batch.column(1).to_numpy())
            size += batch.num_rows
            if size >= 1 << 16:
                c, v = np.concatenate(held_c), np.concatenate(held_v)
                cut = int(np.searchsorted(c, c[-1]))  # the last cell may go on
                if cut:
                    yield flush(c[:cut], v[:cut])
                held_c, held_v, size = [c[cut:]], [v[cut:]], len(c) - cut
        if size:
            yield flush(np.concatenate(held_c), np.concatenate(held_v))

    return cells.repartition("cell").sortWithinPartitions("cell").select("cell", "fp").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b): alternating large-star and small-star.

    Each round is a handful of joins and aggregations with map-side combine, written to the
    shared folder; rounds grow with the logarithm of the longest chain. The smallest neighbours
    are written before they are joined, so that a hub's edges can be split over tasks.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = materialize(down.groupBy("a").agg(F.min("b").alias("m")))
        moved = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select("a", F.col("m").alias("b")))

    state = lambda e: e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.hash("a", "b").cast("long"))).first()
    edges = materialize(edges.where(F.col("a") != F.col("b")).distinct())
    before = state(edges)
    while before[0]:
        after = materialize(small(large(edges).distinct()).where(F.col("a") != F.col("b")).distinct())
        discard(edges)
        edges, now = after, state(after)
        if now == before:
            break
        before = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, width: int = 4, limit: int = 4, cell_most: int = 8192) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (doc_id, text)."""
    rows = materialize(fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), width))
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # Rows that repeat a doc_id with other texts are one document: its fingerprints are linked.
    split = rows.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("doc_id is not null and a <> b").select("doc_id", "a")
    same = rows.join(split, "doc_id").select("a", F.col("fp").alias("b"))
    named = materialize(_named(classes, components(links(classes.select("fp"), limit, cell_most).union(same))))
    names = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")))
    members = named.select("fp", "root").join(names, "root").select("fp", "component_id")
    return rows.join(members, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _named(classes: DataFrame, parts: DataFrame) -> DataFrame:
    """``classes`` with the ``root`` of each fingerprint's component."""
    return classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def first_row() -> Column:
    """Order in which one of alike rows is chosen: by doc_id, then by place."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_file", "_at"))


def keep_one(docs: DataFrame, width: int = 4, limit: int = 4, cell_most: int = 8192) -> DataFrame:
    """``docs`` without the rows that aren't their component's first one."""
    every = numbered(docs)
    rows = materialize(fingerprints(every.select("_file", "_at", F.col("_row.doc_id").cast("long").alias("doc_id"), F.col("_row.text").alias("text")), width))
    classes = materialize(rows.groupBy("fp").agg(first_row().alias("least")))
    named = _named(classes, components(links(classes.select("fp"), limit, cell_most)))
    stays = named.groupBy("root").agg(F.min("least").alias("least")).select("least._file", "least._at")
    return without(every, materialize(rows.select("_file", "_at").join(stays, ["_file", "_at"], "left_anti")))
