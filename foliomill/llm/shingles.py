"""Near duplicates by the exact Jaccard similarity of word shingles.

Candidates share one of sixteen bands of four minima over hashed shingles, which pairs at the
least similarity of 0.8 miss with a chance of 2 in 10,000 and more similar ones far less. Each
band value's documents are first compared with the first of them, so a large group costs one
comparison a member; of these pairs only those whose minima agree often enough (a pair at the
least similarity fails that with a chance of 1 in 2 million) fetch their texts. What lies in different components but shares a band value is then dealt
to blocks of bounded size, each of which counts the shared shingles of all its members at once
and returns a spanning forest of the links it finds: no pair becomes a row unless it is a link
that joins two components. Every link is verified on the whole sets of shingles.

Defined results: a text of fewer than ``WIDTH`` words is one shingle; texts without words are
linked to none; rows are compared as rows, whether or not their ids are null or repeated.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, numbered, without
from .simhash import components, first_row
from .words import LOWER, SPACED, bounded_batches, encode, gram_hashes, mix, slices, tokenize, word_hashes

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 16, 4
#: Documents and shingles that half a block should hold at most, on average.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20
#: Minima, of all, that a pair must agree in (in their last byte) for its texts to be compared.
AGREEING = 36
_KEYS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))[:, None]


def shingle_sets(texts: Iterable[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The distinct hashes of each text's shingles, sorted."""
    for _, chunk in slices(encode(t).translate(LOWER) for t in texts):
        words = tokenize(chunk, SPACED)
        hashes = word_hashes(words)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            own = hashes[a:b]
            yield np.unique(gram_hashes(own, np.zeros(len(own), dtype=np.int64), min(width, len(own)))[0]) if len(own) else own


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of the shingles under each of the hash functions."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(shingles), 4096):
        x = (shingles[None, at : at + 4096] ^ _KEYS) * (_KEYS | np.uint64(1))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum(least, x.min(axis=1))
    return mix(least)


def bands(least: np.ndarray) -> np.ndarray:
    """One value for each band of minima."""
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + row)
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def common(sets: list[np.ndarray], dense: int = 48) -> np.ndarray:
    """How many shingles any two of the sets share (above the diagonal).

    A shingle that few sets hold counts for its pairs one by one; those that many hold are
    columns of a 0/1 matrix, whose product with itself counts them for all pairs at once.
    """
    n = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")  # so owners ascend within a value
    values, owner = values[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    size = np.diff(np.append(begin, len(values)))
    out = np.zeros((n, n), dtype=np.int64)
    for f in np.unique(size[(size > 1) & (size <= dense)]).tolist():
        i, j = np.triu_indices(f, 1)
        heads = begin[size == f]
        step = max(1, (1 << 21) // len(i))
        for at in range(0, len(heads), step):
            held = owner[heads[at : at + step, None] + np.arange(f)]
            out += np.bincount((held[:, i] * n + held[:, j]).ravel(), minlength=n * n).reshape(n, n)
    heads, sizes = begin[size > dense], size[size > dense]
    for at in range(0, len(heads), 2048):
        own = np.concatenate([owner[h : h + k] for h, k in zip(heads[at : at + 2048], sizes[at : at + 2048])])
        matrix = np.zeros((n, len(heads[at : at + 2048])), dtype=np.float32)
        matrix[own, np.repeat(np.arange(matrix.shape[1]), sizes[at : at + 2048])] = 1
        out += (matrix @ matrix.T).astype(np.int64)
    return np.triu(out, 1)


def forest(sets: list[np.ndarray], roots: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links between sets of different roots, as few as connect whatever is linked."""
    both = common(sets)
    size = np.array([len(x) for x in sets])
    a, b = np.nonzero((both > 0) & (both >= least * (size[:, None] + size[None, :] - both) - 1e-9) & (roots[:, None] != roots[None, :]))
    low, high = np.minimum(roots[a], roots[b]), np.maximum(roots[a], roots[b])
    _, some = np.unique(np.stack([low, high], axis=1), axis=0, return_index=True)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in some.tolist():
        x, y = root(int(low[i])), root(int(high[i]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(a[i]), int(b[i])))
    return out


def signatures(rows: DataFrame) -> DataFrame:
    """``node, doc_id, _file, _at, size, cells, sketch`` of the rows (_file, _at, doc_id, text) that have words."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(t.as_py() for t in batch.column(3)))
            least = [minima(x) if len(x) else None for x in sets]
            cells = pa.array([None if x is None else bands(x).view(np.int64) for x in least], pa.list_(pa.int64()))
            sketch = pa.array([None if x is None else x.astype(np.uint8).tobytes() for x in least], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in sets], pa.int64()), cells, sketch], names=["_file", "_at", "doc_id", "size", "cells", "sketch"])

    made = rows.select("_file", "_at", "doc_id", "text").mapInArrow(run, "_file long, _at long, doc_id long, size long, cells array<long>, sketch binary")
    return materialize(made.where("size > 0").withColumn("node", F.monotonically_increasing_id()))


def likely(signed: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose minima agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= AGREEING))

    first, second = (signed.select(F.col("node").alias(i), F.col("sketch").alias(f"sketch_{i}")) for i in "ab")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def verified(texts: DataFrame, pairs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose ``texts`` (node, text) have at least that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(shingle_sets(t.as_py() for t in batch.column(2)), shingle_sets(t.as_py() for t in batch.column(3)))
            yield batch.select([0, 1]).filter(pa.array([jaccard(x, y) >= least - 1e-9 for x, y in both], pa.bool_()))

    first, second = (texts.withColumnsRenamed({"node": i, "text": f"text_{i}"}) for i in "ab")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def block_links(blocks: DataFrame, least: float) -> DataFrame:
    """``a, b``: links that connect different roots in each block of ``blocks`` (block, node, root, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        now = None

        def flush() -> pa.RecordBatch:
            found = forest([x[2] for x in held], np.array([x[1] for x in held]), least) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([held[p[i]][0] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            block, node, root = (batch.column(i).to_pylist() for i in range(3))
            for x, n, r, s in zip(block, node, root, shingle_sets(t.as_py() for t in batch.column(3))):
                if x != now:
                    yield flush()
                    held, now = [], x
                held.append((n, r, s))
        yield flush()

    return blocks.repartition("block").sortWithinPartitions("block").select("block", "node", "root", "text").mapInArrow(run, "a long, b long")


def blocks_of(mixed: DataFrame, members: DataFrame) -> DataFrame:
    """``block, node, root``: the members of each cell dealt so that any two meet in one block of bounded size."""
    parts = F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    apart = members.join(mixed.select("cell", parts.alias("parts")), "cell")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    several = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(part, j).alias("i"), F.greatest(part, j).alias("j")))
    return apart.select("cell", "node", "root", F.explode(several).alias("p")).select(F.xxhash64("cell", "p.i", "p.j").alias("block"), "node", "root")


def linked(signed: DataFrame, rows: DataFrame, least: float = LEAST) -> DataFrame:
    """``node, root``: the components of the rows that are linked to any other.

    ``signed`` is what :func:`signatures` returns for ``rows`` (_file, _at, text).
    """
    every = signed.select("node", "size", F.explode("cells").alias("cell"))
    many = materialize(every.groupBy("cell").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("cell", "a"))
    shared = materialize(every.join(many, "cell").select("cell", "a", "node", "size"))
    star = materialize(likely(signed, shared.where("a <> node").select("a", F.col("node").alias("b")).distinct()))
    # Texts of rows that any other may be like are read once; the join is the same at every size.
    wanted = signed.select("_file", "_at", "node").join(shared.select("node").distinct(), "node", "left_semi")
    texts = materialize(rows.select("_file", "_at", "text").join(wanted.hint("merge"), ["_file", "_at"]).select("node", "text"))
    links = materialize(verified(texts, star, least))
    named = shared.join(components(links), "node", "left").select("cell", "node", "size", F.coalesce("root", "node").alias("root"))
    named = materialize(named)
    # Bands that hold the very same documents would be compared to the same end: one of them is enough.
    alike = (F.count("*").alias("rows"), F.sum("size").alias("shingles"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.sum(F.hash("node").cast("long")).alias("y"))
    mixed = named.groupBy("cell").agg(F.min("root").alias("a"), F.max("root").alias("z"), *alike).where("a <> z")
    mixed = materialize(mixed.groupBy("rows", "shingles", "x", "y").agg(F.min("cell").alias("cell")))
    blocks = materialize(blocks_of(mixed, named))
    return components(links.union(block_links(blocks.join(texts, "node"), least)))


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` without the rows that aren't their component's first one."""
    every = numbered(docs)
    rows = every.select("_file", "_at", F.col("_row.doc_id").cast("long").alias("doc_id"), F.col("_row.text").alias("text"))
    signed = signatures(rows)
    parts = materialize(linked(signed, rows, least))
    rows = signed.select("node", "doc_id", "_file", "_at").join(parts, "node")
    stays = rows.groupBy("root").agg(first_row().alias("least")).select("least._file", "least._at")
    return without(every, materialize(rows.select("_file", "_at").join(stays, ["_file", "_at"], "left_anti")))
