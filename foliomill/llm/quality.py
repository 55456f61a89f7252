"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Words are hashed to buckets. Each bucket has a sparse ternary index vector, and its context
vector is the sum of the index vectors of the words that stand next to it anywhere in the
corpus: tasks count in whole numbers, and their sums are added up by ranges of buckets, so the
driver sees one table of fixed size. A document is the mean of its words' vectors, the mean of
its word shapes' index vectors and a few norms of these pools; a two-layer numpy network
maps it to a logit, which a temperature fitted on rows kept from training calibrates.

Only the network learns from a bounded sample: ``sample_rows`` labelled rows at most, those
with the smallest hashes of doc_id. Scoring is one row-local pass over all texts.

Defined results: null and empty texts pool to zeros and get the network's score for that; a
sample with a single class gives its smoothed rate to every text, none at all gives 0.5;
labels (any type that casts to a number; above 0 is good) repeated for a doc_id count as the
lowest; rows are scored one by one, so repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER, SPACED, bounded_batches, encode, slices, tokenize, word_hashes

BUCKETS, DIM, SHAPES, NONZERO = 1 << 14, 32, 256, 4
#: Ranges of buckets whose sums are added up apart.
RANGES = 64


def index_vectors(rows: int, seed: int) -> np.ndarray:
    """``rows`` sparse vectors with ``NONZERO`` entries of 1 or -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, DIM), dtype=np.float32)
    at = np.argsort(rng.random((rows, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.float32([-1, 1]), (rows, NONZERO)), axis=1)
    return out


INDEX, SHAPE_INDEX = index_vectors(BUCKETS, 11), index_vectors(SHAPES, 12)
#: For each bucket the places of its index vector's entries, those of -1 moved on by ``DIM``.
_ENTRIES = (np.nonzero(INDEX)[1] + DIM * (INDEX[INDEX != 0] < 0)).reshape(BUCKETS, NONZERO).astype(np.int64)

_KIND = np.zeros(256, dtype=np.uint8)  # 0 other, 1 lower or non-ASCII, 2 upper, 3 digit
_KIND[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[range(0x41, 0x5B)] = 2
_KIND[range(0x30, 0x3A)] = 3
_END = np.zeros(256, dtype=np.uint8)  # 0 letter or digit, 1 stop, 2 comma and the like, 3 any other mark
_END[range(0x21, 0x30)] = _END[range(0x3A, 0x41)] = _END[range(0x5B, 0x61)] = _END[range(0x7B, 0x7F)] = 3
_END[[ord(x) for x in ".?"]] = 1
_END[[ord(x) for x in ",;:)\"'"]] = 2


def _read(texts: list[bytes]):
    """Tokens with their bucket and shape."""
    raw = tokenize(texts, SPACED)
    low = tokenize([x.translate(LOWER) for x in texts], SPACED)
    bucket = (word_hashes(low) & np.uint64(BUCKETS - 1)).astype(np.int64)
    same = np.zeros(len(bucket), dtype=np.uint8)
    if len(bucket) > 1:
        same[1:] = (bucket[1:] == bucket[:-1]) & (raw.doc[1:] == raw.doc[:-1])
    size = raw.end - raw.start
    last = raw.buf[raw.end - 1]
    second = raw.buf[np.minimum(raw.start + 1, raw.end - 1)]
    shape = _KIND[raw.buf[raw.start]] | (_KIND[second] << 2) | (_END[last] << 4) | (same << 6) | ((size == 1).astype(np.uint8) << 7)
    return raw, bucket, shape


def contexts(texts: list[bytes], window: int = 2) -> np.ndarray:
    """Sums of the index vectors of each bucket's neighbours."""
    out = np.zeros(BUCKETS * 2 * DIM, dtype=np.int64)
    for _, part in slices(texts):
        words = tokenize([x.translate(LOWER) for x in part], SPACED)
        bucket = (word_hashes(words) & np.uint64(BUCKETS - 1)).astype(np.int64)
        for gap in range(1, window + 1):
            near = words.doc[gap:] == words.doc[:-gap]
            after, before = bucket[gap:][near], bucket[:-gap][near]
            for at in range(0, len(after), 1 << 16):
                a, b = after[at : at + (1 << 16)], before[at : at + (1 << 16)]
                places = np.concatenate([a[:, None] * (2 * DIM) + _ENTRIES[b], b[:, None] * (2 * DIM) + _ENTRIES[a]])
                np.add.at(out, places.ravel(), 1)
    out = out.reshape(BUCKETS, 2, DIM)
    return out[:, 0] - out[:, 1]


def word_vectors(docs: DataFrame) -> np.ndarray:
    """A vector for each bucket, from all texts of ``docs``."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, DIM), dtype=np.int64)
        for batch in batches:
            total += contexts([encode(t.as_py()) for t in batch.column(0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array([x.tobytes() for x in np.split(total, RANGES)], pa.binary())], names=["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[part] = held.get(part, 0) + np.frombuffer(sums.as_buffer(), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["part", "sums"])

    vectors = np.zeros((RANGES, BUCKETS // RANGES * DIM), dtype=np.float64)
    schema = "part int, sums binary"
    for row in docs.select("text").mapInArrow(gather, schema).repartition("part").mapInArrow(add, schema).collect():
        vectors[row["part"]] = np.frombuffer(row["sums"], dtype=np.int64)
    vectors = vectors.reshape(BUCKETS, DIM)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return (vectors + 0.5 * INDEX).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """A row of features for each text."""
    out = np.zeros((len(texts), 2 * DIM + 5), dtype=np.float32)
    for at, part in slices(texts):
        words, bucket, shape = _read(part)
        n = np.diff(words.first)
        full = np.flatnonzero(n)
        if not len(full):
            continue
        mean = np.zeros((len(part), DIM), dtype=np.float32)
        plain = np.zeros_like(mean)
        for lo in range(0, len(full), 64):  # bounded, as a row for each word is made
            some = full[lo : lo + 64]
            for a in _pieces(words.first[some[0]], words.first[some[-1] + 1]):
                rows = words.doc[a]
                heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                mean[rows[heads]] += np.add.reduceat(vectors[bucket[a]], heads, axis=0)
                plain[rows[heads]] += np.add.reduceat(INDEX[bucket[a]], heads, axis=0)
        size = np.maximum(n, 1)[:, None].astype(np.float32)
        mean, plain = mean / size, plain / size
        shapes = np.bincount(words.doc * SHAPES + shape, minlength=len(part) * SHAPES).reshape(len(part), SHAPES).astype(np.float32) / size
        row = out[at : at + len(part)]
        row[:, :DIM], row[:, DIM : 2 * DIM] = mean, shapes @ SHAPE_INDEX
        row[:, -5:] = np.stack([np.log1p(n), np.linalg.norm(mean, axis=1), np.linalg.norm(plain, axis=1) * np.sqrt(n), np.linalg.norm(shapes, axis=1), np.linalg.norm(plain, axis=1)], axis=1)
    return out


def _pieces(a: int, b: int, most: int = 1 << 18) -> Iterator[slice]:
    for at in range(a, b, most):
        yield slice(at, min(b, at + most))


@dataclass
class Network:
    """``tanh`` layer and logistic output over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x.astype(np.float64)) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 5) -> Network:
    """Adam on the log loss; every fifth row picks the best epoch and then the temperature."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    width = x.shape[1] if x.ndim == 2 else 2 * DIM + 5
    rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    flat = Network(np.zeros(width), np.ones(width), np.zeros((width, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(rate / (1 - rate))))
    check = np.arange(len(y)) % 5 == 4
    if len(y) < 20 or len(set(y[~check])) < 2 or not check.any():
        return flat
    rng = np.random.default_rng(seed)
    net = Network(x[~check].mean(axis=0), x[~check].std(axis=0) + 1e-6, rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), flat.b2)
    z = np.clip((x - net.mean) / net.scale, -6, 6)
    fit, kept = np.flatnonzero(~check), np.flatnonzero(check)
    params = {k: np.array(getattr(net, k), dtype=np.float64) for k in ("w1", "b1", "w2", "b2")}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    best, step = (np.inf, None), 0

    def loss(logit: np.ndarray, t: float = 1.0) -> float:
        return float(np.mean(np.logaddexp(0, logit / t) - y[kept] * logit / t))

    for _ in range(epochs):
        rng.shuffle(fit)
        for at in range(0, len(fit), 64):
            rows = fit[at : at + 64]
            h = np.tanh(z[rows] @ params["w1"] + params["b1"])
            err = (1 / (1 + np.exp(-np.clip(h @ params["w2"] + params["b2"], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(err, params["w2"]) * (1 - h * h)
            grads = {"w1": z[rows].T @ back + 1e-4 * params["w1"], "b1": back.sum(axis=0), "w2": h.T @ err + 1e-4 * params["w2"], "b2": err.sum()}
            step += 1
            for k, g in grads.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[k] = params[k] - 3e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                moment[k] = (m, v)
        now = loss(np.tanh(z[kept] @ params["w1"] + params["b1"]) @ params["w2"] + params["b2"])
        if now < best[0]:
            best = (now, {k: v.copy() for k, v in params.items()})
    for k, v in best[1].items():
        setattr(net, k, v)
    logit = net.logit(x[kept])
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda t: loss(logit, t)))
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.network.score(pooled([encode(t) for t in texts], self.vectors))


def sample_of(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """``doc_id, text, quality`` (0 or 1) of at most ``sample_rows`` rows, those of the smallest hashes of doc_id."""
    good = (F.col("quality").cast("double") > 0).cast("int")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), good.alias("quality")).where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = [F.xxhash64("doc_id", F.lit(1)), "doc_id"]
    chosen = known.orderBy(*order).limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    # Only if ids repeat are there more rows than that.
    return rows.orderBy(*order, F.xxhash64("text")).limit(sample_rows)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, tasks: int = 8) -> QualityModel:
    """Learn from at most ``sample_rows`` labelled rows; ``labels`` has doc_id and quality."""
    spark = docs.sparkSession
    bounded_batches(spark)
    vectors = word_vectors(docs)
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pooled([encode(t.as_py()) for t in batch.column(1)], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(rows), pa.list_(pa.float32()))], names=["doc_id", "quality", "x"])

    sample = sample_of(docs, labels, sample_rows).repartition(tasks, "doc_id")
    made = sample.mapInArrow(features, "doc_id long, quality int, x array<float>").toPandas()
    x = np.array(made.x.tolist(), dtype=np.float32)
    order = np.lexsort((*x.T[:4], made.doc_id.to_numpy())) if len(x) else slice(0)
    return QualityModel(vectors, train(x[order], made.quality.to_numpy()[order]))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score`` of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1).to_pylist()))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted``; no label is learned of rows whose crc32 of doc_id mod 4 is 2."""
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = fit(docs, labels.where(~out), **options)
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
