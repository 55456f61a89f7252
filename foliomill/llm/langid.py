"""Language identification by language-bitmask n-gram filters.

Training counts the character n-grams of a bounded sample of labelled rows on Spark and keeps
the most frequent ones of each language. They go into one bit-sliced Bloom filter: a slot
holds a bitmask with one bit for each language, and the AND of an n-gram's slots is the set
of all languages that contain it. A document's languages are scored by the popcount of each
bit over all its n-grams, less the hits that the filter's fill lets expect by chance.

Defined results: null text, empty text and text without a letter give ``und`` with score 0,
as does every text if nothing could be learned; ties go to the language that sorts first;
texts of any length are read whole, in overlapping pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import bounded_batches, mix

UNKNOWN = "und"
SIZES = (3, 4)
HASHES = 3
_PIECE = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def ngrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of n-gram hashes, the index of each one's text, and the texts seen to have a letter.

    Texts are lower-cased; runs of other characters than letters count as one space, and a
    space stands before and after each text. A block holds about ``_PIECE`` characters, and a
    longer text is cut into pieces that overlap, so memory doesn't follow the texts.
    """
    held: list[tuple[int, str]] = []
    size, overlap = 0, max(SIZES) - 1
    for i, text in enumerate(texts):
        text = f" {(text or '').lower()} "
        for at in range(0, max(1, len(text) - overlap), _PIECE):
            piece = text[at : at + _PIECE + overlap]
            if held and size + len(piece) > _PIECE:
                yield _block(held)
                held, size = [], 0
            held.append((i, piece))
            size += len(piece)
    if held:
        yield _block(held)


def _block(held: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code = np.frombuffer("".join(x for _, x in held).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    part = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for _, x in held])
    owner = np.array([i for i, _ in held], dtype=np.int32)
    letter = _letters()[code]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (part[1:] != part[:-1])
    code = np.where(letter, code, 32)[keep].astype(np.uint64)
    part, letter = part[keep], letter[keep]
    doc = owner[part]
    grams, docs = [], []
    for n in SIZES:
        m = max(0, len(code) - n + 1)
        h = code[:m] + np.uint64(n)
        for j in range(1, n):
            h = h * _STEP + code[j : j + m]
        ok = part[:m] == part[n - 1 : n - 1 + m]
        grams.append(mix(h[ok]))
        docs.append(doc[:m][ok])
    return np.concatenate(grams), np.concatenate(docs), np.unique(doc[letter])


@dataclass
class LanguageFilter:
    """Bit-sliced Bloom filter: ``slots[i, w]`` has bit b set for language 64 w + b."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray = field(default=None)

    @staticmethod
    def build(grams: dict[str, np.ndarray], slot_bits: int) -> LanguageFilter:
        languages = sorted(grams)
        slots = np.zeros((1 << slot_bits, max(1, -(-len(languages) // 64))), dtype=np.uint64)
        for i, name in enumerate(languages):
            for at in LanguageFilter.places(grams[name], slot_bits):
                slots[at, i // 64] |= np.uint64(1 << (i % 64))
        fill = [((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))]
        return LanguageFilter(languages, slots, np.array(fill) ** HASHES)

    @staticmethod
    def places(grams: np.ndarray, slot_bits: int) -> list[np.ndarray]:
        low = np.uint64((1 << slot_bits) - 1)
        return [((grams >> np.uint64(21 * j)) & low).astype(np.int64) for j in range(HASHES)]

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        has = np.zeros(len(texts), dtype=bool)
        total = np.zeros(len(texts))
        hits = np.zeros((len(self.languages), len(texts)))
        bits = int(self.slots.shape[0]).bit_length() - 1
        for grams, doc, lettered in ngrams(texts):
            has[lettered] = True
            total += np.bincount(doc, minlength=len(texts))
            places = self.places(grams, bits)
            for w in range(self.slots.shape[1]):
                mask = self.slots[places[0], w]
                for at in places[1:]:
                    mask &= self.slots[at, w]
                for b in range(min(64, len(self.languages) - 64 * w)):
                    hits[64 * w + b] += np.bincount(doc, weights=(mask >> np.uint64(b)) & np.uint64(1), minlength=len(texts))
        total = np.maximum(total, 1)
        rate = self.false_rate[:, None]
        share = np.clip((hits / total - rate) / (1 - np.minimum(rate, 0.999)), 0, 1)
        best = share.argmax(axis=0)
        for i in np.flatnonzero(has):
            names[i], scores[i] = self.languages[best[i]], share[best[i], i]
        return names, scores


def fit(labelled: DataFrame, per_language: int = 3000, grams_each: int = 12000, slot_bits: int = 18, strays: float = 50.0) -> LanguageFilter:
    """Learn from (doc_id, text, lang) rows; about ``per_language`` rows of each language are read.

    The rows are those of the smallest hashes of doc_id, so the sample is the same at each run.
    An n-gram that another language has ``strays`` times as often is left out as a stray.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageFilter.build({}, slot_bits)
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    chosen = rows.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(8)), F.lit(1 << 30)) < rate[F.col("lang")] * float(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in sorted(set(langs)):
                for grams, _, _ in ngrams([t for x, t in zip(langs, texts) if x == name]):
                    values, n = np.unique(grams, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counts = chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("place", place).where(F.col("place") <= grams_each).select("lang", "gram", "n").toPandas()
    share = top.n / top.groupby("lang").n.transform("sum")
    top = top[share * strays >= share.groupby(top.gram).transform("max")]
    return LanguageFilter.build({name: group.gram.to_numpy().view(np.uint64) for name, group in top.groupby("lang")}, slot_bits)


def predict(docs: DataFrame, model: LanguageFilter, keep: list[str]) -> DataFrame:
    """``_row`` (the columns ``keep``), ``_lang`` and ``_score`` of every row, in one pass."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    inside = "text" in keep
    inner = docs.select(row.alias("_row")) if inside else docs.select(row.alias("_row"), F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field("text") if inside else batch.column(1)
            names, scores = shared.value.score(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["_row", "_lang", "_score"])

    kind = inner.schema["_row"].dataType.simpleString()
    return inner.mapInArrow(run, f"_row {kind}, _lang string, _score double")


def held_out(doc_id=None, parts: int = 3, part: int = 1):
    """Whether crc32 of doc_id as text leaves the remainder that no model learns from."""
    doc_id = F.col("doc_id") if doc_id is None else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


def identify(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, learned from the rows not held out."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"), **options)
    doc_id = F.col("_row.doc_id")
    return predict(docs, model, ["doc_id"]).select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def keep_identified(docs: DataFrame, least: float = 0.25, **options) -> DataFrame:
    """The rows whose language is known and fills at least ``least`` of the text; a null ``lang`` gets the predicted one."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"), **options)
    kept = predict(docs, model, docs.columns).where((F.col("_lang") != UNKNOWN) & (F.col("_score") >= least))
    return kept.select(*[F.coalesce("_row.lang", "_lang").alias(c) if c == "lang" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
