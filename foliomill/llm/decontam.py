"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

All word n-grams of the test items are seeds, however often they occur: those that survive
in an item's edited copies are the frequent ones if there are many copies. A row-local pass
joins each document's n-grams to the seeds, gathers hits on neighbouring diagonals and aligns
the passage around them with the item, unless the two share too few words for any alignment
to count; the alignment decides, so edited and paraphrased copies count. No document is
shuffled.

The test items are the stated query set. They reach the executors in blocks of at most
``block_bytes`` of text, one pass over the documents for each block, so what is broadcast is
bounded whatever the size of the benchmark.

The score decides (``least_score``): a match has ``least`` of the item's best score, but of
short items, of which a few common words would be as much, ``FIRM`` of it or a score of
``SURE``. Passages copied out of long items count by a score of ``LONG_SCORE`` or by
``LONG_RUN`` equal words in a row. Items of fewer than ``EDITABLE`` words only match unedited.
Items of ``SHORT`` words at most are seeded with pairs of words: an alignment without any
two neighbouring words in common reaches no match there.

Defined results: null and empty texts match nothing; items longer than ``SEGMENT`` words are
sought in segments; a (row, item) pair is returned once, with its best alignment, and
repeated rows once each; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import PLAIN, bounded_batches, encode, gram_hashes, slices, tokenize, word_hashes

GRAM, EDITABLE, SHORT, SEGMENT = 3, 5, 16, 512
FIRM, SURE, LONG_RUN, LONG_SCORE = 0.62, 14, 13, 80
MATCH, MISMATCH, GAP = 2, -1, -1
NEAR, SPAN = 8, 1024
_SLOTS = 1 << 20

LEAKS = "item_id long, similarity double, matched_words int, first_word long, last_word long"


def _low(text: str | None) -> bytes:
    return encode((text or "").lower())


def gram_size(n: int) -> int:
    """Words in a seed of an item of ``n`` words."""
    return n if n < EDITABLE else GRAM - 1 if n <= SHORT else GRAM


def least_score(n: int, least: float) -> float:
    """Score that a match of an item of ``n`` words has at least."""
    if n < EDITABLE:
        return MATCH * n
    return min(LONG_SCORE, max(least * MATCH * n, min(FIRM * MATCH * n, SURE)))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment: score, equal words, first and last word in the passage."""
    m, n = len(item), len(passage)
    step = np.arange(n + 1, dtype=np.int32) * -GAP
    table = np.zeros((m + 1, n + 1), dtype=np.int32)
    for i in range(1, m + 1):
        gain = np.where(passage == item[i - 1], MATCH, MISMATCH).astype(np.int32)
        row = np.maximum(table[i - 1] + GAP, 0)
        row[1:] = np.maximum(row[1:], table[i - 1, :-1] + gain)
        table[i] = np.maximum.accumulate(row + step) - step
    i, j = np.unravel_index(int(table.argmax()), table.shape)
    best, end, same = int(table[i, j]), int(j) - 1, 0
    while i and j and table[i, j] > 0:
        equal = item[i - 1] == passage[j - 1]
        if table[i, j] == table[i - 1, j - 1] + (MATCH if equal else MISMATCH):
            same += bool(equal)
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return best, same, int(j), end


@dataclass
class SeedIndex:
    """Seeds of a block of items: a slot map, the sorted hashes and each one's places."""

    items: list[tuple[int, np.ndarray]]
    hashes: np.ndarray
    begin: np.ndarray
    part: np.ndarray
    place: np.ndarray
    slots: np.ndarray = field(default=None)

    @staticmethod
    def build(items: list[tuple[int, str]]) -> SeedIndex:
        parts = []
        for item_id, text in items:
            h = word_hashes(tokenize([_low(text)], PLAIN))
            if len(h):
                parts += [(item_id, h[at : at + SEGMENT]) for at in range(0, max(1, len(h) - SEGMENT // 2), SEGMENT // 2)]
        grams = [gram_hashes(h, np.zeros(len(h), dtype=np.int64), gram_size(len(h)))[0] for _, h in parts]
        every = np.concatenate([*grams, np.zeros(0, dtype=np.uint64)])
        part = np.repeat(np.arange(len(parts)), [len(g) for g in grams]) if parts else np.zeros(0, dtype=np.int64)
        place = np.concatenate([np.arange(len(g)) for g in grams]) if parts else np.zeros(0, dtype=np.int64)
        return SeedIndex(parts, *SeedIndex._sorted(every, part, place))._with_slots()

    @staticmethod
    def _sorted(every: np.ndarray, part: np.ndarray, place: np.ndarray):
        order = np.argsort(every, kind="stable")
        hashes, begin = np.unique(every[order], return_index=True)
        return hashes, np.append(begin, len(every)), part[order], place[order]

    def _with_slots(self) -> SeedIndex:
        self.slots = np.zeros(_SLOTS, dtype=bool)
        self.slots[(self.hashes & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
        return self

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the grams that are seeds, and which seed each one is."""
        at = np.flatnonzero(self.slots[(grams & np.uint64(_SLOTS - 1)).astype(np.int64)])
        seed = np.searchsorted(self.hashes, grams[at])
        seed[seed == len(self.hashes)] = 0
        ok = self.hashes[seed] == grams[at] if len(self.hashes) else np.zeros(len(at), dtype=bool)
        return at[ok], seed[ok]

    def leaks(self, texts: list[str | None], least: float) -> list[list[tuple]]:
        """For each text its matches ``(item_id, similarity, matched_words, first_word, last_word)``."""
        out: list[list[tuple]] = [[] for _ in texts]
        for base, chunk in slices(map(_low, texts)):
            words = tokenize(chunk, PLAIN)
            hashes = word_hashes(words)
            found = []
            for size in sorted({gram_size(len(h)) for _, h in self.items}):
                grams, start = gram_hashes(hashes, words.doc, size)
                at, own = self.hits(grams)
                found.append((start[at], own))
            first, seed = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2
            if not len(seed):
                continue
            n = np.diff(self.begin)[seed]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[seed], n)
            word = np.repeat(first, n)
            doc, part = words.doc[word], self.part[place]
            diagonal = word - self.place[place]
            order = np.lexsort((word, diagonal, part, doc))
            doc, part, diagonal, word = doc[order], part[order], diagonal[order], word[order]
            # Seeds of consecutive words on one diagonal are a run of equal words.
            ahead = LONG_RUN - GRAM
            run = np.zeros(len(doc), dtype=bool)
            if len(doc) > ahead:
                run[:-ahead] = (doc[ahead:] == doc[:-ahead]) & (part[ahead:] == part[:-ahead]) & (diagonal[ahead:] == diagonal[:-ahead]) & (word[ahead:] - word[:-ahead] == ahead)
            fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1]) | (diagonal[1:] - diagonal[:-1] > NEAR)])
            heads = np.flatnonzero(fresh)
            tails = np.append(heads[1:], len(doc)) - 1
            best: dict[tuple[int, int], tuple] = {}
            for h, t in zip(heads.tolist(), tails.tolist()):
                item_id, item = self.items[part[h]]
                enough = least_score(len(item), least) - 1e-9
                pad = len(item) // 4 + 4
                origin, beyond = int(words.first[doc[h]]), int(words.first[doc[h] + 1])
                while h <= t:  # a long run of diagonals is aligned in windows of bounded span
                    last = min(t, h - 1 + int(np.searchsorted(diagonal[h : t + 1], diagonal[h] + SPAN, side="right")))
                    low, high = max(origin, int(diagonal[h]) - pad), min(beyond, int(diagonal[last]) + len(item) + pad)
                    long = bool(run[h : last + 1].any())
                    h = last + 1
                    # No alignment has more equal words than the item has words of the passage.
                    if not long and MATCH * np.count_nonzero(np.isin(item, hashes[low:high])) < enough:
                        continue
                    score, same, a, b = align(item, hashes[low:high])
                    similarity = score / (MATCH * len(item))
                    if long or score >= enough:
                        found = (item_id, similarity, same, low + a - origin, low + b - origin)
                        key = (int(doc[t]), item_id)
                        best[key] = max(best.get(key, found), found, key=lambda x: (x[1], -x[3]))
            for (d, _), found in sorted(best.items()):
                out[base + d].append(found)
        return out


def indexes(docs: DataFrame, items: DataFrame, block_bytes: int = 16 << 20) -> Iterator[SeedIndex]:
    """Seed indexes of the items (item_id, text), a bounded block at a time."""
    bounded_batches(docs.sparkSession)
    held, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        if held and size + len(row["text"]) > block_bytes:
            yield SeedIndex.build(held)
            held, size = [], 0
        held.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if held:
        yield SeedIndex.build(held)


def find_leaks(docs: DataFrame, items: DataFrame, least: float = 0.4, **options) -> DataFrame:
    """One row for each (document, item) that aligns: ``doc_id`` and the columns of ``LEAKS``."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], f"doc_id long, {LEAKS}")
    names = ["doc_id", "item_id", "similarity", "matched_words", "first_word", "last_word"]
    for index in indexes(docs, items, **options):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
            for batch in batches:
                found = shared.value.leaks(batch.column(1).to_pylist(), least)
                rows = [(i, *x) for i, own in zip(batch.column(0).to_pylist(), found) for x in own]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(6)], names=names)

        out = out.union(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {LEAKS}"))
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, least: float = 0.4, **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    spark, out = docs.sparkSession, docs
    for index in indexes(docs, items, **options):
        shared = spark.sparkContext.broadcast(index)
        inner = out.select(F.struct(*[F.col(f"`{c}`") for c in out.columns]).alias("_row"))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = shared.value.leaks(batch.column(0).field("text").to_pylist(), least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array([not x for x in found], pa.bool_()))], names=["_row"])

        out = inner.mapInArrow(run, f"_row {inner.schema['_row'].dataType.simpleString()}").select("_row.*")
    return out
