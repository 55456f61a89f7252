"""Vectorised tokenising and hashing of whole texts, shared by the Python-side operators.

Word classes are tables over UTF-8 bytes: the separators of every contract are ASCII, so a
byte table splits exactly as the contract's code-point class does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

#: A-Z to a-z and nothing else.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: Words ``[^\\x20\\x09-\\x0D]+``.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of text whose A-Z are lower-cased.
PLAIN = np.zeros(256, dtype=bool)
PLAIN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BLOCK = 1 << 18


@dataclass
class Words:
    """Words of several texts in one buffer; ``doc`` is the index of the text of each word."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    #: First word of each text, and one past the last text's words.
    first: np.ndarray

    def text(self, i: int) -> str:
        return self.buf[self.start[i] : self.end[i]].tobytes().decode("utf-8", "surrogatepass")


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def tokenize(texts: list[bytes], table: np.ndarray) -> Words:
    """Words of already encoded (and lower-cased, if wanted) texts."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    inside = table[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2].astype(np.int64), edge[1::2].astype(np.int64)
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=bounds[1:])
    first = np.searchsorted(start, bounds)
    return Words(buf, start, end, np.repeat(np.arange(len(texts)), np.diff(first)), first)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    have = _kept.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _BLOCK + 4096), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * _BLOCK:
            _kept[base] = have
    return have[:n]


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands.

    Rolling polynomial sums over blocks that begin at a word, so memory follows the block
    and not the text.
    """
    out = np.empty(len(words.start), dtype=np.uint64)
    i = 0
    while i < len(out):
        at = words.start[i]
        j = max(i + 1, int(np.searchsorted(words.end, at + _BLOCK, side="right")))
        n = int(words.end[j - 1] - at)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((words.buf[at : at + n].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
        s, e = words.start[i:j] - at, words.end[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * _powers(_BASE_INV, n + 1)[s]
        i = j
    return mix(out)


def gram_hashes(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a text, and the index of each run's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = out * _STEP + hashes[j : j + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(out[at]), at


def slices(texts: Iterable[bytes], most: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``most`` bytes with the index of the first; a longer text is alone."""
    at, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if held and size + len(text) > most:
            yield at, held
            at, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield at, held


def bounded_batches(spark) -> None:
    """Let Arrow batches hold few enough rows and bytes that long texts fit a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
