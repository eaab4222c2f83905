"""Word shingles of texts as 64-bit hashes, computed for whole Arrow batches at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
#: A random value for every byte; A-Z share the values of a-z.
_VALUE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def by_bytes(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes in a text column; a longer text is a slice of its own."""
    texts = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2 ... modulo 2 ** 64."""
    factors = np.full(n, base, dtype=np.uint64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many each text has; a word is a run of bytes that are no white space.

    A word's hash sums a scattered value of each byte at its place, mixed with its length: no algebra joins the places, so that
    words cannot be written that collide, as they can for a polynomial modulo a power of two.
    """
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    inside = ~_SPACE[data]
    # A text's first byte starts a word even where the text before it ended inside one.
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.concatenate(([False], inside[:-1]))[: len(data)]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate((inside[1:], [False]))[: len(data)]
    stops = np.flatnonzero(inside & (~after | cut[1:])) + 1
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets) - 1, dtype=np.int64)
    lengths = stops - starts
    letters = data[inside]
    heads = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(heads, lengths)
    sums = np.add.reduceat(mixed(_VALUE[letters] ^ (place.astype(np.uint64) * np.uint64(_BASE))), heads)
    counts = np.diff(np.searchsorted(starts, offsets))
    return mixed(sums + lengths.astype(np.uint64) * np.uint64(_STEP)), counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its five-word shingles.

    A text of fewer words has the whole sequence as its one shingle; a text without words has none.
    """
    words, counts = word_hashes(data, offsets)
    weights = powers(_STEP, WORDS)
    chain = np.zeros(max(len(words) - WORDS + 1, 0), dtype=np.uint64)
    for k in range(WORDS):
        chain += words[k : k + len(chain)] * weights[k]
    chain = mixed(chain)
    sets, at = [], 0
    for n in counts.tolist():
        if n >= WORDS:
            one = np.sort(chain[at : at + n - WORDS + 1])
            sets.append(one[np.concatenate(([True], one[1:] != one[:-1]))])
        elif n:
            sets.append(mixed((words[at : at + n] * weights[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
        else:
            sets.append(words[:0])
        at += n
    return sets
