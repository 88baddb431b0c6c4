"""Word and window hashes of whole Arrow batches, for the operators that compare runs of words.

A batch's texts are one run of bytes. With prefix sums of ``byte * BASE**place`` (modulo 2**64) the sum of any
word is a difference, shifted back by the inverse power; windows of words come from the words' hashes likewise. Nothing is done row by row.

Sums modulo a power of two have known collisions between words of hundreds of letters, whatever the base. Words of more than
``SUMMED`` bytes are therefore hashed one by one with xxHash; such words are rare.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BASE = 0x9E3779B97F4A7C15 | 5
#: Bytes of text that are hashed at a time, unless one text is longer.
BATCH_BYTES = 1_000_000


#: Longest word whose hash is a sum of its bytes.
SUMMED = 128


@dataclass
class Words:
    """The words of a batch in order: hashes, first and last-but-one bytes in ``raw``, and each text's first word (and the end)."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    raw: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, BASE, np.uint64), np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds about ``BATCH_BYTES`` of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // BATCH_BYTES
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
                pa.default_memory_pool().release_unused()  # workers live on and share the executor's memory


def words(texts: pa.Array) -> Words:
    """Words of the texts; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = (raw != 0x20) & ((raw < 0x09) | (raw > 0x0D))
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
    starts[edge] |= inside[edge]
    stops[edge - 1] |= inside[edge - 1]
    begin, end = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    up, down = _powers(len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    hashes = mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(end - begin > SUMMED):
        hashes[i] = xxhash.xxh3_64_intdigest(raw[begin[i] : end[i]].tobytes(), BASE)
    return Words(hashes, begin, end, np.searchsorted(begin, offsets), raw)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on, as far as there are so many; windows across texts are in it too."""
    n = max(len(hashes) - size + 1, 0)
    up, down = _powers(len(hashes))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1], dtype=np.uint64)])
    return mixed((total[size : size + n] - total[:n]) * down[:n])


def in_one_text(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows that lie in one text, and each one's text."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + first[:-1][text], text
