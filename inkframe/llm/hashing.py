"""Word and window hashes of whole Arrow batches, by prefix polynomials modulo 2^64.

A batch's texts lie one after the other in one buffer. With P[i] the sum of v(byte j) * B^j for j < i, the
hash of any byte range [a, b) is (P[b] - P[a]) * B^-a: one pass gives the hashes of all words or windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 5)  # odd, so that it has an inverse modulo 2^64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: A value for each byte, from a fixed seed.
VALUES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Texts are taken in parts of about this many bytes.
PART = 2_000_000

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i for i < n."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, PART * 5 // 4)
        for name, x in (("up", BASE), ("down", INVERSE)):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all bits."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def prefix_hashes(buffer: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """P, one longer than the buffer."""
    out = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(values[buffer] * powers(len(buffer))[0], out=out[1:])
    return out


def parts(ids: pa.Array, texts: pa.Array, limit: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions of the rows, bytes, offsets) of runs of rows of about limit bytes; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_binary()) if texts.null_count else texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield np.arange(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(buffer: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word (a run of bytes that is_word holds for), and the number of the first word of each text.
    A long text is taken in parts that end between words."""
    if len(offsets) != 2 or len(buffer) <= 3 * PART:
        return _words(buffer, offsets, is_word, values)
    found, at = [], 0
    while at < len(buffer):
        to, gap = at + PART, np.empty(0, np.int64)
        while to < len(buffer) and not len(gap := np.flatnonzero(~is_word[buffer[to : to + PART]])):
            to += PART
        to = to + int(gap[0]) if len(gap) else len(buffer)
        h, starts, ends, _ = _words(buffer[at:to], np.array([0, to - at]), is_word, values)
        found.append((h, starts + at, ends + at))
        at = to
    h, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    return h, starts, ends, np.array([0, len(h)])


def _words(buffer: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    inside = is_word[buffer]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(buffer))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    p = prefix_hashes(buffer, values)
    hashes = mix((p[ends] - p[starts]) * powers(len(buffer) + 1)[1][starts])
    return hashes, starts, ends, np.searchsorted(starts, offsets)
