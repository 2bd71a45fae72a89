"""Vectorised word and shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from framelake.llm.shared import M1, M2, M3, mix, wrap

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random 64-bit value for each byte, and an odd base whose powers weigh positions; sums wrap at 2**64.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * M3)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)


def powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] the weighted sum of data[:i]; see span_hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    down = np.full(len(prefix), _INVERSE, np.uint64)
    down[:1] = 1
    return mix((prefix[end] - prefix[start]) * np.multiply.accumulate(down)[start] + (end - start).astype(np.uint64) * M3)


def join_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts one after another, a newline behind each, and where each begins (and the end)."""
    raw = [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in texts]
    begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])]).astype(np.int64)
    return np.frombuffer(b"\n".join([*raw, b""]), np.uint8), begin


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes other than space and \\t to \\r."""
    inside = np.concatenate([[False], ~_SEPARATOR[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the number of words of each text. lower: A-Z only.

    Texts are hashed a few at a time: the sums take dozens of bytes for each byte of text.
    """
    hashes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for a, b in small_batches(texts):
        data, begin = join_bytes(texts[a:b])
        if lower:
            data = _LOWER[data]
        start, end = word_spans(data)
        counts.append(np.diff(np.searchsorted(start, begin)))
        hashes.append(span_hash(prefix_hash(data), start, end))
    return np.concatenate(hashes), np.concatenate(counts)


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows, text by text, and their numbers; a shorter text with a word gives its whole sequence as one."""
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    owner = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n) + first[owner]
    width = np.minimum(counts[owner], k)
    out = width.astype(np.uint64) * M3
    for i in range(k):
        use = i < width
        nxt = words[np.minimum(at + i, max(len(words) - 1, 0))] if len(words) else words[:0]
        out = np.where(use, mix(out * M1 + nxt), out)
    return out, n


def distinct(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each group, groups one after another, and their new numbers."""
    owner = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    ends = np.concatenate([[0], np.cumsum(counts)])
    values = values.copy()
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=len(counts)).astype(np.int64)


def small_batches(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters together; a longer text stands alone."""
    start = size = 0
    for i, x in enumerate(texts):
        n = len(x) if x else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def fold(values: np.ndarray, salt: int) -> np.ndarray:
    return mix(values ^ wrap(salt * int(M2) + int(M1)))
