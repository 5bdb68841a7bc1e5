"""Word and shingle hashes of many texts at once, over their UTF-8 bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
#: ASCII white space, as the contracts give it.
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = _FOLD[97:123]
#: Text that is hashed at once; longer runs are cut at blanks.
PIECE = 1 << 18
#: Words of more bytes are hashed one by one.
LONG_WORD = 4096
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def span_hash(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, chained over their words of eight bytes; equal for equal bytes wherever they stand."""
    if not len(start):
        return np.empty(0, np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8)
    eight = lambda at, left: windows[at].view(np.uint64).reshape(-1) & _LOW_BYTES[np.minimum(left, 8)]
    h = mix(eight(start, size) + size.astype(np.uint64) * np.uint64(_BASE))
    at = np.nonzero((size > 8) & (size <= LONG_WORD))[0]
    done = 8
    while len(at):
        h[at] = mix((h[at] ^ eight(start[at] + done, size[at] - done)) * np.uint64(_BASE) + np.uint64(done))
        done += 8
        at = at[size[at] > done]
    for k in np.nonzero(size > LONG_WORD)[0]:
        h[k] = int.from_bytes(hashlib.blake2b(raw[start[k] : start[k] + size[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def _pieces(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of ``PIECE`` bytes and what is left of the last word."""
    a, n = 0, len(raw)
    while a < n:
        b = min(a + PIECE, n)
        while b < n and not _BLANK[raw[b]]:
            more = np.nonzero(_BLANK[raw[b : b + PIECE]])[0]
            b = min(b + (int(more[0]) if len(more) else PIECE), n)
        yield a, b
        a = b


def words(raw: np.ndarray, bounds: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space) and where each text's begin."""
    if len(bounds) == 2 and len(raw) > 2 * PIECE:
        hashes = np.concatenate([_words(raw[a:b], np.array([0, b - a]), fold)[0] for a, b in _pieces(raw)])
        return hashes, np.array([0, len(hashes)])
    return _words(raw, bounds, fold)


def _words(raw: np.ndarray, bounds: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    solid = ~_BLANK[raw]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start, end = np.nonzero(begins)[0], np.nonzero(ends)[0] + 1
    return span_hash(_FOLD[raw] if fold else raw, start, end - start), np.searchsorted(start, bounds)


def shingle_sets(hashes: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingles of ``width`` words of each text; fewer words count as one shingle."""
    mult = np.array([pow(_BASE, 3 * k + 2, 1 << 64) for k in range(width)], np.uint64)  # odd
    n = len(hashes)
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        rolled += hashes[k : k + len(rolled)] * mult[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.sum(hashes[a:b] * mult[: b - a], keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(rolled[:0])
    return out
