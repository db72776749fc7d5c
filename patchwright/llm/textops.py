"""Words of whole Arrow batches as 64-bit hashes, by NumPy over the UTF-8 bytes.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased: every byte of a
non-ASCII character is a word byte, so bytes decide it exactly. Work goes by blocks of texts of
about BLOCK bytes, so memory follows the block (or one longer text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 400_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE = _VALUE[_LOWER]
_IS_WORD = _WORD[_LOWER]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, step in enumerate((_STEP, _BACK)):
            p = np.full(n, step, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def _runs(b: np.ndarray, off: np.ndarray, kind: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, last byte, hash) of the longest runs of one kind above 0 inside the texts b[off[i]:off[i + 1]]."""
    first, last = kind > 0, kind > 0
    same = kind[1:] == kind[:-1]
    first[1:] &= ~same
    last[:-1] &= ~same
    full = np.diff(off) > 0
    first[off[:-1][full]] = kind[off[:-1][full]] > 0
    last[off[1:][full] - 1] = kind[off[1:][full] - 1] > 0
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    power, back = _power(len(b))
    total = np.cumsum(value[b] * power)
    before = np.where(s > 0, total[np.maximum(s - 1, 0)], np.uint64(0))
    return s, e, mix((total[e] - before) * back[s] + (e - s).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end) for the texts data[offsets[i]:offsets[i + 1]]."""
    lo = int(offsets[0])
    b, off = data[lo : int(offsets[-1])], offsets - lo
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    s, _, h = _runs(b, off, _IS_WORD[b].astype(np.uint8), _VALUE)
    return h, np.searchsorted(s, off)


#: Kinds of bytes for tokens: blanks part them; words; marks; line breaks.
_TOKEN_KIND = np.where(_IS_WORD, 1, 2).astype(np.uint8)
_TOKEN_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 0
_TOKEN_KIND[0x0A] = 3
_RAW_VALUE = np.random.default_rng(20240301).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for tokens as they are written: words, runs of marks, runs of line breaks."""
    lo = int(offsets[0])
    b, off = data[lo : int(offsets[-1])], offsets - lo
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    s, _, h = _runs(b, off, _TOKEN_KIND[b], _RAW_VALUE)
    return h, np.searchsorted(s, off)


def blocks(texts: pa.Array, hashes=word_hashes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, hashes, bounds): the words (or tokens) of texts i to j; text i + k has hashes[bounds[k]:bounds[k + 1]]."""
    data, offsets = utf8(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1))
        yield i, j, *hashes(data, offsets[i : j + 1])
        i = j


_ODD = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(h: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of all runs of `size` words inside each text; a text of fewer words, but not none, is one run."""
    counts = np.diff(bounds)
    out_counts = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(out_counts)]).astype(np.int64)
    if not len(h):
        return np.zeros(0, np.uint64), out_bounds
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    run = padded[: len(h)] * _ODD[0]
    for k in range(1, size):
        run = run + padded[k : k + len(h)] * _ODD[k]
    starts = np.arange(out_bounds[-1]) + np.repeat(bounds[:-1] - out_bounds[:-1], out_counts)
    run = run[starts]
    for i in np.flatnonzero((counts > 0) & (counts < size)):  # short texts: the run ends with the text
        w = h[bounds[i] : bounds[i + 1]]
        run[out_bounds[i]] = (w * _ODD[: len(w)] + np.uint64(1)).sum(dtype=np.uint64)
    return mix(run), out_bounds
