"""Vectorised word hashing over UTF-8 bytes.

A word is ``[^\\x20\\x09-\\x0D]+``. All separators are ASCII, so words can be cut on the
bytes; A-Z is lower-cased on the bytes as well. Hashes are 64-bit: a polynomial over a
random table of byte values, with the word's length mixed in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK = 1 << 21  # bytes worked on at once; a word longer than this is taken whole
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_SEP = np.zeros(256, dtype=bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_K1, _K2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_POW = np.ones(1, dtype=np.uint64)
_SHINGLE = _rng.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(33))
    x = x * _K1
    x = x ^ (x >> np.uint64(33))
    x = x * _K2
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        size = max(n, 4096)
        p = np.full(size, _BASE, dtype=np.uint64)
        p[0] = 1
        _POW = np.cumprod(p, dtype=np.uint64)
    return _POW


def _pieces(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Cut ``data`` behind a separator into pieces of about CHUNK bytes."""
    at = 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        if end < len(data):
            view = np.frombuffer(data, np.uint8, end - at, at)
            seps = np.flatnonzero(_SEP[view])
            if len(seps):
                end = at + int(seps[-1]) + 1
            else:
                while end < len(data) and not _SEP[data[end]]:
                    end += 1
        yield at, data[at:end]
        at = end


def spans(b: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no separators."""
    edge = np.diff(np.concatenate(([True], sep, [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def hash_spans(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hashes of ``b[start:end]`` for ascending spans that don't overlap; ``table``
    has a random number for each value in ``b``."""
    if not len(starts):
        return np.empty(0, np.uint64)
    n = ends - starts
    index = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    value = table[b[index + np.repeat(starts, n)]] * _powers(int(n.max()))[index]
    h = np.add.reduceat(value, np.cumsum(n) - n)
    return mix64(h + n.astype(np.uint64) * np.uint64(_BASE))


def word_hashes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``docs`` in order, and for each text the index of its first word
    (with the number of all words behind the last)."""
    joined = b"\n".join(docs).lower()
    lengths = np.fromiter((len(d) + 1 for d in docs), np.int64, len(docs))
    doc_at = np.concatenate(([0], np.cumsum(lengths)))
    hashes, starts = [], []
    for at, piece in _pieces(joined):
        b = np.frombuffer(piece, np.uint8)
        s, e = spans(b, _SEP[b])
        hashes.append(hash_spans(b, s, e))
        starts.append(s + at)
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(docs) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), doc_at)


def shingle_sets(docs: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingles (64-bit) of each text: of ``width`` words, or the whole
    sequence where a text has fewer; none where it has no word."""
    words, at = word_hashes(docs)
    n = len(words) - width + 1
    full = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        full += words[k : k + len(full)] * _SHINGLE[k]
    full = mix64(full + np.uint64(width))
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        if e - s >= width:
            out.append(np.unique(full[s : e - width + 1]))
        elif e > s:
            short = (words[s:e] * _SHINGLE[: e - s]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix64(short + np.uint64(e - s)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def batches(docs: Iterable[bytes | None], most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) with about ``most`` bytes each; null is empty."""
    own: list[bytes] = []
    first = size = i = -1
    for i, d in enumerate(docs):
        if not own:
            first, size = i, 0
        own.append(d or b"")
        size += len(own[-1])
        if size >= most:
            yield first, own
            own = []
    if own:
        yield first, own
