"""Words of whole Arrow columns as 64-bit codes, without a Python object for each word.

A word's code is a polynomial of its bytes over random values, modulo 2^64, mixed
with its length. Running sums of a stretch of text give all its words' polynomials
at once: the sum between a word's ends, times the inverse of the power at its
beginning. Long texts are taken in stretches that end between words, so memory
follows the longest word, not the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

STRETCH = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Alphabet:
    """Which bytes separate words, and the values of the others; A-Z count as a-z."""

    def __init__(self, separators: bytes):
        lower = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64)
        self.value = mix(lower + np.uint64(1))
        self.separates = np.zeros(256, bool)
        self.separates[list(separators)] = True


#: Words are runs of anything but ASCII white space.
SPACED = Alphabet(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words are runs of ASCII letters and digits and of all bytes from 0x80 on.
LETTERS = Alphabet(bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122)))

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STRETCH)
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        if n > STRETCH:
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, where each text ends) of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32, n + 1, offset=column.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def coded(column: pa.Array, alphabet: Alphabet = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all words one after another, where each text's words end)."""
    data, ends = bytes_of(column)
    total = len(data)
    edge = np.unique(np.concatenate([[0], ends]))
    parts, places = [], []
    at = 0
    while at < total:
        size = STRETCH
        while True:
            stop = min(total, at + size)
            here = data[at:stop]
            apart = alphabet.separates[here]
            if stop == total:
                break
            gaps = np.flatnonzero(apart[-65536:]) if size == STRETCH else np.flatnonzero(apart)
            last = at + len(here) - min(len(here), 65536 if size == STRETCH else len(here)) + int(gaps[-1]) + 1 if len(gaps) else at
            doc = edge[np.searchsorted(edge, stop, side="right") - 1]
            cut = max(last, int(doc))
            if cut > at:
                stop = cut
                here, apart = here[: stop - at], apart[: stop - at]
                break
            size *= 2
        n = len(here)
        border = edge[np.searchsorted(edge, at) : np.searchsorted(edge, stop, side="right")] - at
        opens, closes = ~apart, ~apart
        opens[1:] &= apart[:-1]
        closes[:-1] &= apart[1:]
        inner = border[border < n]
        opens[inner] = ~apart[inner]
        ended = border[border > 0] - 1
        closes[ended] = ~apart[ended]
        begin, end = np.flatnonzero(opens), np.flatnonzero(closes)
        power, inverse = _power_tables(n)
        sums = np.cumsum(alphabet.value[here] * power[:n], dtype=np.uint64)
        before = np.where(begin > 0, sums[np.maximum(begin, 1) - 1], np.uint64(0))
        code = (sums[end] - before) * inverse[begin]
        parts.append(mix(code + (end - begin + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        places.append(begin + at)
        at = stop
    codes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    begin = np.concatenate(places) if places else np.zeros(0, np.int64)
    return codes, np.searchsorted(begin, ends, side="left")


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of ``sizes`` from ``starts``, one after another."""
    sizes = np.asarray(sizes, np.int64)
    return np.repeat(np.asarray(starts, np.int64) - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
