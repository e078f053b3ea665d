"""Words of many texts at once, found and hashed over their UTF-8 bytes with numpy.

A word is a maximal run of word bytes inside one text. The two kinds below treat
all bytes of a multi-byte character alike, so runs of bytes are runs of characters.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed together; a longer word is hashed alone.
BLOCK = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Odd factor of the polynomial word hash.
_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values over all places (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blank_separated() -> np.ndarray:
    """Words are runs of bytes other than \\x20 and \\x09 to \\x0D."""
    word = np.ones(256, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    return word


def letters_and_digits() -> np.ndarray:
    """Words are runs of ASCII letters, digits and characters outside ASCII."""
    word = np.zeros(256, bool)
    word[0x30:0x3A] = word[0x41:0x5B] = word[0x61:0x7B] = word[0x80:] = True
    return word


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value per byte, the same for both cases of A-Z; powers of the factor and of its inverse."""
    value = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MULTIPLIER)
    value[0x41:0x5B] = value[0x61:0x7B]
    power = np.full(BLOCK + 1, _BASE, np.uint64)
    power[0] = 1
    inverse = np.full(BLOCK + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    return value, np.multiply.accumulate(power), np.multiply.accumulate(inverse)


@dataclass
class Words:
    """Words of a slice of texts: byte ranges in `data`, 64-bit hashes (A-Z as a-z), first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def owner(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, a: int, b: int) -> bytes:
        """Words a to b with A-Z lower-cased, one space between."""
        return b" ".join(self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(a, b)).lower()


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the array and offsets of its texts in them; a null text is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, is_word: np.ndarray) -> Words:
    data, offsets = string_bytes(texts)
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1 : n + 1] = is_word[data]
    # A word begins at a word byte that follows another byte, or another text; it ends likewise.
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    first = np.searchsorted(starts, offsets)
    return Words(data, starts, ends, _hashes(data, starts, ends), first)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    value, power, inverse = _tables()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + BLOCK, side="right"))
        if j <= i:  # one word longer than a block
            digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes().lower(), digest_size=8).digest()
            out[i] = int.from_bytes(digest, "little")
            i += 1
            continue
        a, b = starts[i], ends[j - 1]
        total = np.empty(b - a + 1, np.uint64)
        total[0] = 0
        np.cumsum(value[data[a:b]] * power[: b - a], out=total[1:])
        x, y = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((total[y] - total[x]) * inverse[x] + (y - x).astype(np.uint64) * _MULTIPLIER)
        i = j
    return out


def shingles(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the `width` words from each word on, and whether they lie within one text."""
    h, n = found.hashes, len(found.hashes)
    if n == 0:
        return h, np.zeros(0, bool)
    last = np.repeat(found.first[1:], np.diff(found.first))
    whole = np.arange(n) + width <= last
    out = np.zeros(n, np.uint64)
    if n >= width:
        m = n - width + 1
        acc = h[:m].copy()
        for k in range(1, width):
            acc = mix(acc * _MULTIPLIER + h[k : k + m])
        out[:m] = acc
    return out, whole
