"""Words of Arrow text columns as 64-bit hashes, computed over whole buffers with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, so no multi-byte character is cut.
Prefix sums of byte * P^i (mod 2^64) give the polynomial hash of any byte range as one difference;
a bijective finaliser then spreads it over all bits. Work goes in pieces that end between words, so
memory does not depend on the length of a text.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_P = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    up = _powers(_P, PIECE + 1)
    down = _powers(pow(_P, -1, 1 << 64), PIECE + 1)

    @classmethod
    def of(cls, n: int):
        if n > len(cls.up):
            return _powers(_P, n), _powers(pow(_P, -1, 1 << 64), n)
        return cls.up, cls.down


@dataclass
class Words:
    """``first[d]:first[d + 1]`` are the words of text d; byte ranges refer to ``data``."""

    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n + 1 offsets of its texts; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """Ranges of about PIECE bytes that end at a text's end or after white space."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + PIECE)
        if to < n:
            k = np.searchsorted(offsets, to, "right") - 1
            if offsets[k] > at:
                to = int(offsets[k])
            else:  # one text fills the piece: go back to white space, or on to it
                gaps = np.flatnonzero(_SPACE[data[at:to]])
                while not len(gaps) and to < min(n, int(offsets[k + 1])):
                    more = min(n, int(offsets[k + 1]), to + PIECE)
                    gaps = np.flatnonzero(_SPACE[data[to:more]]) + (to - at)
                    to = more
                to = at + int(gaps[-1]) + 1 if len(gaps) else to
        yield at, to
        at = to


def words(texts: pa.Array, lower: bool = False, table: np.ndarray | None = None) -> Words:
    """Words of each text; ``lower`` folds A-Z, ``table`` maps bytes in any other way first."""
    data, offsets = buffers(texts)
    if lower or table is not None:
        data = (_LOWER if table is None else table)[data]
    starts, ends, hashes = [], [], []
    for at, to in _pieces(data, offsets):
        part = data[at:to]
        inner = offsets[np.searchsorted(offsets, at, "right"):np.searchsorted(offsets, to, "left")] - at
        inner = inner[(inner > 0) & (inner < len(part))]
        word = ~_SPACE[part]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _Tables.of(len(part) + 1)
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum((part.astype(_U) + _U(1)) * up[:len(part)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * down[s]))
        starts.append(s + at)
        ends.append(e + at)
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    value = np.concatenate(hashes) if hashes else np.zeros(0, _U)
    return Words(data, np.searchsorted(start, offsets).astype(np.int64), start, end, value)


def sequence_hash(values: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of every k consecutive values, in their order."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, _U(seed))
    for i in range(k):
        out = (out ^ values[i:i + n]) * _U(0xC2B2AE3D27D4EB4F)
        out ^= out >> _U(29)
    return mix(out)
