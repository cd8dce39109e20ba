"""Words and their 64-bit hashes from Arrow text columns, by whole-buffer numpy passes.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r. UTF-8 continuation bytes are never
in that set, so working on bytes equals working on characters.

A word's hash is a polynomial over the field of 2**61 - 1: its length, then its bytes seven at a time, are the
coefficients, and `key` is the point. Two different words of n bytes collide for at most n / 7 + 1 of 2**61 keys.
Each call of an operator draws its key anew, so no text can be made up beforehand to collide. Results never rest on
a hash alone where a contract speaks of words: those are compared themselves (`named`, `joined`).
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
_PRIME = np.uint64((1 << 61) - 1)
_LANE, _MOST_LANES = 7, 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(_LANE + 1)], dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def new_key() -> int:
    """A random point for the hashes of one run; the driver draws it and tasks get it with their function."""
    return secrets.randbelow((1 << 61) - (1 << 32)) + (1 << 31)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that is a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def times(a: np.ndarray, key: int) -> np.ndarray:
    """a * key modulo 2**61 - 1, for a below the prime."""
    low, high = np.uint64(key & (1 << 31) - 1), np.uint64(key >> 31)
    a_low, a_high = a & np.uint64((1 << 31) - 1), a >> np.uint64(31)
    middle = a_low * high + a_high * low
    total = a_high * high * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a_low * low
    total = (total >> np.uint64(61)) + (total & _PRIME)
    return np.where(total >= _PRIME, total - _PRIME, total)


def powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown, while small."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES // 2)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if size <= 2 * CHUNK_BYTES:
            _powers[name] = have
    return have[:n]


@dataclass
class Words:
    """The words of some consecutive texts. first[i]:first[i + 1] are the words of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def hashes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int) -> np.ndarray:
    """The hash of each word data[start:end]."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    size = end - start
    out = times((size + 1).astype(np.uint64), key) + (eight[start] & _BYTES[np.minimum(size, _LANE)])
    out = np.where(out >= _PRIME, out - _PRIME, out)
    left = np.flatnonzero(size > _LANE)
    for lane in range(1, _MOST_LANES):
        if not len(left):
            break
        rest = size[left] - lane * _LANE
        x = times(out[left], key) + (eight[start[left] + lane * _LANE] & _BYTES[np.minimum(rest, _LANE)])
        out[left] = np.where(x >= _PRIME, x - _PRIME, x)
        left = left[rest > _LANE]
    for i in left.tolist():  # words of hundreds of bytes, one by one
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
    return mix(out)


def same(words: Words, other: np.ndarray) -> bool:
    """Whether each word i has the same bytes as word other[i]."""
    size = words.end - words.start
    if not np.array_equal(size, size[other]):
        return False
    padded = np.concatenate([words.data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(words.data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    left = np.flatnonzero(other != np.arange(len(size)))
    lane = 0
    while len(left) and lane < _MOST_LANES:
        mask = _BYTES[np.minimum(size[left] - lane * _LANE, _LANE)]
        if ((eight[words.start[left] + lane * _LANE] ^ eight[words.start[other[left]] + lane * _LANE]) & mask).any():
            return False
        lane += 1
        left = left[size[left] > lane * _LANE]
    return all(words.data[words.start[i] : words.end[i]].tobytes() == words.data[words.start[j] : words.end[j]].tobytes() for i, j in zip(left.tolist(), other[left].tolist(), strict=True))


def split(data: np.ndarray, bounds: np.ndarray, lower: bool, key: int | None) -> Words:
    """data: bytes of the texts, one after another; bounds: where each begins, and the end. Without a key there are no hashes."""
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.zeros(0, dtype=np.uint64) if key is None else hashes_of(data, start, end, key)
    return Words(data, start, end, np.searchsorted(start, bounds), hashes)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and bounds of a string or binary column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]] if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    return data, bounds - bounds[0]


def chunks(bounds: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about `most` bytes; a longer row stands alone."""
    row, n = 0, len(bounds) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + (most or CHUNK_BYTES), "right")) - 1)
        yield row, to
        row = to


def words_of(column: pa.Array, lower: bool, key: int | None) -> Iterator[tuple[int, int, Words]]:
    """(row, to, words of rows row:to) of a text column."""
    data, bounds = buffers(column)
    for row, to in chunks(bounds):
        part = bounds[row : to + 1]
        yield row, to, split(data[part[0] : part[-1]], part - part[0], lower, key)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words; entry i covers words i .. i + k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    if k <= 16:
        for j in range(k):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += hashes[j : j + n]
        return mix(out)
    at = np.arange(n)
    return span_hash(hashes, at, at + k)


def span_hash(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words start:end, for each of many spans of one hash array."""
    run = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers("up", _ODD, len(hashes)), out=run[1:])
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    return mix((run[end] - run[start]) * powers("down", inverse, len(hashes) + 1)[start] + (end - start).astype(np.uint64))


def joined(raw: bytes) -> bytes:
    """A text's words with one space between them. bytes.split cuts at the same six bytes."""
    return b" ".join(raw.split())


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def named(texts: list[list[bytes]], k: int) -> list[np.ndarray]:
    """The set of k-word shingles of each text (given as words) as sorted integers, equal where the words are equal.

    Words get numbers, then neighbours are numbered together step by step; no number stands for two things, so sets of
    these texts can be compared with each other exactly. A text of fewer words has one shingle, all of them.
    """
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), dtype=np.int64, count=sum(map(len, texts)))
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    n_words = max(len(number), 1)
    names, most = flat, n_words
    for j in range(1, k):
        if most > (1 << 62) // n_words:
            kinds, names = np.unique(names, return_inverse=True)
            most = len(kinds)
        m = max(len(flat) - j, 0)
        names, most = names[:m] * n_words + flat[j : j + m], most * n_words
    out, short = [], {}
    for t, a, b in zip(texts, first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(names[a : b - k + 1]))
        elif b > a:  # below zero, apart from the names of whole shingles
            out.append(np.array([-1 - short.setdefault(tuple(t), len(short))]))
        else:
            out.append(np.zeros(0, dtype=np.int64))
    return out
