"""64-bit hashes of the words of many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

#: Longer words, in bytes, are hashed one by one.
_LONG = 512
_KEY = b"tabvet words"
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (fixed constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(name: str, base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        have = _POWERS[name] = np.multiply.accumulate(p)
    return have[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` in a row, and the end of each text's run.

    Words are taken eight bytes at a time, all words at once; each step mixes the hash so far
    with the next eight bytes and is one to one in both, so words of up to eight bytes never
    share a hash with another of their length.  Longer words than _LONG get a keyed BLAKE2 hash.
    """
    if not texts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    raw = b" " + b" ".join(texts) + b" " * 9
    data = np.frombuffer(raw, np.uint8)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    length = ends - starts
    eights = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    hashes = mix(length.astype(np.uint64) + np.uint64(0xA0761D6478BD642F))
    row, at = np.flatnonzero(length <= _LONG), 0
    while len(row):
        left = length[row] - at
        kept = np.uint64(2**64 - 1) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64))
        h = hashes[row]
        hashes[row] = mix(((h << np.uint64(5)) | (h >> np.uint64(59))) ^ (eights[starts[row] + at] & kept))
        row, at = row[left > 8], at + 8
    for i in np.flatnonzero(length > _LONG).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8, key=_KEY).digest(), "little")
    limits = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, limits)
