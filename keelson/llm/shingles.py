"""Word and shingle hashes of many texts at once, with numpy.

A word's hash is a polynomial of random byte values modulo 2^64, finished with a mixing
step; a shingle's hash mixes the polynomial of its words' hashes. Equal words have equal
hashes in every process and on every run.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bytes hashed at a time: bounds the arrays, which take about 40 bytes a byte of text.
CHUNK = 1 << 18
_BASE = np.uint64(0xD1342543DE82EF95)
_STEP = np.uint64(0x9E3779B97F4A7C15)
# fixed values: the constants of the published splitmix64 finaliser
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def randoms(n: int, seed: int) -> np.ndarray:
    """Reproducible 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _STEP)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letters = randoms(256, 1)
    powers = np.cumprod(np.full(CHUNK + 1, _BASE, np.uint64)) * np.uint64(pow(int(_BASE), -1, 1 << 64))
    inverse = np.cumprod(np.full(CHUNK + 1, pow(int(_BASE), -1, 1 << 64), np.uint64)) * _BASE
    return letters, powers, inverse


@lru_cache(maxsize=1)
def _space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


#: A-Z lower-cased; for ``fold_punctuation`` ASCII signs become spaces as well.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)


def hash_words(buffer: np.ndarray, blanks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (never 0), starts and ends of the runs of bytes not in ``blanks``, of at most CHUNK bytes."""
    letters, powers, inverse = _tables()
    blank = blanks[buffer]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(letters[buffer] * powers[: len(buffer)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    hashes[hashes == 0] = 1
    return hashes, starts, ends


def _hash_chunk(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return hash_words(buffer, _space())


def word_hashes(text: bytes, table: bytes = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes) of each word ``[^\\x20\\x09-\\x0D]+`` of the text after ``table``."""
    text = text.translate(table)
    if len(text) <= CHUNK:
        return _hash_chunk(np.frombuffer(text, np.uint8))
    found, at = [], 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        if end < len(text):  # cut at white space; a longer word is hashed in pieces that are then joined
            back = max(text.rfind(s, at, end) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if back >= at:
                end = back + 1
            else:
                return _long_word(text)
        h, s, e = _hash_chunk(np.frombuffer(text[at:end], np.uint8))
        found.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(c) for c in zip(*found))


def _long_word(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with a word of over CHUNK bytes: such a word is hashed from its pieces' digests."""
    import re
    import zlib

    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", text)]
    hashes = np.empty(len(spans), np.uint64)
    for k, (s, e) in enumerate(spans):
        if e - s <= CHUNK:
            hashes[k] = _hash_chunk(np.frombuffer(text[s:e], np.uint8))[0][0]
        else:
            word = text[s:e]
            hashes[k] = mix(np.array([zlib.crc32(word) << 32 | zlib.adler32(word)], np.uint64) + np.uint64(e - s))[0]
    bounds = np.array(spans, np.int64).reshape(-1, 2)
    return hashes, bounds[:, 0], bounds[:, 1]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k words, in order; none when there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, factor in enumerate(randoms(k, 2)):
        total += words[j : j + n] * (factor | np.uint64(1))
    return mix(total + np.uint64(k))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles; the whole sequence as one where there are fewer than k words; empty without words."""
    if len(words) >= k:
        return np.unique(shingle_hashes(words, k))
    return shingle_hashes(words, len(words)) if len(words) else np.zeros(0, np.uint64)


def batch_words(texts: list[bytes], table: bytes = LOWER) -> list[np.ndarray]:
    """Word hashes of each text; short texts are hashed together."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0

    def close() -> None:
        if group:
            # a line feed between texts keeps their words apart
            hashes, starts, _ = _hash_chunk(np.frombuffer(b"\n".join(group).translate(table), np.uint8))
            bounds = np.cumsum([len(t) + 1 for t in group])
            out.extend(np.split(hashes, np.searchsorted(starts, bounds[:-1])))

    for text in texts:
        if held + len(text) + len(group) + 1 > CHUNK:
            close()
            group, held = [], 0
        if len(text) >= CHUNK:
            out.append(word_hashes(text, table)[0])
        else:
            group.append(text)
            held += len(text)
    close()
    return out


class Members:
    """Fast test of many hashes against a sorted set: a bitmap first, then a search of what it lets through."""

    BITS = 20

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.unique(values)
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[(self.values >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def positions(self, hashes: np.ndarray) -> np.ndarray:
        """Indices of those hashes that are members."""
        if not len(self.values):
            return np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.values, hashes[maybe]), len(self.values) - 1)
        return maybe[self.values[at] == hashes[maybe]]
