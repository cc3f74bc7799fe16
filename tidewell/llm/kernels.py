"""Vectorised text kernels over Arrow string arrays: words, word hashes, shingles, character n-grams.

All texts of a slice lie in one byte buffer, each followed by a line feed. Hashes are polynomial over a random 64-bit
value for each byte, modulo 2**64, then mixed; equal words have equal hashes in every task and run.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RNG = np.random.default_rng(718281828)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = _RNG.integers(1, 2**64, 8, dtype=np.uint64) | U(1)
_GRAM = _RNG.integers(1, 2**32, (6, 256), dtype=np.uint32)

#: Bytes by class: A-Z to a-z, white space of [\x20\x09-\x0D], and what ends a word of letters, digits and non-ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
BREAK = np.ones(256, dtype=bool)
BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def plain(data: np.ndarray) -> np.ndarray:
    """The bytes with a space in place of every byte of non-ASCII punctuation: of U+00A0 to U+00BF but for letters, of
    U+2000 to U+206F and of U+3000 to U+303F."""
    out = data.copy()
    for lead, width in ((0xC2, 2), (0xE2, 3), (0xE3, 3)):
        at = np.flatnonzero(data[: len(data) - width + 1] == lead)
        follow = data[at + 1]
        if lead == 0xC2:
            at = at[(follow >= 0xA0) & ~np.isin(follow, (0xAA, 0xB5, 0xBA))]
        elif lead == 0xE2:
            at = at[(follow == 0x80) | ((follow == 0x81) & (data[at + 2] <= 0xAF))]
        else:
            at = at[follow == 0x80]
        for k in range(width):
            out[at + k] = 32
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Bytes whose powers are at hand; longer stretches are hashed block by block.
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up = np.full(BLOCK, _BASE, dtype=np.uint64)
    down = np.full(BLOCK, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, a line feed after each, and where each text ends (its line feed); null is empty."""
    kind = pa.large_string()
    texts = pc.binary_join_element_wise(texts.cast(kind).fill_null(""), pa.scalar("", kind), pa.scalar("\n", kind))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0] - 1


def words(data: np.ndarray, ends: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word. A line feed must be a break."""
    gap = breaks[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edge = np.concatenate(([0], edge))
    starts, stops = edge[::2], edge[1::2]
    return starts, stops, np.searchsorted(ends, starts, side="left")


def _sums(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Polynomial of each word, all of them within ``BLOCK`` bytes of ``data``."""
    up, down = _powers()
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return (total[stops] - total[starts]) * down[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hash of each word's bytes. However long the text or a word, the tables of powers stay those of a block."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        first = int(starts[i])
        j = int(np.searchsorted(stops, first + BLOCK, side="right"))
        if j > i:
            part = data[first : int(stops[j - 1])]
            out[i:j] = _sums(part, starts[i:j] - first, stops[i:j] - first)
        else:  # a word longer than a block
            j, value, step = i + 1, 0, pow(_BASE, BLOCK, 1 << 64)
            for k, at in enumerate(range(first, int(stops[i]), BLOCK)):
                part = data[at : min(at + BLOCK, int(stops[i]))]
                value += int(_sums(part, np.array([0]), np.array([len(part)]))[0]) * pow(step, k, 1 << 64)
            out[i] = value % 2**64
        i = j
    return mix(out + (stops - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, and where each text's begin (n_docs + 1 offsets).

    A text of fewer words than ``size`` has the whole sequence as its one shingle; one without words has none.
    """
    counts = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(counts)))
    out, sizes = [], np.zeros(n_docs, dtype=np.int64)
    if len(hashes) >= size:
        acc = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
        for k in range(size):
            acc += hashes[k : len(hashes) - size + 1 + k] * _STEP[k]
        acc = mix(acc)
    for i in range(n_docs):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= size:
            got = np.unique(acc[a : b - size + 1])
        elif b > a:
            salt = U((b - a) * 0xA0761D6478BD642F % 2**64)
            got = mix((hashes[a:b] * _STEP[: b - a]).sum(dtype=np.uint64, keepdims=True) + salt)
        else:
            continue
        out.append(got)
        sizes[i] = len(got)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def grams(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hash and text number of every character n-gram (over bytes) inside a word, its borders counting as one
    character each."""
    if len(data) < size:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    gap = SPACE[data]
    text = np.where(gap, np.uint8(32), data)
    n = len(text) - size + 1
    acc, inner = _GRAM[0][text[:n]].copy(), np.zeros(n, dtype=bool)
    for k in range(1, size):
        acc += _GRAM[k][text[k : k + n]]
        if k < size - 1:
            inner |= gap[k : k + n]
    at = np.flatnonzero(~inner)
    h = acc[at] * np.uint32(2654435761)
    return h ^ (h >> np.uint32(15)), np.searchsorted(ends, at + 1, side="left")
