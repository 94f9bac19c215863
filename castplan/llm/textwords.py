"""Words and word hashes of whole batches of texts, by numpy over the UTF-8 bytes.

A word is a maximal run of word bytes; every byte of a multi-byte character is a word byte, so
byte classes give the same words as the character classes of the contracts.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict = {}


def byte_table(separators, lower: bool = True):
    """(is word byte, lower-cased byte) for the 256 byte values; only A-Z are lower-cased."""
    word = np.ones(256, bool)
    word[list(separators)] = False
    low = np.arange(256, dtype=np.uint8)
    if lower:
        low[65:91] += 32
    return word, low


#: Separators: space and the five ASCII controls 9-13.
SPACE_WORDS = byte_table([32, *range(9, 14)])
#: Separators: every ASCII byte that isn't a digit or a letter.
ALNUM_WORDS = byte_table([b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a piece: powers are kept for the places of one piece and for the pieces' first places.
_PIECE = 1 << 18


def _powers():
    if not _POWERS:
        steps, back = np.full(_PIECE, _BASE), np.full(_PIECE, _BASE_INV)
        steps[0] = back[0] = 1
        _POWERS.update(up=np.cumprod(steps, dtype=np.uint64), down=np.cumprod(back, dtype=np.uint64))
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * base^position, modulo 2^64; ``span_hash`` reads any span from them.

    A long text is summed up piece by piece, so it takes 8 bytes a byte and no tables of its length.
    """
    up, _ = _powers()
    out = np.zeros(len(data) + 1, np.uint64)
    for k, lo in enumerate(range(0, len(data), _PIECE)):
        part = data[lo:lo + _PIECE].astype(np.uint64) + np.uint64(1)
        part *= up[:len(part)]
        if k:
            part *= np.uint64(pow(int(_BASE), lo, 1 << 64))
            part[:1] += out[lo:lo + 1]
        np.cumsum(part, out=out[lo + 1:lo + 1 + len(part)])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    _, down = _powers()
    raw = prefix[end] - prefix[start]
    if len(prefix) <= _PIECE:
        raw = raw * down[start]
    else:
        pieces = np.array([pow(int(_BASE_INV), k * _PIECE, 1 << 64) for k in range(len(prefix) // _PIECE + 1)], np.uint64)
        raw = raw * down[start % _PIECE] * pieces[start // _PIECE]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, table):
    """``(starts, ends, first)``: byte spans of all words, and each text's first word index."""
    is_word = table[0][data]
    before = np.empty_like(is_word)
    after = np.empty_like(is_word)
    if len(data):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = is_word[:-1], is_word[1:]
        cuts = offsets[1:-1]
        before[cuts[cuts < len(data)]] = False
        after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, table):
    """``(hashes, starts, ends, first)`` of all words, lower-cased as the table says."""
    starts, ends, first = words(data, offsets, table)
    return span_hash(prefix_hash(table[1][data]), starts, ends), starts, ends, first


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words (runs across texts included)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[j:len(hashes) - n + 1 + j]
    return mix(total)
