"""Vectorised hashing of words and word shingles over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

from .blobs import distinct

#: Positions in a word that have a multiplier of their own; later ones take them again with another table of bytes.
_LONG = 64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1 << 62, dtype=np.uint64) | np.uint64(1)
_OF_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_AT = _rng.integers(0, 1 << 63, _LONG, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_WINDOW = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) << np.uint64(1) | np.uint64(1)

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of white space, and bytes that are no part of a word of letters.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: As LOWER, with white space as blanks.
PLAIN = bytes(0x20 if SPACE[b] else LOWER[b] for b in range(256))
#: The first k of eight letters.
_LETTERS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Characters of texts whose words are hashed at once: each takes some 15 bytes meanwhile, which a core's cache should hold.
CHARACTERS = 100_000
NO_LETTER = np.array([not (97 <= b <= 122 or 65 <= b <= 90 or b >= 0x80) for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a batch of texts: ``hashes``, and word ``offsets`` by text (one more than texts)."""

    def __init__(self, texts: list[bytes], stop: np.ndarray = SPACE, prefix: int = 0):
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        ends_of_texts = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        gap = stop[data]
        inside = ~gap
        first = np.flatnonzero(inside & np.concatenate(([True], gap[:-1])))
        self.first, self.ends = first, np.flatnonzero(inside & np.concatenate((gap[1:], [True]))) + 1
        self.data = data
        self.offsets = np.concatenate(([0], np.searchsorted(first, ends_of_texts))).astype(np.int64)
        if not len(first):
            self.hashes = self.prefixes = np.zeros(0, np.uint64)
            return
        size = self.ends - first
        letters = data[inside]
        begin = np.cumsum(size) - size
        at = np.arange(len(letters), dtype=np.int64) - np.repeat(begin, size)
        value = _OF_BYTE[letters]
        far = at >= _LONG
        if far.any():  # every stretch of _LONG bytes multiplies by another power
            value[far] = mix(value[far] + (at[far] // _LONG).astype(np.uint64) * _BYTE)
            at = at % _LONG
        value = value * _AT[at]
        self.hashes = mix(np.add.reduceat(value, begin) + size.astype(np.uint64) * _BYTE)
        if prefix:
            self.prefixes = mix(np.add.reduceat(np.where(at < prefix, value, np.uint64(0)), begin) + np.minimum(size, prefix).astype(np.uint64))


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words; of a shorter text its whole sequence; none without words."""
    out: list[np.ndarray] = []
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHARACTERS:
            out += _shingle_sets(texts[first : i + 1], width)
            first, size = i + 1, 0
    return out + _shingle_sets(texts[first:], width) if first < len(texts) else out


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts without other white space than blanks, and word offsets by text; eight letters of a word at once."""
    joined = b"".join((b" ", b" ".join(texts), b" ", bytes(7)))
    gap = np.frombuffer(joined, np.uint8, len(joined) - 7) == 0x20
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    first, size = edges[::2], edges[1::2] - edges[::2]
    ends_of_texts = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    offsets = np.concatenate(([0], np.searchsorted(first, ends_of_texts, "right")))
    eights = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))  # from every place on
    hashes = mix(size.astype(np.uint64) * _BYTE ^ eights[first] & _LETTERS[np.minimum(size, 8)])
    for k in range(8, _LONG, 8):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        hashes[more] = mix(hashes[more] * _AT[0] ^ eights[first[more] + k] & _LETTERS[np.minimum(size[more] - k, 8)])
    if len(far := np.flatnonzero(size > _LONG)):
        hashes[far] = Words([b" ".join(joined[a : a + n] for a, n in zip(first[far].tolist(), size[far].tolist(), strict=True))]).hashes
    return hashes, offsets


def _shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    h, offsets = _word_hashes([(t or "").encode("utf-8").translate(PLAIN) for t in texts])
    n = len(h)
    out: list[np.ndarray] = []
    long = np.zeros(0, np.uint64)
    if n >= width:
        long = np.zeros(n - width + 1, np.uint64)
        for k in range(width):  # hashes of words are mixed, so that odd multipliers tell their places apart
            long += h[k : n - width + 1 + k] * _WINDOW[k + 8 if k < 8 else k]
        long = mix(long)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        m = b - a
        if m >= width:
            out.append(distinct(long[a : b - width + 1]))
        elif m:
            one = np.uint64(m)
            with np.errstate(over="ignore"):
                for k in range(m):
                    one = mix(np.array([one * _WINDOW[15] + h[a + k]], np.uint64))[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
