"""Numbers of many rows in one binary cell, and tasks that go through such cells group by group."""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def trim() -> None:
    """Give freed memory back to the system: what many workers keep for later counts against their executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def distinct(numbers: np.ndarray) -> np.ndarray:
    """The distinct numbers in ascending order; ``numbers`` are sorted in place. ``np.unique`` alone may build a hash table of them."""
    numbers.sort()
    first = np.ones(len(numbers), bool)
    np.not_equal(numbers[1:], numbers[:-1], out=first[1:])
    return numbers[first]


#: So many numbers are turned into bytes at once.
PIECE = 1 << 18


def deflated(rows: Callable[[int, int], np.ndarray], n: int, planes: int) -> bytes:
    """The first byte planes of n rows of 8 bytes, one after another; ``rows`` gives those of a range, so that they are never held all at once."""
    # only runs are looked for: planes are runs of one byte or as good as random
    deflate, out = zlib.compressobj(1, zlib.DEFLATED, zlib.MAX_WBITS, zlib.DEF_MEM_LEVEL + 1, zlib.Z_RLE), []
    whole = rows(0, n) if n <= PIECE else None
    for k in range(planes):
        for a in range(0, n, PIECE):
            piece = rows(a, min(n, a + PIECE)) if whole is None else whole
            out.append(deflate.compress(np.ascontiguousarray(piece.view(np.uint8).reshape(-1, 8)[:, k])))
    return b"".join([*out, deflate.flush()])


def inflated(data: bytes, planes: int) -> np.ndarray:
    """Rows of 8 bytes from their first byte planes."""
    inflate, held = zlib.decompressobj(), []
    while part := inflate.decompress(data if not held else inflate.unconsumed_tail, PIECE):
        held.append(np.frombuffer(part, np.uint8))
    n = sum(map(len, held)) // planes
    rows, at = np.zeros((n, 8), np.uint8), 0
    for part in held:
        while len(part):  # a part may cross planes
            k, i = divmod(at, n)
            own, part = part[: n - i], part[n - i :]
            rows[i : i + len(own), k] = own
            at += len(own)
    return rows


def packed(numbers: np.ndarray) -> bytes:
    """Sorted unsigned numbers as differences, byte planes and deflate."""
    steps = lambda a, b: np.diff(numbers[a:b].astype("<u8", copy=False), prepend=np.uint64(numbers[a - 1] if a else 0))
    return deflated(steps, len(numbers), 8)


def unpacked(data: bytes) -> np.ndarray:
    steps = inflated(data, 8).view("<u8").ravel()
    return np.cumsum(steps, out=steps)


def counts(numbers: np.ndarray) -> bytes:
    """Numbers below 2^40 in any order, most of them small, as byte planes and deflate."""
    return deflated(lambda a, b: np.ascontiguousarray(numbers[a:b].astype("<i8", copy=False)), len(numbers), 5)


def uncounted(data: bytes) -> np.ndarray:
    return inflated(data, 5).view("<i8").ravel()


def floats(numbers: np.ndarray) -> bytes:
    """Numbers with 12 significant bits, as byte planes and deflate."""
    bits = numbers.astype("<f4").view("<u4") + np.uint32(1 << 11) & np.uint32(0xFFFFF000)
    return zlib.compress(np.ascontiguousarray(bits.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unfloats(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<f4").ravel()


def ranges(keys: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """(bucket, slice) of sorted 64-bit keys: equal shares of the key space."""
    least = np.array([-(-(b << 32) // buckets) << 32 for b in range(buckets)], np.uint64)
    ends = [*np.searchsorted(keys, least).tolist(), len(keys)]
    return [(bucket, slice(a, b)) for bucket, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if a < b]


def grouped(batches: Iterator[list[list]], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Neighbouring rows that agree in their first columns, with the rest of their columns."""
    now, held = None, []
    for batch in batches:
        for row in zip(*batch, strict=True):
            if row[:keys] != now and held:
                yield now, held
                held = []
            now = row[:keys]
            held.append(row[keys:])
    if held:
        yield now, held
