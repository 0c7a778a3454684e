"""Words of many texts at once: numpy over the UTF-8 bytes, words being runs without ASCII white space."""

from __future__ import annotations

import ctypes
import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_P, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n at least."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]))
        _powers = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)))) for p in (_P, _INVERSE))
    return _powers


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x + np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a word from which it is hashed and compared by itself.
LONG_WORD = 256
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def new_key() -> int:
    """A key for the word hashes of one job, so that nobody can write texts whose words meet."""
    return secrets.randbits(64)


def eights(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros follow the end."""
    padded = np.concatenate((b, np.zeros(8, np.uint8)))
    return np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(b),), strides=(1,))


def hashed_words(raw: bytes | np.ndarray, lower: bool = False, key: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of the bytes.

    A word is taken eight bytes at a time into two states, which scrambles that aren't linear carry on from a key; the
    two are folded at the end. Very long words go through blake2b."""
    b = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gap = (b == 32) | ((b >= 9) & (b <= 13))
    turn = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        turn = np.concatenate(([0], turn))
    if not gap[-1]:
        turn = np.concatenate((turn, [len(b)]))
    starts, ends = turn[::2], turn[1::2]
    if lower:
        b = b + np.uint8(32) * ((b >= 65) & (b <= 90))
    view, sizes = eights(b), ends - starts
    one, two = np.full(len(starts), key, np.uint64), np.full(len(starts), key ^ 0x5851F42D4C957F2D, np.uint64)
    live, at = np.flatnonzero(sizes <= LONG_WORD), 0
    while len(live):
        block = view[starts[live] + at] & _MASKS[np.minimum(sizes[live] - at, 8)]
        one[live] = mix(one[live] ^ block, 71)
        two[live] = mix((two[live] + block) * np.uint64(0x2545F4914F6CDD1D), 73) ^ (one[live] >> np.uint64(32))
        at += 8
        live = live[sizes[live] > at]
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        digest = hashlib.blake2b(b[starts[k] : ends[k]].tobytes(), digest_size=16, key=key.to_bytes(8, "little")).digest()
        one[k], two[k] = np.frombuffer(digest, "<u8")
    return starts, ends, mix(one ^ (two * np.uint64(_P)) ^ sizes.astype(np.uint64))


def equal_words(view: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the words i and j (arrays of numbers) have the same bytes, view being these as `eights` gives them."""
    size = ends[i] - starts[i]
    same = size == ends[j] - starts[j]
    live, at = np.flatnonzero(same & (size <= LONG_WORD)), 0
    while len(live):
        differs = (view[starts[i[live]] + at] ^ view[starts[j[live]] + at]) & _MASKS[np.minimum(size[live] - at, 8)] != 0
        same[live[differs]] = False
        at += 8
        live = live[~differs & (size[live] > at)]
    for k in np.flatnonzero(same & (size > LONG_WORD)).tolist():
        same[k] = np.array_equal(view[starts[i[k]] : ends[i[k]] - 7], view[starts[j[k]] : ends[j[k]] - 7])
    return same


def give_back() -> None:
    """Return freed memory to the system at the end of a task, since a worker lives on while other tasks run beside it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not every C library has it


def blobs(texts: list[str | None], limit: int = 1 << 21) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of whole texts of about `limit` bytes: first, end, their bytes with a newline after each, where each starts."""
    first, parts, size = 0, [], 0
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        parts.append(raw)
        size += len(raw) + 1
        if size >= limit or k + 1 == len(texts):
            offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
            yield first, k + 1, b"\n".join(parts) + b"\n", offsets
            first, parts, size = k + 1, [], 0


def window_hash(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash of each `width` consecutive word hashes (one less for each word that is missing at the end)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, mixed = np.zeros(n, np.uint64), mix(words, seed)
    for k in range(width):
        out = out * np.uint64(_P) + mixed[k : k + n]
    return mix(out, seed + width)
