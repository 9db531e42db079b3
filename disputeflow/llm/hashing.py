"""Words and window hashes of one text as numpy arrays, for use inside Spark tasks.

A text is walked in pieces, so that the Python objects of its words never exist all at
once; what remains of a text is eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import xxhash

PIECE = 1 << 20
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
SPACES = b" \t\n\x0b\x0c\r"


def pieces(raw: bytes, breaks: bytes = SPACES) -> Iterator[bytes]:
    """``raw`` in pieces of about PIECE bytes, each ending before one of ``breaks``."""
    start = 0
    while len(raw) - start > PIECE:
        end = start + PIECE
        while end < len(raw) and raw[end] not in breaks:
            end += 1
        yield raw[start:end]
        start = end
    yield raw[start:] if start else raw


def word_hashes(raw: bytes, words: Callable[[bytes], list[bytes]] = bytes.split) -> np.ndarray:
    """The 64-bit hash of every word of ``raw``, in order."""
    packed = [b"".join(map(xxhash.xxh3_64_digest, words(piece))) for piece in pieces(raw)]
    return np.frombuffer(packed[0] if len(packed) == 1 else b"".join(packed), np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_SOME = {b: (powers(b, 4096), powers(pow(b, -1, 1 << 64), 4096)) for b in BASES}


def window_hashes(words: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of each window of ``width`` words, from prefix sums modulo 2**64.

    The sum from i to i + width of word * base**position, times base**-i, depends on the
    words of the window alone.
    """
    size = len(words)
    n = size - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _SOME[base]
    if size > len(up):
        up, down = powers(base, size), powers(pow(base, -1, 1 << 64), size)
    sums = np.empty(size + 1, np.uint64)
    sums[0] = 0
    np.cumsum(words * up[:size], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * down[:n] + np.uint64(width))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of ``width``-word shingles, ascending; a shorter text is one shingle."""
    if not len(words):
        return words
    found = np.sort(window_hashes(words, min(width, len(words))))
    return found[np.concatenate(([True], found[1:] != found[:-1]))]
