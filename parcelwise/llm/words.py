"""Words of many texts at once: bounds and 64-bit hashes from UTF-8 bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from parcelwise.llm.shared import byte_view, slices

#: Bytes of text that are worked on at once.
CHUNK = 1 << 20
#: Fixed value: ASCII white space, which parts words.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
#: An odd base has powers of every kind modulo 2**64, also negative ones.
BASE = 0x9E3779B97F4A7C15 | 1


@dataclass(frozen=True)
class Chunk:
    """Consecutive texts, or a part of one very long text, which is cut at white space."""

    data: np.ndarray
    offsets: np.ndarray  # of each text in `data`, and the end
    first: int  # place of the first text in its batch
    begun: bool = False  # the first text began in an earlier chunk
    open: bool = False  # the last text goes on in a later chunk


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[Chunk]:
    data, offsets = byte_view(texts)
    for a, b in slices(offsets, most):
        part, own = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        if len(part) <= most:
            yield Chunk(part, own, a)
            continue
        at = 0
        while at < len(part):
            end = min(at + most, len(part))
            if end < len(part):
                blank = np.flatnonzero(SPACE[part[at:end]])
                later = np.flatnonzero(SPACE[part[end:]])[:1] if not len(blank) else blank
                end = at + int(blank[-1]) + 1 if len(blank) else end + int(later[0]) + 1 if len(later) else len(part)
            yield Chunk(part[at:end], np.array([0, end - at]), a, at > 0, end < len(part))
            at = end


def bounds(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the text (from 0 in the chunk) that it is in."""
    letter = ~SPACE[chunk.data]
    n = len(letter)
    if not n:
        return (np.empty(0, np.int64),) * 3
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:], after[-1], after[:-1] = False, letter[:-1], False, letter[1:]
    edges = chunk.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(letter & ~before)
    return starts, np.flatnonzero(letter & ~after) + 1, np.searchsorted(chunk.offsets, starts, "right") - 1


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in order."""
    return mixed(a.astype(np.uint64) * np.uint64(BASE) + mixed(b))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges: a polynomial of the bytes, read off running sums, with the length, scrambled."""
    if not len(starts):
        return np.empty(0, np.uint64)
    size = CHUNK + 1
    while size <= len(data):
        size *= 2
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def named(name: str) -> np.uint64:
    """The hash of a marker, apart from those of words: it holds white space."""
    data = np.frombuffer(f" {name}".encode(), np.uint8)
    return hashes(data, np.array([0]), np.array([len(data)]))[0]
