"""Texts of Arrow batches as numpy arrays.

The operators of this subpackage that run Python do so in ``mapInArrow`` tasks and look at whole batches of UTF-8
bytes at once.  ``chunks`` cuts a batch into runs of rows of about a megabyte, so that temporary arrays stay small
whatever the number of rows Spark puts into a batch; a single longer text makes a chunk of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes that separate words: space and 0x09-0x0D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


@dataclass
class Chunk:
    """Rows lo..hi of a batch: data holds their bytes, row i is data[starts[i]:ends[i]]; null texts are empty."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    valid: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (one more than rows) and validity of a string or binary column."""
    col = col.cast(pa.large_binary())
    n, valid = len(col), np.asarray(col.is_valid())
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, col.offset * 8)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data, offsets, valid


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    data, offsets, valid = text_buffers(col)
    lo, n = 0, len(valid)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + 65536)
        base = offsets[lo]
        yield Chunk(lo, hi, data[base : offsets[hi]], offsets[lo:hi] - base, offsets[lo + 1 : hi + 1] - base, valid[lo:hi])
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


#: Longer strings are hashed one by one with BLAKE2b.
LONG = 256
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def string_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the strings data[start:end]: eight bytes after eight are scrambled in, so no pattern of bytes
    makes two of them meet."""
    v, size = lanes(data), end - start
    h = mix(size.astype(U64) + mix(np.full(1, seed + 1, U64)))
    some = np.flatnonzero((size > 0) & (size <= LONG))
    off = 0
    while len(some):
        x = v[start[some] + off] & _MASKS[np.minimum(size[some] - off, 8)]
        h[some] = mix((h[some] ^ x) + U64(BASE))
        off += 8
        some = some[size[some] > off]
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return h


def fixed_hashes(v: np.ndarray, start: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """string_hashes of strings of one length up to LONG, from the lanes of their bytes."""
    h = mix(np.full(len(start), n, U64) + mix(np.full(1, seed + 1, U64)))
    for off in range(0, n, 8):
        h = mix((h ^ (v[start + off] & _MASKS[min(n - off, 8)])) + U64(BASE))
    return h


def same_lanes(v: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Whether the strings of ``size`` bytes at a and at b are equal, byte by byte, from the lanes of the bytes: v, and
    those of b's bytes if they are others."""
    w = v if w is None else w
    same = np.ones(len(a), bool)
    some, off = np.flatnonzero(size > 0), 0
    while len(some):
        mask = _MASKS[np.minimum(size[some] - off, 8)]
        same[some] = (v[a[some] + off] & mask) == (w[b[some] + off] & mask)
        off += 8
        some = some[same[some] & (size[some] > off)]
    return same


def same_strings(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a + size] and data[b:b + size] are equal, byte by byte."""
    out = np.ones(len(a), bool)
    short = np.flatnonzero(size <= LONG)
    out[short] = same_lanes(lanes(data), a[short], b[short], size[short])
    for i in np.flatnonzero((size > LONG) & (a != b)):
        out[i] = np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]])
    return out


_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of BASE and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            out = np.ones(size, U64)
            done = 1
            while done < size:  # doubling: the second half is the first times base**done
                out[done : 2 * done] = out[:done] * U64(pow(b, done, 1 << 64))
                done *= 2
            _powers[k] = out
    return _powers[0][:n], _powers[1][:n]


@lru_cache
def byte_values(seed: int) -> np.ndarray:
    """What a byte counts for in a polynomial hash."""
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93) + U64(seed) * U64(BASE)) | U64(1)


def prefix_hashes(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """prefix[i] = sum of value(data[j]) * BASE**j over j < i, for strings of up to a few hundred bytes: modulo 2**64
    longer ones of a regular pattern can meet, so what is equal by these hashes is compared by bytes."""
    out = np.zeros(len(data) + 1, U64)
    v = byte_values(seed)[data]
    v *= powers(len(data))[0]
    np.cumsum(v, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[starts:ends] that don't depend on where the spans lie."""
    return (prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts]


@lru_cache
def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


@lru_cache
def nonspace_table() -> np.ndarray:
    t = np.ones(256, bool)
    t[list(SPACES)] = False
    return t


def runs(inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of true bytes that don't cross rows."""
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, z
    full = ends > starts
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[starts[full]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[ends[full] - 1] = False
    first = np.flatnonzero(inside & ~before)
    last = np.flatnonzero(inside & ~after) + 1
    row = np.flatnonzero(full)[np.searchsorted(starts[full], first, "right") - 1] if len(first) else first
    return first, last, row


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    total = int(counts.sum())
    out = np.arange(total, dtype=np.int64)
    out -= np.repeat(np.cumsum(counts) - counts, counts)
    return out
