"""Vectorised text work on Arrow string columns: bytes, words and n-gram hashes of many documents at once.

Hashes are polynomial over the ring of 64-bit integers, from prefix sums, so that the hash of any stretch costs two
lookups whatever its length. They choose candidates; where equality decides a result, the operators compare the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 18  # arrays of this length and eight bytes an entry stay in a core's cache
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=U64)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(size, U64)
        have[1] = base
        filled = 2
        while filled < size:
            have[filled : 2 * filled] = have[:filled] * U64(pow(base, filled, 1 << 64))
            filled *= 2
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums for ``stretch_hash``; one longer than ``values``."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def stretch_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the stretch lies."""
    return (prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start]


def gram_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """``stretch_hash`` of every k consecutive values."""
    n = len(prefix) - k
    if n <= 0:
        return np.zeros(0, U64)
    return (prefix[k:] - prefix[:n]) * powers(_INVERSE, n)


@dataclass
class Chunk:
    """Documents ``first`` .. of a column; ``start``/``end`` are their bounds in ``data``."""

    first: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The UTF-8 bytes of a string or binary column, in chunks of whole documents. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield Chunk(i, raw[off[i] : off[j]], off[i:j] - off[i], off[i + 1 : j + 1] - off[i])
        i = j


@dataclass
class Words:
    """Words of a chunk: bounds in its data, the document (counted in the chunk) and a 64-bit hash of each."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each document, its first word; one longer than the documents


def words(chunk: Chunk, data: np.ndarray | None = None, space: np.ndarray = SPACE) -> Words:
    """Runs of bytes that aren't ``space``; they end with their document."""
    data = chunk.data if data is None else data
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    full = chunk.start < chunk.end
    edge[chunk.start[full]] = True
    edge[chunk.end[full]] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    start = np.flatnonzero(after & (edge | ~before))
    end = np.flatnonzero(before & (edge | ~after))
    prefix = prefix_hash(_BYTE[data])
    doc = np.searchsorted(chunk.end, start, side="right")
    return Words(start, end, doc, mix(stretch_hash(prefix, start, end)), np.searchsorted(doc, np.arange(len(chunk.end) + 1)))


def byte_prefix(data: np.ndarray) -> np.ndarray:
    return prefix_hash(_BYTE[data])


_OWNER = 14  # bits that say whose a value is, in one sort of plain integers


def distinct_sets(value: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each owner in order, and the bounds of each owner's. Values count by their upper 50 bits."""
    low = value >> U64(_OWNER)
    out, sizes = [], []
    for a in range(0, max(owners, 1), 1 << _OWNER):
        most = min(owners - a, 1 << _OWNER)
        if owners <= 1 << _OWNER:
            pair = owner.astype(U64) << U64(64 - _OWNER) | low
        else:
            mine = (owner >= a) & (owner < a + most)
            pair = (owner[mine] - a).astype(U64) << U64(64 - _OWNER) | low[mine]
        pair.sort()
        new = np.ones(len(pair), bool)
        new[1:] = pair[1:] != pair[:-1]
        pair = pair[new]
        sizes.append(np.bincount((pair >> U64(64 - _OWNER)).astype(np.int64), minlength=most)[:most])
        out.append(pair << U64(_OWNER))
    return np.concatenate(out), np.append(0, np.cumsum(np.concatenate(sizes)))


def joined_sets(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of several runs of sets, one after the other."""
    values, bounds = [np.zeros(0, U64)], [np.zeros(1, np.int64)]
    for value, first in parts:
        values.append(value)
        bounds.append(first[1:] + bounds[-1][-1])
    return np.concatenate(values), np.concatenate(bounds)


_PLACE = 24


def winnow(grams: np.ndarray, width: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places of grams that are least in some run of ``width`` consecutive grams of one document (leftmost on ties).

    ``first``/``last``: bounds of each document's grams. Any two equal runs have the same gram chosen, so equal
    windows of the text always share a chosen gram at the same offset.
    """
    place = max(_PLACE, int(len(grams)).bit_length())
    least = (mix(grams) >> U64(place) << U64(place)) | np.arange(len(grams), dtype=U64)
    done = 1
    while done < width:
        step = min(done, width - done)
        n = len(least) - step
        if n <= 0:
            return np.zeros(0, np.int64)
        least = np.minimum(least[:n], least[step:])
        done += step
    good = np.zeros(len(least) + 1, np.int32)
    ok = last - first >= width
    np.add.at(good, first[ok], 1)
    np.add.at(good, last[ok] - width + 1, -1)
    chosen = least[np.cumsum(good)[:-1] > 0] & U64((1 << place) - 1)
    return np.unique(chosen).astype(np.int64)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+length[0]-1, start[1] .. and so on, in one array."""
    total = int(length.sum())
    step = np.ones(total, np.int64)
    if not total:
        return step
    keep = length > 0
    start, length = start[keep], length[keep]
    at = np.cumsum(length)[:-1]
    step[0] = start[0]
    step[at] = start[1:] - (start[:-1] + length[:-1] - 1)
    return np.cumsum(step)
