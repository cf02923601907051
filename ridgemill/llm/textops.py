"""Vectorised word kernels that run inside Arrow tasks.

A word is a maximal run of bytes other than ``0x20`` and ``0x09-0x0D``. All
kernels work on one bounded block of texts at a time (`blocks`), so the memory
of a task does not depend on how many rows its partition holds; only one text
that is longer than a block makes a block longer.

Null texts count as empty. Empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2_000_000

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Every ASCII byte that is no letter; a second way to cut words.
NO_LETTERS = np.zeros(256, dtype=bool)
NO_LETTERS[:128] = True
NO_LETTERS[65:91] = NO_LETTERS[97:123] = False

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(STEP), -1, 2**64))
_powers = {STEP: np.ones(1, dtype=np.uint64), BACK: np.ones(1, dtype=np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int, base: np.uint64 = STEP) -> np.ndarray:
    """The first `n` powers of STEP (or of BACK, its inverse) modulo 2**64."""
    if len(_powers[base]) < n:
        steps = np.full(max(n, 64), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run ``values[starts[i]:ends[i]]``."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values) + 1)[1:], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(len(values) + 1, BACK)[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of a block of texts: word `w` is ``data[starts[w]:ends[w]]``, text
    `d` owns the words ``first[d]:first[d + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    spaces: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; A-Z count as a-z if `lower`."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        begin, end = self.starts[0], self.ends[-1]
        data = self.data[begin:end]
        starts = self.starts - begin
        lengths = self.ends - self.starts
        place = np.arange(len(data), dtype=np.int64)
        place -= np.repeat(starts, np.diff(np.append(starts, len(data))))
        np.minimum(place, lengths.max() - 1, out=place)
        table = np.where(self.spaces, np.uint64(0), BYTE_CODES)
        codes = (table[LOWER] if lower else table)[data]
        codes *= powers(int(lengths.max()))[place]
        return mix(np.add.reduceat(codes, starts) + lengths.astype(np.uint64))


def split(texts: pa.Array, spaces: np.ndarray = SPACES) -> Words:
    """The words of an array of strings: maximal runs of bytes outside `spaces`."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and n else np.zeros(0, np.uint8)
    offs = offs - offs[0] if n else np.zeros(1, np.int64)
    if not len(raw):
        return Words(raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64), spaces)
    word = ~spaces[raw]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    closes = word.copy()
    closes[:-1] &= ~word[1:]
    heads = offs[:-1][np.diff(offs) > 0]
    tails = offs[1:][np.diff(offs) > 0] - 1
    opens[heads] = word[heads]
    closes[tails] = word[tails]
    starts = np.flatnonzero(opens)
    return Words(raw, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offs), spaces)


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take about `most` bytes, one row at least."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.float64))
    begin, held = 0, 0.0
    for i, size in enumerate(sizes):
        if i > begin and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0.0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of `k` words of one text; of the whole text if it has fewer words."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(k, n)
    weights = powers(k + 2)[2:]
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for i in range(width):
        out += hashes[i : n - width + 1 + i] * weights[i]
    return mix(out + np.uint64(width))


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Arrays as one list column."""
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, type=kind))
