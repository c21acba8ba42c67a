"""Words, word hashes and word n-grams of whole Arrow batches, as numpy arrays.

The functions run inside ``mapInArrow`` tasks.  They look at the UTF-8 bytes of
many texts at once, so the cost per byte is a few table look-ups; no Python
object is made per word.  Hashes are 64-bit: two different words or n-grams
agree with probability 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C55
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_FOLD = U64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(members) -> np.ndarray:
    """A 256-entry yes/no table of byte values."""
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


BLANK = table([0x20, *range(0x09, 0x0E)])
NOT_BLANK = ~BLANK
#: Digits, letters in lower case, and every byte of a character outside ASCII.
ALPHANUMERIC = table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mix_int(value: int) -> int:
    """The same for one Python integer."""
    return int(mix(np.array([value & 0xFFFFFFFFFFFFFFFF], dtype=U64))[0])


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, U64(base), dtype=U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 1 << 21:
            _powers[base] = have
    return have[:n]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``size`` bytes: first row, bytes, offsets.  A longer row is a run of its own."""
    if not len(column):
        return
    data, offsets = string_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


def word_spans(lowered: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of member bytes inside a row, and each row's first word number."""
    inside = member[lowered]
    if not len(inside):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[filled] = False
    ends = offsets[1:][offsets[1:] > offsets[:-1]]
    after[ends - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def prefix_sums(lowered: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``span_hashes`` reads any span out of them."""
    out = np.empty(len(lowered) + 1, dtype=U64)
    out[0] = 0
    np.cumsum((lowered.astype(U64) + U64(1)) * _power(_BASE, len(lowered)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, wherever it lies."""
    raw = (sums[ends] - sums[starts]) * _power(_BASE_INVERSE, len(sums))[starts]
    return mix(raw + (ends - starts).astype(U64) * _FOLD)


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes in text order (A-Z lower-cased), and each row's first word number (one more than rows)."""
    lowered = LOWER[data]
    starts, ends, first = word_spans(lowered, offsets, member)
    return span_hashes(prefix_sums(lowered), starts, ends), first


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows inside each row, and each row's first window number."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    if not at[-1]:
        return np.zeros(0, dtype=U64), at
    begin = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], counts)
    out = hashes[begin]
    for k in range(1, n):
        out = out * _FOLD + hashes[begin + k]
    return mix(out + U64(n)), at


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each row's distinct n-word shingles, sorted; a shorter row's whole sequence is its one shingle."""
    grams, at = ngrams(hashes, first, n)
    for i in range(len(first) - 1):
        size = first[i + 1] - first[i]
        if size >= n:
            yield np.unique(grams[at[i]: at[i + 1]])
        elif size:
            yield ngrams(hashes[first[i]: first[i + 1]], np.array([0, size]), int(size))[0]
        else:
            yield grams[:0]
