"""Numpy kernels over the byte buffers of Arrow string columns; no text is decoded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes handled at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[65:91] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True

_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix64 finalizer)."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        step = x >> U64(shift)
        step ^= x
        step *= U64(factor)
        x = step
    step = x >> U64(31)
    step ^= x
    return step


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers)), 0x9E3779B97F4A7C15, U64)
        steps[0] = 1
        _powers = np.cumprod(steps)
    return _powers


def inverse_powers(n: int) -> np.ndarray:
    """Inverses of `powers`, modulo 2**64."""
    global _inverses
    if len(_inverses) < n:
        steps = np.full(max(n, 2 * len(_inverses)), pow(0x9E3779B97F4A7C15, -1, 2**64), U64)
        steps[0] = 1
        _inverses = np.cumprod(steps)
    return _inverses


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _valid, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_, bounds


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about `block_bytes`: (first row, last row + 1, bytes, offsets from 0)."""
    data, offsets = text_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + block_bytes, "right")) - 1
        stop = min(max(stop, row + 1), rows)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def split_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word (a run of bytes of `kind` within a row)."""
    n = len(data)
    inside = kind[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[filled] = inside[filled]
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, np.flatnonzero(last) + 1 if n else starts, rows


def hash_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice; slices are in order and do not overlap or stand empty."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = data[np.repeat(starts, lengths) + place].astype(U64) + U64(1)
    values *= powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, first) ^ (lengths.astype(U64) * U64(0xD6E8FEB86659FD93)))


def lower_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash (A-Z lower-cased) and row of each word."""
    starts, ends, rows = split_words(data, offsets, kind)
    return hash_slices(LOWER[data], starts, ends), rows


def member(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index in `sorted_values` of each wanted value, -1 if absent."""
    if not len(sorted_values):
        return np.full(len(wanted), -1)
    at = np.searchsorted(sorted_values, wanted)
    at[at == len(sorted_values)] = 0
    return np.where(sorted_values[at] == wanted, at, -1)
