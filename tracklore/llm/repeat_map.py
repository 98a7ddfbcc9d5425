"""A map of the hashes that more than one document has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracklore.llm import arrow_text as at
from tracklore.llm.stages import discard

#: Documents a counting range is planned for, and bits of the map. Its size is fixed: what is sent to every task does not
#: grow with the corpus, and a fuller map only passes more hashes on to the exact steps.
RANGE_DOCS, MAP_BITS = 4096, 27
#: Bytes of text handled at once.
BLOCK_BYTES = 1 << 19


def _count(range_bits: int, hashes_of: Callable):
    """Per block and range of hashes their slots, one for each document that has the hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _lo, _hi, data, offsets in at.blocks(batch.column(0), BLOCK_BYTES):
                hashes, rows = hashes_of(data, offsets)[:2]
                order = np.lexsort((rows, hashes))
                hashes, rows = hashes[order], rows[order]
                once = np.ones(len(hashes), bool)
                once[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
                slots = (hashes[once] >> np.uint64(32)).astype(np.uint32)
                ranges = slots >> np.uint32(32 - range_bits)
                cut = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])) if len(slots) else np.zeros(0, int)
                parts = np.split(slots, cut[1:]) if len(slots) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ranges[cut], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["range", "slots"])

    return count


def _repeated_slots(batches: pa.Table) -> pa.Table:
    """Map of the slots of a range that more than one document has: (byte of the whole map, bits)."""
    slots = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in batches["slots"].to_pylist()]))
    twice = slots[1:][slots[1:] == slots[:-1]] >> np.uint32(32 - MAP_BITS)
    if not len(twice):
        return pa.table({"place": pa.array([], pa.int64()), "bits": pa.array([], pa.binary())})
    place = int(twice[0] >> np.uint32(3))
    bits = np.zeros(int(twice[-1] >> np.uint32(3)) - place + 1, np.uint8)
    np.bitwise_or.at(bits, (twice >> np.uint32(3)).astype(np.int64) - place, np.uint8(1) << (twice & np.uint32(7)).astype(np.uint8))
    return pa.table({"place": [place], "bits": pa.array([bits.tobytes()], pa.binary())})


def repeated(texts: DataFrame, rows: int, hashes_of: Callable) -> np.ndarray:
    """Bit per slot of a hash that more than one row of `texts`, a single column, has.

    `hashes_of(data, offsets)` gives the hashes of a block of texts and their rows.
    """
    range_bits = min(max(4, (rows // RANGE_DOCS).bit_length()), MAP_BITS - 3)
    counted = texts.mapInArrow(_count(range_bits, hashes_of), "range int, slots binary")
    pieces = counted.groupBy("range").applyInArrow(_repeated_slots, "place long, bits binary")
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for place, part in pieces.toLocalIterator():
        bits[place : place + len(part)] |= np.frombuffer(part, np.uint8)
    del counted, pieces
    discard()
    return bits


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = hashes >> np.uint64(64 - MAP_BITS)
    return (bits[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 > 0
