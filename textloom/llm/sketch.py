"""A count-min sketch of "more than once", built in map tasks and merged by ranges of its cells.

A map task counts its items in cells, up to two, and hands on the occupied cells
as gaps, by chunk of the sketch; one task per chunk adds them up.  The merged
sketch keeps one bit for each cell that was counted twice or more.  An item all of
whose cells have the bit *may* be repeated; one with a cell that lacks it is not.

The sketch has ``DEPTH`` rows of about one cell per item, but at most
``2**MAX_BITS`` cells a row, so its broadcast has a fixed bound
(``DEPTH * 2**MAX_BITS / 8`` bytes).  Past that size it lets more items through
and stays right, since whatever passes is grouped exactly afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .common import parallelism, rows_of, to_batch

DEPTH = 2
MIN_BITS, MAX_BITS, CHUNK_BITS = 16, 30, 20
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))

CELLS = pa.schema([("chunk", pa.int64()), ("once", pa.binary()), ("more", pa.binary())])
CELLS_DDL = "chunk long, once binary, more binary"
_BITS = pa.schema([("chunk", pa.int64()), ("bits", pa.binary())])


def bits_for(items: float) -> int:
    return min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(max(items, 2)))))


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((h * _ODD[row]) >> np.uint64(64 - bits)).astype(np.uint32)


def pack_gaps(sorted_cells: np.ndarray) -> bytes:
    """Ascending integers as gaps of one or two bytes; the highest value of either adds itself and goes on."""
    if not len(sorted_cells):
        return b"\1"
    gaps = np.diff(sorted_cells.astype(np.int64), prepend=0)
    kind = np.uint8 if gaps.mean() < 100 else np.uint16
    top = np.iinfo(kind).max
    more, rest = np.divmod(gaps, top)
    at = np.cumsum(more + 1) - 1
    out = np.full(at[-1] + 1, top, kind)
    out[at] = rest
    return bytes([out.itemsize]) + out.tobytes()


def unpack_gaps(packed: bytes) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16}[packed[0]]
    gaps = np.frombuffer(packed, kind, offset=1)
    return np.cumsum(gaps, dtype=np.int64)[gaps != np.iinfo(kind).max]


def count_cells(h: np.ndarray, bits: int, depth: int = DEPTH) -> pa.RecordBatch:
    """Occupied cells of one block of items, by chunk of the sketch."""
    chunk_bits = min(bits, CHUNK_BITS)
    chunks, once, more = [], [], []
    for row in range(depth):
        cells = _cells(h, row, bits)
        cells.sort()
        first = np.flatnonzero(np.diff(cells, prepend=cells[:1] + np.uint32(1)) != 0) if len(cells) else np.zeros(0, np.int64)
        size = np.diff(first, append=len(cells))
        cells = cells[first]
        edges = np.searchsorted(cells, np.arange(0, (1 << bits) + 1, 1 << chunk_bits, dtype=np.uint64))
        for c in range(1 << (bits - chunk_bits)):
            lo, hi = edges[c], edges[c + 1]
            if lo < hi:
                part, n = cells[lo:hi] - np.uint32(c << chunk_bits), size[lo:hi]
                chunks.append(row << (bits - chunk_bits) | c)
                once.append(pack_gaps(part[n == 1]))
                more.append(pack_gaps(part[n > 1]))
    return to_batch(CELLS, [chunks, once, more])


def merge(spark: SparkSession, cells: DataFrame, bits: int, depth: int = DEPTH) -> Broadcast:
    """Add up the cells and broadcast the bits of those counted more than once."""
    chunk_bits = min(bits, CHUNK_BITS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, None
        for batch in batches:
            for chunk, once, more in zip(*rows_of(batch, "chunk", "once", "more")):
                if chunk != now:
                    if now is not None:
                        yield to_batch(_BITS, [[now], [np.packbits(seen > 1).tobytes()]])
                    now, seen = chunk, np.zeros(1 << chunk_bits, np.uint8)
                at = unpack_gaps(once)
                seen[at] = np.minimum(seen[at] + 1, 2)
                seen[unpack_gaps(more)] = 2
        if now is not None:
            yield to_batch(_BITS, [[now], [np.packbits(seen > 1).tobytes()]])

    spread = cells.repartition(parallelism(spark), "chunk").sortWithinPartitions("chunk")
    merged = spread.mapInArrow(add, "chunk long, bits binary").toArrow()
    table = bytearray(depth << (bits - 3))
    width = 1 << (chunk_bits - 3)
    for chunk, part in zip(merged.column("chunk").to_pylist(), merged.column("bits")):
        table[chunk * width : (chunk + 1) * width] = part.as_buffer()
    del merged
    return spark.sparkContext.broadcast(table)  # at most DEPTH * 2**MAX_BITS / 8 bytes


def maybe_repeated(h: np.ndarray, table: bytearray, bits: int, depth: int = DEPTH) -> np.ndarray:
    """False for items that surely occur once."""
    bitmap = np.frombuffer(table, np.uint8)
    out = np.ones(len(h), bool)
    for row in range(depth):
        at = _cells(h, row, bits).astype(np.int64) + (row << bits)
        out &= (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out
