"""Bloom filters that Spark tasks fill and merge, in shards by hash.

A filter of ``2**bits`` bits is cut into ``2**shard_bits`` shards. A 64-bit hash has its shard in its highest bits and two places there in lower
ones. Tasks emit the places that they fill, a row for each shard (:func:`packed`); one task for a shard merges them (:func:`merged`) into
the bits that were filled once or more and those that were filled twice or more, in any order and in any grouping with the same result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits of a filter for each key, on average, and the fewest bits and shards.
PER_KEY, LEAST_BITS, LEAST_SHARD_BITS = 8, 23, 7

SCHEMA = "shard int, once binary, twice binary"


class Shape:
    """The sizes of a filter for so many keys: never more than ``most_bits``, at which it only lets more keys through."""

    def __init__(self, keys: int, most_bits: int = 43):
        self.bits = min(most_bits, max(LEAST_BITS, int(PER_KEY * keys - 1).bit_length() if keys else 0))
        self.shard_bits = min(16, max(LEAST_SHARD_BITS, self.bits - 23))
        self.place_bits = self.bits - self.shard_bits

    @property
    def n_bytes(self) -> int:
        return 1 << (self.bits - 3)

    @property
    def shards(self) -> int:
        return 1 << self.shard_bits

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard and two places in it; the second place comes from the hash mixed once more."""
        mask = np.uint64((1 << self.place_bits) - 1)
        other = hashes * np.uint64(0x9E3779B97F4A7C15)
        return (hashes >> np.uint64(64 - self.shard_bits)).astype(np.int64), (hashes & mask).astype(np.int64), ((other >> np.uint64(17)) & mask).astype(np.int64)


def packed(hashes: np.ndarray, shape: Shape) -> Iterator[tuple[int, bytes, bytes]]:
    """(shard, places filled, places filled twice or more) of hashes, each of which counts as often as it is there."""
    shard, one, two = shape.places(hashes)
    at = np.concatenate([shard << shape.place_bits | one, (shard << shape.place_bits | two)[one != two]])
    filled, counts = np.unique(at, return_counts=True)
    cuts = np.searchsorted(filled, np.arange(shape.shards + 1) << shape.place_bits)
    place = (filled & ((1 << shape.place_bits) - 1)).astype(np.uint32)
    again = counts > 1
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[k], cuts[k + 1])
        yield k, place[part].tobytes(), place[part][again[part]].tobytes()


def frame(rows: Iterable[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    shards, once, twice = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["shard", "once", "twice"])


def merged(parts: DataFrame, shape: Shape) -> DataFrame:
    """``shard``, ``once``, ``twice``: packed bits, a row for each shard with any. A shard's rows are merged as they come, in the memory of its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = None, None
        done = lambda: frame([(shard, *(np.packbits(x, bitorder="little").tobytes() for x in own))])
        for batch in batches:
            for k, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                if k != shard:
                    if own is not None:
                        yield done()
                    shard, own = k, tuple(np.zeros(1 << shape.place_bits, bool) for _ in range(2))
                place = np.frombuffer(once, np.uint32)
                own[1][place] |= own[0][place]
                own[0][place] = True
                own[1][np.frombuffer(twice, np.uint32)] = True
        if own is not None:
            yield done()

    dealt = parts.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, SCHEMA)


class Bits:
    """A whole filter in memory, for tests of hashes; only for shapes of a checked size."""

    def __init__(self, shape: Shape, rows: Iterable[tuple[int, bytes]]):
        self.shape = shape
        self.bits = np.zeros((shape.shards, 1 << (shape.place_bits - 3)), np.uint8)
        for shard, own in rows:
            self.bits[shard] = np.frombuffer(own, np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        shard, one, two = self.shape.places(hashes)
        bit = lambda at: (self.bits[shard, at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bit(one) & bit(two)).astype(bool)


def holds_in_shard(own: bytes, shape: Shape, hashes: np.ndarray) -> np.ndarray:
    """The same test by one shard's bits, of hashes of that shard."""
    bits = np.frombuffer(own, np.uint8)
    _, one, two = shape.places(hashes)
    bit = lambda at: (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
    return (bit(one) & bit(two)).astype(bool)
