"""Texts in blocks, fingerprints in buckets.

Rows are dealt into blocks of bounded text by a hash of id and text.  A block sends each of its different fingerprints to
the bucket of its leading bits, as five bytes of what follows; the bucket answers every block with those that count.  No
key reaches a bucket more than once a block, so a passage in a third of all rows is no more to a bucket than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, ship_package

REST = 40  # bits of a fingerprint after those of its bucket
LAST = np.iinfo(np.int64).max  # the place of rows without an id

DEALT = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("block", T.LongType()), T.StructField("data", T.BinaryType())])

Table = Callable[[pa.Table], pa.Table]


def bits_for(total: int, each: int) -> int:
    """How many bits number the buckets of ``each`` bytes that ``total`` bytes fill; 256 buckets at least."""
    return max(8, int(np.ceil(np.log2(max(1, total / each)))))


def text_bytes_of(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(column(text_col)))).first()[0] or 0


def blocked(docs: DataFrame, id_col: str, text_col: str, total: int, block_bytes: int, *more: Column) -> DataFrame:
    """(block, id, text in bytes, more): rows that agree in id and text share a block."""
    n_blocks = -(-total // block_bytes) or 1
    number = F.pmod(F.xxhash64(column(id_col), column(text_col)), F.lit(n_blocks))
    return docs.select(number.alias("block"), column(id_col).cast("long").alias("id"),
                       F.coalesce(column(text_col).cast("binary"), F.lit(b"")).alias("text"), *more)


def ranks(table: pa.Table) -> np.ndarray:
    return table["id"].fill_null(LAST).to_numpy().astype(np.int64)


def in_order(table: pa.Table) -> tuple[pa.Table, np.ndarray, list[bytes]]:
    """The rows of a block by id and text, their ids (null: after all others) and texts."""
    own, texts = ranks(table), table["text"].to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (own[i], texts[i]))
    return table.take(pa.array(order, pa.int64())), own[order], [texts[i] for i in order]


def per_group(df: DataFrame, key: str, function: Table, schema: T.StructType) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        return function(table)

    ship_package(df.sparkSession)
    return df.groupBy(key).applyInArrow(run, schema)


def per_pair(left: DataFrame, right: DataFrame, key: str, function: Callable[[pa.Table, pa.Table], pa.Table],
             schema: T.StructType) -> DataFrame:
    def run(table: pa.Table, other: pa.Table) -> pa.Table:
        return function(table, other)

    ship_package(left.sparkSession)
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(run, schema)


def shortened(hashes: np.ndarray, bits: int) -> np.ndarray:
    """What buckets know of a fingerprint: its leading ``bits`` and ``REST`` more."""
    return hashes >> np.uint64(64 - REST - bits)


def pack(numbers: np.ndarray, size: int = 5) -> bytes:
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def unpack(data: bytes, size: int = 5) -> np.ndarray:
    wide = np.zeros((len(data) // size, 8), np.uint8)
    wide[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def by_bucket(short: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Sorted short fingerprints: each bucket and where it lies."""
    buckets = (short >> np.uint64(REST)).astype(np.int64)
    for a, b in stretches(runs(buckets), len(short)):
        yield int(buckets[a]), slice(a, b)


def rest(short: np.ndarray) -> np.ndarray:
    return short & np.uint64((1 << REST) - 1)


def is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values a sorted array holds."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def known_of(table: pa.Table, name: str) -> np.ndarray:
    """All short fingerprints of a block's answers (bucket, ``name``), sorted."""
    parts = [unpack(d) | (np.uint64(b) << np.uint64(REST)) for b, d in zip(table["bucket"].to_pylist(), table[name].to_pylist(), strict=True)]
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *parts]))


def runs(*arrays: np.ndarray) -> np.ndarray:
    """Where a run of rows begins that agree in all arrays."""
    fresh = np.ones(len(arrays[0]), bool)
    if len(fresh):
        fresh[1:] = False
        for a in arrays:
            fresh[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(fresh)


def stretches(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Begin and end of the stretches that begin at ``starts`` and fill ``size`` rows."""
    return list(zip(starts.tolist(), [*starts[1:].tolist(), size])) if len(starts) else []
