"""A Bloom filter of ids, of fixed size at every size of input.

A join of a large table with few of its rows shuffles both sides whole.  The sieve
lets nearly all rows that would find no partner fall before the shuffle; the join
after it is exact.  Where more ids go in than the sieve can hold it lets more rows pass,
down to the plain join: results and plan stay the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.worker import lean

#: Bits of the filter (a power of two; 8 MB) and bits set by an id.
BITS = 1 << 26
PROBES = 4


def mixed(ids: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit hashes of 64-bit integers (splitmix64)."""
    z = ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _places(ids: np.ndarray) -> np.ndarray:
    z = mixed(ids)
    step = (z >> np.uint64(32)) | np.uint64(1)
    return np.stack([(z + np.uint64(k) * step) & np.uint64(BITS - 1) for k in range(PROBES)])


def _packed(held: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([zlib.compress(held.tobytes(), 1)], pa.binary())], ["bits"])


def sieve(ids: DataFrame) -> np.ndarray:
    """The filter of ids(id long), put together by a tree of tasks; the driver gets BITS / 8 bytes."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BITS // 8, dtype=np.uint8)
        for b in batches:
            at = _places(b.column(0).to_numpy(zero_copy_only=False)).ravel()
            np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield _packed(held)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for c in b.column(0):
                more = np.frombuffer(zlib.decompress(c.as_py()), dtype=np.uint8)
                held = more.copy() if held is None else held | more
        if held is not None:
            yield _packed(held)

    parts = ids.select("id").mapInArrow(lean(fill), "bits binary")
    for n in (32, 1):
        parts = parts.repartition(n).mapInArrow(lean(join), "bits binary")
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for r in parts.collect():  # one row of fixed size
        out |= np.frombuffer(zlib.decompress(r[0]), dtype=np.uint8)
    return out


def passes(spark, held: np.ndarray, name: str) -> Column:
    """Whether the sieve may hold the id in column ``name``: never false for one that is in it."""
    sent = spark.sparkContext.broadcast(held)  # of fixed size

    @F.pandas_udf("boolean")
    def may(ids: pd.Series) -> pd.Series:
        bits, out = sent.value, np.ones(len(ids), dtype=bool)
        for at in _places(ids.to_numpy()):
            out &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return pd.Series(out)

    return may(F.col(name))
