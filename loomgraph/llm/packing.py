"""Best-fit packing by exact-complement hashing.

Only lengths matter to a packing, and there are at most ``capacity`` of them, so
the plan is made on the histogram of lengths whatever the number of documents.
From the longest length down, the gap it leaves is looked up among the sums of one,
two and three available lengths; a combination that fills it exactly is consumed as
often as counts allow.  What has no exact complement is filled best-fit: the
longest piece that still fits, again and again.  Pieces then find their place by
their rank within their length, which is counted in buckets so that a length that a
third of all pieces share is no single task's work.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.bpe import library_encoder, text_slices
from loomgraph.llm.columns import pick
from loomgraph.operators.workspace import Workspace
from loomgraph.llm.worker import lean

CAPACITY = 2048
SEPARATOR = 0
#: Pieces of one length and bucket that are numbered together, about.
PER_BUCKET = 50_000
LEAST_BUCKETS = 64


class Complements:
    """Counts of available lengths with an index of the sums of two of them."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, dtype=np.int64)
        for length, k in counts.items():
            self.n[length] += k
        self.sums = np.zeros(capacity + 1, dtype=np.int64)  # pairs of available lengths by sum
        self.capacity = capacity
        for length in np.flatnonzero(self.n):
            self._pairs(int(length), 1, upto=int(length))
            if self.n[length] >= 2 and 2 * length <= capacity:
                self.sums[2 * length] += 1

    def _pairs(self, length: int, sign: int, upto: int | None = None) -> None:
        """Add or remove the pairs of ``length`` with the other available lengths."""
        other = np.flatnonzero(self.n[: self.capacity + 1 - length])
        other = other[(other != length) if upto is None else (other < upto)]
        self.sums[other + length] += sign

    def take(self, parts: Counter, times: int) -> None:
        for length, m in parts.items():
            had, left = int(self.n[length]), int(self.n[length]) - m * times
            if had >= 2 > left and 2 * length <= self.capacity:
                self.sums[2 * length] -= 1
            if left == 0:
                self._pairs(length, -1)
            self.n[length] = left

    def one(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if gap > 0 and self.n[gap] else None

    def two(self, gap: int, longest: int) -> tuple[int, ...] | None:
        if gap < 2 or not self.sums[gap]:
            return None
        a = np.arange(min(gap - 1, longest), (gap - 1) // 2, -1)
        if not len(a):  # two of the longest fall short
            return None
        b = gap - a
        ok = (self.n[a] > 0) & (self.n[b] > 0) & ((a != b) | (self.n[a] > 1))
        at = int(np.argmax(ok))
        return (int(a[at]), int(b[at])) if ok.any() else None

    def three(self, gap: int, longest: int) -> tuple[int, ...] | None:
        if gap < 3:
            return None
        a = np.arange(min(gap - 2, longest), 0, -1)
        for x in a[(self.n[a] > 0) & (self.sums[gap - a] > 0)]:
            x = int(x)
            self.n[x] -= 1
            rest = self.two(gap - x, x)
            self.n[x] += 1
            if rest:
                return (x, *rest)
        return None

    def largest(self, most: int) -> int:
        some = np.flatnonzero(self.n[: most + 1])
        return int(some[-1]) if len(some) else 0


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences), using every count up exactly."""
    left = Complements({k: v for k, v in counts.items() if v}, capacity)
    plan: list[tuple[tuple[int, ...], int]] = []
    while top := left.largest(capacity):
        left.n[top] -= 1  # one lies in the sequence already
        gap = capacity - top
        rest = () if gap == 0 else left.one(gap) or left.two(gap, top) or left.three(gap, top)
        if rest is None:
            parts = []
            while fit := left.largest(gap - sum(parts)):
                parts.append(fit)
                left.n[fit] -= 1
            for p in parts:
                left.n[p] += 1
            rest = tuple(parts)
        left.n[top] += 1
        need = Counter((top, *rest))
        times = min(int(left.n[x]) // m for x, m in need.items())
        left.take(need, times)
        plan.append(((top, *rest), times))
    return plan


def plan_table(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks of runs, the sequence of each run's first piece, its offset there."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for parts, times in plan:
        at = 0
        for length in parts:
            runs.setdefault(length, []).append((used[length], sequence, at))
            used[length] += times
            at += length
        sequence += times
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): ids of the text and a separator, cut only beyond capacity."""
    kept = pick(docs, id=id_col, text=text_col)
    end = SEPARATOR.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = library_encoder(tokenizer)
        for b in batches:
            for keys, texts in text_slices(b):
                rows = []
                for k, ids in enumerate(enc.encode_batch(texts)):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        rows.append((k, piece, start // 4, len(part) // 4, zlib.crc32(part)))
                at, *rest = zip(*rows, strict=True)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *(pa.array(c, t) for c, t in zip(rest, kinds, strict=True))], ["id", "piece", "start", "length", "ids_crc32"])

    return kept.mapInArrow(lean(run), f"id {kept.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, ws: Workspace, capacity: int = CAPACITY, key: str = "row") -> DataFrame:
    """Add sequence_id and offset to ``pieces``, a stored table with a column length of 1 to capacity.

    ``key`` is unique and stored, so that neither ties nor repeated or null ids crowd a task; it is
    dropped. The driver sees counts by length alone. Repeated rows are packed one by one. Empty table: no rows.
    """
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    if not counts:
        return pieces.drop(key).select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    runs = plan_table(plan_patterns(counts, capacity))
    buckets = max(LEAST_BUCKETS, sum(counts.values()) // PER_BUCKET)
    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    inside = Window.partitionBy("length", "__bucket").orderBy(key)
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "__bucket").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    ranked = dealt.withColumn("__row", F.row_number().over(inside)).join(offsets.hint("merge"), ["length", "__bucket"])
    ranked = ranked.select(*(c for c in pieces.columns if c != key), (F.col("__before") + F.col("__row") - 1).alias("__rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, offset = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            lengths, ranks = b["length"].to_numpy(), b["__rank"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            for chunk in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(chunk):
                    first, seq, off = runs[int(lengths[chunk[0]])]
                    k = np.searchsorted(first, ranks[chunk], side="right") - 1
                    sequence[chunk], offset[chunk] = seq[k] + ranks[chunk] - first[k], off[k]
            yield b.drop(columns="__rank").assign(sequence_id=sequence, offset=offset)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != key)
    return ranked.mapInPandas(lean(place), f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty and still takes a separator's place. Null or repeated ids are
    packed like any other row; a text longer than ``capacity`` is cut into pieces that are packed apart.
    Other columns are ignored. Empty table: no rows.
    """
    ws = Workspace(docs.sparkSession, "packing")
    pieces = ws.save(cut_pieces(docs, tokenizer, capacity, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, ws, capacity).withColumnRenamed("id", id_col)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
