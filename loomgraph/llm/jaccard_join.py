"""Jaccard self-join of 5-word shingle sets in their metric space, exact at 0.8.

Jaccard distance d is a metric and links ask d <= r = 0.2.  Pivots, Voronoi cells and
triangle-inequality windows are used on two scales, because on one they say nothing:
nearly all texts are at distance 1 from any other, so cells of document pivots alone
would replicate every text into every cell.

1. Coarse regions.  The first pivots are one-shingle sets {s}: d({s}, X) is 1 - 1/|X| when
   s is in X and 1 otherwise, so a text's nearest pivots are its own shingles; ties
   fall to the rarest.  A linked text may lack up to a ninth of both sizes, so a text
   is replicated to its first floor(|X|/5) + 1 pivots: any two linked texts then share a
   region, and in that of their first common pivot both stand early (the position
   window).  The order is by counts in a fixed-size sketch of all shingles of the
   corpus, ties by the shingle; any fixed order is exact, this one keeps regions small.
   The replicas are sorted once by (shingle, size, id) over range partitions, which split
   a hot shingle like any other; members that no window joins to another one fall there,
   and regions with the same members become one.
2. Cells.  In a region a document is the pivot p: the member in which the shingle stands earliest,
   as it has least of its own.  d(x, p) of every member is looked at: one request per (x, p) whatever number of regions asks it.  Members within r join
   p's component.  By the triangle inequality a member y of p's cell is within r of an
   outside x only if d(y, p) >= d(x, p) - r: the region that is left is the outside and
   this boundary.  It is joined recursively with a new pivot from the outside, until one component
   is left in it, few members are, or a pivot no longer takes a quarter of it away.  Every round
   but a region's last does, so rounds grow with the logarithm of the largest region.
3. Leaves.  What is left is compared in blocks across components only, behind the
   windows of size, position, and distance to the last pivot, and the contraction. A region of
   many members is dealt out by pairs of blocks; only pairs that pass leave a task.

Requests pass a contraction first: bucket counts of two sets differ in sum by no more
than the sets do.  Only survivors are compared, shingle by shingle, on their texts. Copies and near
copies thus cost one request per pivot and not a pair each, and no link is lost: a pair
that is never compared is already in one component or proven apart.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from loomgraph.llm.columns import pick
from loomgraph.llm.sieve import mixed, passes, sieve
from loomgraph.operators.components import connected_components
from loomgraph.operators.skew import lookup_join
from loomgraph.operators.workspace import Workspace
from loomgraph.llm.worker import lean

WORDS = 5
#: Largest distance of a link.
R = 0.2
#: Counters of the frequency sketch (a power of two) and buckets of the contraction.
COUNTERS_BITS = 20
BUCKETS = 128
#: Regions of so many members or fewer are leaves.
LEAF = 32
#: Requests of one pivot that one task answers, and members of a leaf's block.
PER_SALT = 64
PER_BLOCK = 512
#: Rows of one shingle that are held together while windows are looked at; beyond, all stay.
HELD_ROWS = 1 << 16
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's 5-word shingles; of fewer words, one of the whole."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    n = len(words)
    if n < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), n)] if n else [], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n)
    out = h[: n - WORDS + 1].copy()
    for k in range(1, WORDS):
        out ^= out >> np.uint64(29)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : n - WORDS + 1 + k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _digest(s: np.ndarray) -> bytes:
    """128-bit hash of a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _counter(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - COUNTERS_BITS)).astype(np.int64)


def frequency_sketch(docs: DataFrame) -> np.ndarray:
    """Counts of all shingles of all texts in 2**COUNTERS_BITS counters, summed up a tree of tasks. Where counters are shared by many shingles, only the common ones stand out."""
    size = 1 << COUNTERS_BITS

    def packed(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)], pa.binary())], ["counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        held, n = [], 0
        for b in batches:
            for t in b.column(0):
                held.append(_counter(shingles(t.as_py())))
                n += len(held[-1])
                if n > 2_000_000:
                    total += np.bincount(np.concatenate(held), minlength=size)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=size)
        yield packed(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for c in b.column(0):
                more = np.frombuffer(zlib.decompress(c.as_py()), dtype="<i8")
                total = more.copy() if total is None else total + more
        if total is not None:
            yield packed(total)

    sums = docs.select("text").mapInArrow(lean(count), "counts binary")
    for parts in (64, 8, 1):
        sums = sums.repartition(parts).mapInArrow(lean(add), "counts binary")
    rows = sums.collect()  # one row of fixed size
    return sum((np.frombuffer(zlib.decompress(r[0]), dtype="<i8") for r in rows), np.zeros(size, dtype=np.int64))


def profiles(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """docs(id, text) -> (id, n, first, buckets, digest, prefix): set size, the first row of the task with the same set, contraction, 128-bit hash of the set, coarse pivots in order.

    Rows whose set the task has seen carry no prefix: they share ``first``'s component.
    """
    held = docs.sparkSession.sparkContext.broadcast(counts)  # of fixed size
    fields = [("id", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("buckets", pa.binary()), ("digest", pa.binary()), ("prefix", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        seen: dict[bytes, int] = {}
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            out: list[tuple] = []
            size = 0
            for i, t in zip(ids, texts, strict=True):
                s = shingles(t.as_py())
                n = len(s)
                digest = _digest(s)
                first = seen.setdefault(digest, i) if n else i
                prefix = np.empty(0, dtype=np.int64)
                if n and first == i:
                    order = np.argsort(counts[_counter(s)], kind="stable")
                    prefix = s[order[: n // 5 + 1]].view(np.int64)
                buckets = np.minimum(np.bincount((s % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8)
                out.append((i, n, first, buckets.tobytes(), digest, prefix))
                size += len(prefix)
                if size > 500_000:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        ends = np.cumsum([0, *map(len, columns[5])], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(columns[5])))
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, (_, k) in zip(columns[:5], fields, strict=False)), lists], [f[0] for f in fields])

    return docs.select("id", "text").mapInArrow(lean(run), "id long, n long, first long, buckets binary, digest binary, prefix array<long>")


def bucket_distance(a: str, b: str) -> Column:
    """Sum of differences of bucket counts: never more than the sets' symmetric difference."""

    @F.pandas_udf(LongType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(c), dtype=np.uint8).reshape(-1, BUCKETS).astype(np.int16) for c in (a, b))
        return pd.Series(np.abs(x - y).sum(axis=1, dtype=np.int64))

    return distance(a, b)


def _windows(n: np.ndarray, at: np.ndarray, m: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """Whether sizes and positions of the first common shingle leave room for a link."""
    return (np.minimum(n, m) * 10 >= np.maximum(n, m) * 8) & (9 * np.minimum(n - at, m - bt) >= 4 * (n + m))


def _met(s: np.ndarray, i: np.ndarray, n: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Of whole runs of one shingle, sorted by size: the members that some window joins to another; equal sets of members get one region."""
    run = np.cumsum(np.r_[True, s[1:] != s[:-1]]) - 1
    size = np.bincount(run)
    stay = size[run] > 1
    run, s, i, n, at = run[stay], s[stay], i[stay], n[stay], at[stay]
    near = size[run] > 2 * LEAF
    for k in range(1, 2 * LEAF):
        x = np.flatnonzero(run[k:] == run[:-k])
        if not len(x):
            break
        y = x + k
        ok = _windows(n[x], at[x], n[y], at[y])
        near[x[ok]] = near[y[ok]] = True
    run, i, n, at = run[near], i[near], n[near], at[near]
    if not len(run):
        return [run, i, n, at]
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    # A sum of mixed ids names the members; a clash would only join two regions.
    names = np.add.reduceat(mixed(i), first)
    return [np.repeat(names, np.diff(np.r_[first, len(run)])).view(np.int64), i, n, at]


def region_rows(rows: DataFrame) -> DataFrame:
    """rows(s, id, n, at), sorted within range partitions -> (g, id, n, at): members of regions g.

    A shingle that begins or ends a partition may go on in the next one, and one of more than
    HELD_ROWS rows is not held: their rows pass as they are, under the shingle.
    """
    names = ["g", "id", "n", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        raw = None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(cols[0]):
                continue
            if raw is None:
                raw = cols[0][0]
            if held is not None and len(held[0]):
                cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
            go = int(np.searchsorted(cols[0], raw, side="right")) if cols[0][0] == raw else 0
            if go:
                yield pa.RecordBatch.from_arrays([pa.array(c[:go]) for c in cols], names)
                cols = [c[go:] for c in cols]
            if not len(cols[0]):
                held = None
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
            if last:
                out = _met(*(c[:last] for c in cols))
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names)
            held = [c[last:] for c in cols]
            if len(held[0]) > HELD_ROWS:
                raw = held[0][0]
        if held is not None and len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names)

    return rows.select("s", "id", "n", "at").mapInArrow(lean(run), "g long, id long, n long, at long")


def compare_texts(rows: DataFrame) -> DataFrame:
    """rows(y, hy, salt, role, hx, copies, h, text), groups sorted with the pivot's text (role 0) first -> (hx, hy, copies, both).

    Holds the pivot's set and one other at a time. Texts whose set is not h belong to a row that only repeats the id.
    """
    names = ["hx", "hy", "copies", "both"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivot = None, None
        for b in batches:
            out = []
            keys = list(zip(*(b.column(c).to_pylist() for c in ("y", "hy", "salt")), strict=True))
            roles, hx, copies, h, texts = b.column("role").to_pylist(), b.column("hx").to_pylist(), b.column("copies").to_pylist(), b.column("h").to_pylist(), b.column("text")
            for k, key in enumerate(keys):
                if key != at:
                    at, pivot = key, None
                if roles[k] == 0 and pivot is not None:
                    continue
                s = shingles(texts[k].as_py())
                if _digest(s) != h[k]:
                    continue
                if roles[k] == 0:
                    pivot = s
                elif pivot is not None:
                    out.append((hx[k], key[1], copies[k], len(np.intersect1d(s, pivot, assume_unique=True))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names)

    return rows.mapInArrow(lean(run), "hx binary, hy binary, copies long, both long")


def compare_blocks(rows: DataFrame) -> DataFrame:
    """rows(g, i, k, block, id, n, at, label, low, high, buckets, digest), sorted by (g, i, k): pairs of blocks i and k of a region -> (x, y, nx, ny, hx, hy) that may be links.

    Only members of different components are compared, behind all windows and the contraction.
    """
    names = ["x", "y", "nx", "ny", "hx", "hy"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def pairs(held: pa.Table) -> Iterator[pa.RecordBatch]:
        first, second = held["i"][0].as_py(), held["k"][0].as_py()
        block, i, n, at, label, low, high = (held[c].to_numpy() for c in ("block", "id", "n", "at", "label", "low", "high"))
        buckets = np.frombuffer(b"".join(held["buckets"].to_pylist()), dtype=np.uint8).reshape(-1, BUCKETS).astype(np.int16)
        digest = held["digest"].to_pylist()
        rows, others = np.flatnonzero(block == first), np.flatnonzero(block == second)
        for x in rows:
            y = others[others > x] if first == second else others
            ok = (label[y] != label[x]) & _windows(n[x], at[x], n[y], at[y]) & (low[x] - high[y] <= R + 1e-9) & (low[y] - high[x] <= R + 1e-9)
            y = y[ok]
            y = y[9 * np.abs(buckets[y] - buckets[x]).sum(axis=1) <= n[y] + n[x]]
            if len(y):
                out = [(i[x], i[z], n[x], n[z], digest[x], digest[z]) if i[x] < i[z] else (i[z], i[x], n[z], n[x], digest[z], digest[x]) for z in y]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            g, i, k = (b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "i", "k"))
            cuts = np.flatnonzero((g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (k[1:] != k[:-1])) + 1
            parts = [b.slice(p, q - p) for p, q in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True)]
            for p in parts:
                if held and any(held[0].column(c)[0] != p.column(c)[0] for c in ("g", "i", "k")):
                    yield from pairs(pa.Table.from_batches(held))
                    held = []
                held.append(p)
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return rows.mapInArrow(lean(run), "x long, y long, nx long, ny long, hx binary, hy binary")


class Join:
    """State of one self-join: profiles, links so far, components so far.

    Joins that grow with the corpus are hinted as merge joins behind sieves of a fixed size, so that plans are the same at every size.
    """

    def __init__(self, docs: DataFrame, ws: Workspace):
        self.docs, self.ws, self.spark = docs, ws, docs.sparkSession
        self.profile = ws.save(profiles(docs, frequency_sketch(docs)), "profiles")
        self.size = self.profile.select("id", "n", "buckets", "digest").where("n > 0")
        self.label: DataFrame | None = None  # (id, label) of texts in some link

    def sizes_of(self, ids: DataFrame) -> DataFrame:
        """Stored (id, n, buckets, digest) of ids(id), and of few others."""
        return self.ws.save(self.size.where(passes(self.spark, sieve(ids), "id")).distinct(), "sizes")

    def regions(self) -> DataFrame:
        """(g, id, n, at, pivot, np, ap, members) of every coarse region with two texts or more."""
        rows = self.profile.where("id = first").select("id", "n", F.posexplode("prefix").alias("at", "s")).select("s", "n", "id", "at")
        rows = rows.repartitionByRange("s", "n", "id").sortWithinPartitions("s", "n", "id").withColumn("at", F.col("at").cast("long"))
        met = self.ws.save(region_rows(rows), "met")
        # Regions with the same members are one, with the earliest places: windows only widen.
        met = self.ws.save(met.groupBy("g", "id", "n").agg(F.min("at").alias("at")), "merged")
        return self.with_pivots(met, F.struct("at", "n", "id"))

    def with_pivots(self, rows: DataFrame, order: Column, only: Column | None = None) -> DataFrame:
        """Rows of regions that ``only`` keeps, with their size and the pivot, the member that is least in ``order``."""
        per = rows.groupBy("g").agg(F.count("*").alias("members"), F.min(order).alias("p"), *((only.alias("open"),) if only is not None else ())).where("members > 1")
        if only is not None:
            per = per.where("open").drop("open")
        per = self.ws.save(per.select("g", "members", F.col("p.id").alias("pivot"), F.col("p.n").alias("np"), F.col("p.at").alias("ap")), "pivots")
        return self.ws.save(lookup_join(rows, per, ["g"], "members"), "regions")

    def answer(self, asked: DataFrame) -> DataFrame:
        """asked(x, y, nx, ny), stored -> (x, y, nx, ny, both), both: shared shingles; no row where the contraction proves d > r."""
        ws = self.ws
        sizes = self.sizes_of(asked.select(F.col("x").alias("id")).unionByName(asked.select(F.col("y").alias("id"))))
        asks = asked.groupBy("y", "ny").agg(F.count("*").alias("asks")).join(sizes.toDF("y", "ny", "by", "hy").hint("merge"), ["y", "ny"])
        asks = ws.save(asks.groupBy("y", "ny", "by", "hy").agg(F.max("asks").alias("asks")), "asks")
        faced = lookup_join(asked.join(sizes.toDF("x", "nx", "bx", "hx").hint("merge"), ["x", "nx"]), asks, ["y", "ny"], "asks")
        faced = ws.save(faced.where(9 * bucket_distance("bx", "by") <= F.col("nx") + F.col("ny")).select("x", "y", "nx", "ny", "hx", "hy").distinct(), "faced")
        ws.drop(sizes, asks)
        return self.verify(faced)

    def verify(self, faced: DataFrame) -> DataFrame:
        """faced(x, y, nx, ny, hx, hy), stored -> (x, y, nx, ny, both): the sets themselves are compared."""
        ws = self.ws
        # Equal sets, by their 128-bit hashes, need no look at the shingles; copies of two sets are compared once.
        near = ws.save(faced.where("hx <> hy").groupBy("hx", "hy").agg(F.min(F.struct("x", "y")).alias("p"), F.count("*").alias("copies")).select("hx", "hy", "p.x", "p.y", "copies"), "near")
        asks = ws.save(near.groupBy("y", "hy").agg(F.count("*").alias("asks")), "asks")
        salts = F.ceil(F.col("asks") / PER_SALT)
        dealt = lookup_join(near, asks, ["y", "hy"], "asks").select(F.col("x").alias("id"), F.col("hx").alias("h"), "y", "hy", F.pmod(F.xxhash64("x"), salts).alias("salt"), F.lit(1).alias("role"), "hx", "copies")
        pivots = asks.select(F.col("y").alias("id"), F.col("hy").alias("h"), "y", "hy", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(0).alias("role"), F.lit(None).cast("binary").alias("hx"), F.lit(0).cast("long").alias("copies"))
        roles = ws.save(dealt.unionByName(pivots), "roles")
        # A text goes to each of its requests: at most one per coarse pivot of its own, and one per PER_SALT others that ask it.
        texts = self.docs.where(passes(self.spark, sieve(roles), "id"))
        carried = roles.hint("merge").join(texts, "id").repartition("y", "hy", "salt").sortWithinPartitions("y", "hy", "salt", "role")
        seen = ws.save(compare_texts(carried.select("y", "hy", "salt", "role", "hx", "copies", "h", "text")).groupBy("hx", "hy").agg(F.max("both").alias("both"), F.max("copies").alias("copies")), "seen")
        told = lookup_join(faced.where("hx <> hy"), seen, ["hx", "hy"], "copies").select("x", "y", "nx", "ny", "both")
        equal = faced.where("hx = hy").select("x", "y", "nx", "ny", F.col("nx").alias("both"))
        out = ws.save(told.unionByName(equal).groupBy("x", "y", "nx", "ny").agg(F.max("both").alias("both")), "answers")
        ws.drop(faced, near, asks, roles, seen)
        return out

    def link(self, answers: DataFrame, more: DataFrame | None = None) -> None:
        """Take the linked pairs of ``answers`` and those of ``more`` into the components; labels are smallest ids."""
        found = answers.where("100 * both >= 80 * (nx + ny - both)").select("x", "y")
        if more is not None:
            found = found.unionByName(more)
        if self.label is None:
            edges = found.toDF("a", "b")
            self.label = self.ws.save(connected_components(edges, self.ws).toDF("id", "label"), "labels")
            return
        # Only components that a new link joins change.
        old = self.label
        named = found
        for c in ("x", "y"):
            named = named.join(old.toDF(c, f"l{c}").hint("merge"), c, "left").withColumn(c, F.coalesce(f"l{c}", c)).drop(f"l{c}")
        edges = self.ws.save(named.where("x <> y").toDF("a", "b").distinct(), "new-links")
        if edges.isEmpty():
            return
        merged = self.ws.save(connected_components(edges, self.ws).toDF("label", "new"), "merged")
        ids = old.unionByName(merged.join(old.hint("merge"), merged["label"] == old["id"], "left_anti").select(F.col("label").alias("id"), "label"))
        ids = self.ws.save(ids, "ids")
        renamed = self.ws.save(ids.groupBy("label").agg(F.count("*").alias("rows")).join(merged.hint("merge"), "label", "left").select("label", "rows", F.coalesce("new", "label").alias("new")), "renamed")
        self.label = self.ws.save(lookup_join(ids, renamed, ["label"], "rows").select("id", F.col("new").alias("label")), "labels")
        self.ws.drop(old, edges, merged, ids, renamed)

    def labelled(self, rows: DataFrame) -> DataFrame:
        named = rows.join(self.label.toDF("id", "label_").hint("merge"), "id", "left")
        return named.withColumn("label", F.coalesce("label_", "id")).drop("label_")

    def look_at_pivots(self, faced: DataFrame, more: DataFrame | None = None) -> DataFrame:
        """Ask every member's distance to its region's pivot, link, and return what is left of the regions.

        faced(g, id, n, at, pivot, np, ap, members) -> (g, id, n, at, label, outer, low, high, was): bounds of
        d(id, pivot), whether the member is outside the pivot's component, and the region's size before.
        ``more``: pairs (x, y) that are linked anyway.
        """
        ws = self.ws
        window = (F.least("n", "np") * 10 >= F.greatest("n", "np") * 8) & (9 * F.least(F.col("n") - F.col("at"), F.col("np") - F.col("ap")) >= 4 * (F.col("n") + F.col("np")))
        asked = ws.save(faced.where("id <> pivot").where(window).select(F.col("id").alias("x"), F.col("pivot").alias("y"), F.col("n").alias("nx"), F.col("np").alias("ny")).distinct(), "asked")
        answers = self.answer(asked)
        self.link(answers, more)
        # Of two members none is left to compare. The pivot's component is its cell; a region all in one cell is done.
        named = ws.save(self.labelled(faced.where("members > 2").select("g", "id", "n", "at", "pivot", "np", "members")), "named")
        cells = named.groupBy("g").agg(F.max("members").alias("members"), F.min("label").alias("l1"), F.max("label").alias("l2"), F.max(F.when(F.col("id") == F.col("pivot"), F.col("label"))).alias("home")).where("l1 < l2")
        open_ = ws.save(cells.select("g", "members", "home"), "open")
        rows = lookup_join(named.drop("members"), open_, ["g"], "members")
        # A request without a link is beyond r; where none was answered, sizes bound the distance too.
        d = answers.select(F.col("x").alias("id"), F.col("y").alias("pivot"), (1 - F.col("both") / (F.col("nx") + F.col("ny") - F.col("both"))).alias("d")).groupBy("id", "pivot").agg(F.min("d").alias("d"))
        at_pivot = (F.col("id") == F.col("pivot")) & (F.col("n") == F.col("np"))
        placed = ws.save(
            rows.join(d.hint("merge"), ["id", "pivot"], "left").select(
                "g", "id", "n", "at", "pivot", "np", "label", "members", (F.col("label") != F.col("home")).alias("outer"),
                F.when(at_pivot, 0.0).otherwise(F.coalesce("d", 1 - F.least("n", "np") / F.greatest("n", "np"))).alias("low"),
                F.when(at_pivot, 0.0).otherwise(F.coalesce("d", F.lit(1.0))).alias("high"),
            ),
            "placed",
        )
        nearest = ws.save(placed.where("outer").groupBy("g").agg(F.min("low").alias("nearest"), F.max("members").alias("was")), "nearest")
        # The pivot itself is answered; of its cell only the boundary goes on.
        left = lookup_join(placed.drop("members"), nearest, ["g"], "was").where(f"NOT (id = pivot AND n = np) AND (outer OR high >= nearest - {R} - 1e-9)")
        out = ws.save(left.select("g", "id", "n", "at", "label", "outer", "low", "high", "was"), "left")
        ws.drop(asked, answers, named, open_, placed, nearest)
        return out

    def leaves(self, rows: DataFrame) -> None:
        """rows(g, id, n, at, low, high), stored: compare across components what is left, by pairs of blocks."""
        ws = self.ws
        named = ws.save(self.labelled(rows), "leaf-rows")
        per = named.groupBy("g").agg(F.count("*").alias("members"), F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 < l2")
        per = ws.save(per.select("g", "members", F.ceil(F.col("members") / PER_BLOCK).alias("blocks")), "leaf-sizes")
        rows = ws.save(lookup_join(named, per, ["g"], "members").drop("members"), "leaves")
        if rows.isEmpty():
            return
        full = rows.join(self.sizes_of(rows).hint("merge"), ["id", "n"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
        full = full.select("*", other).withColumns({"i": F.least("block", "other"), "k": F.greatest("block", "other")})
        full = full.repartition("g", "i", "k").sortWithinPartitions("g", "i", "k").select("g", "i", "k", "block", "id", "n", "at", "label", "low", "high", "buckets", "digest")
        faced = ws.save(compare_blocks(full).distinct(), "faced")
        ws.drop(named, per, rows)
        self.link(self.verify(faced))

    def run(self) -> None:
        rows = self.regions()
        # A text whose set its task had seen shares the first one's component.
        copies = self.profile.where("id <> first").select(F.col("id").alias("x"), F.col("first").alias("y"))
        left = self.look_at_pivots(rows, copies)
        self.ws.drop(rows)
        parts = []
        first = F.when(F.col("outer"), F.struct("at", "n", "id"))
        while True:
            # A region goes on while it is large and its last pivot took a quarter of it away.
            parts.append(left.select("g", "id", "n", "at", "low", "high", "was"))
            go_on = (F.min("label") < F.max("label")) & (F.count("*") > LEAF) & (4 * F.count("*") <= 3 * F.max("was"))
            big = self.with_pivots(left, first, go_on)
            if big.isEmpty():
                break
            done = big.select("g").distinct()
            parts[-1] = self.ws.save(parts[-1].join(done.hint("merge"), "g", "left_anti"), "leaf-part")
            left = self.look_at_pivots(big.select("g", "id", "n", "at", "pivot", "np", "ap", "members"))
        rest = self.ws.save(functools.reduce(DataFrame.unionByName, parts).drop("was"), "rest")
        self.leaves(rest)




def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links).

    Ids are integers. Null and wordless texts have an empty set and link with nothing; rows with a
    null id are returned with a null component and link with nothing. Rows that repeat an
    id are one node, with the links of each of its texts. Empty table: no rows.
    """
    ws = Workspace(docs.sparkSession, "jaccard")
    rows = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    join = Join(rows.where("id IS NOT NULL"), ws)
    join.run()
    node = join.profile.select("id", "n")
    counted = ws.save(node.groupBy("id").agg(F.count("*").alias("rows")).join(join.label.hint("merge"), "id", "left").select("id", "rows", F.coalesce("label", "id").alias("component_id")), "components")
    done = lookup_join(node, counted, ["id"], "rows").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    nameless = rows.where("id IS NULL")
    return done.unionByName(profiles(nameless, np.zeros(1 << COUNTERS_BITS, dtype=np.int64)).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the smallest of its component, and those with a null id, which link with nothing."""
    stay = near_components(docs, id_col, text_col).where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__stay")).distinct()
    return docs.join(stay, docs[id_col] == stay["__stay"], "left_semi").unionByName(docs.where(docs[id_col].isNull()))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_components(docs)


#: Links by counts of common shingles, components by walking them.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM p),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
     l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)),
     u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
     r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.doc_id WHERE r.root < u.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(root) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id
"""
