"""Exact dedup: 128-bit content hash groups, bytes compared inside them. Native SQL functions only.

The first scan stores (id, MD5, SHA-256) per row; from these alone come the hashes that
more than one row has, as a bitmap of fixed size.  A text whose hash is not in it has no
copy and is not moved.  The second scan takes the others and aggregates them by (MD5, text):
Spark's hash aggregation compares the texts' bytes within a hash, so texts that
collide under the 128-bit hash end in different groups, and copies shrink to one row
per map task before anything is shuffled.  Their ids then look up the group by (MD5,
SHA-256); a group that holds a large share of all rows meets a bounded broadcast and
is not shuffled (see ``lookup_join``).  Where more hashes repeat than the bitmap can tell apart more
texts are compared, down to all of them: results and plan stay the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.columns import ascii_lower, pick
from loomgraph.operators.skew import lookup_join
from loomgraph.operators.workspace import Workspace


#: Bits of the bitmap of repeated hashes, a multiple of CHUNK: 8 MB are broadcast, whatever the input.
BITS = 1 << 26
#: Bits of a row of it, as ``bitmap_construct_agg`` makes them.
CHUNK = 1 << 15

Hash = Callable[[Column], Column]


def md5_bytes(c: Column) -> Column:
    return F.unhex(F.md5(c))


def _place(hash_: Column) -> Column:
    return F.pmod(F.xxhash64(hash_), F.lit(BITS))


def _repeated(ids: DataFrame) -> DataFrame:
    """Bitmap (__chunk, __bits) of the places of hashes that several rows of ``ids`` have; rows of at most CHUNK bits."""
    places = ids.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select(_place(F.col("hash")).alias("p"))
    chunks = places.select(F.floor(F.col("p") / CHUNK).alias("__chunk"), (F.col("p") % CHUNK).alias("at")).repartition("__chunk")
    return chunks.groupBy("__chunk").agg(F.bitmap_construct_agg("at").alias("__bits"))


def _with_repeats(df: DataFrame, hash_: Column, bits: DataFrame) -> DataFrame:
    """``df`` and ``__again``: never false for a row whose hash another row has."""
    at = F.col("__place") % CHUNK
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = df.withColumn("__place", _place(hash_)).join(F.broadcast(bits), F.floor(F.col("__place") / CHUNK) == F.col("__chunk"), "left")
    return met.withColumn("__again", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("__place", "__chunk", "__bits")


def _parts(docs: DataFrame, id_col: str, text_col: str, keep: str, normalise: Hash, content_hash: Hash) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows without a copy, rows that may have one, bitmap); rows: id, keep_id, group_size, text_sha256."""
    ws = Workspace(docs.sparkSession, "exact-dedup")
    base = pick(docs, id=id_col, text=text_col).withColumn("text", normalise(F.coalesce("text", F.lit(""))))
    ids = ws.save(base.select("id", content_hash(F.col("text")).alias("hash"), F.sha2("text", 256).alias("text_sha256")), "ids")
    bits = ws.save(_repeated(ids), "repeated")
    stay = F.min("id") if keep == "min" else F.max("id")
    hashed = base.withColumn("hash", content_hash(F.col("text")))
    groups = ws.save(
        _with_repeats(hashed, F.col("hash"), bits).where("__again").groupBy("hash", "text")
        .agg(stay.alias("keep_id"), F.count("*").alias("group_size"))
        .select("hash", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"),
        "groups",
    )
    told = _with_repeats(ids, F.col("hash"), bits)
    columns = ("id", "keep_id", "group_size", "text_sha256")
    alone = told.where("NOT __again").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    shared = lookup_join(told.where("__again").drop("__again"), groups, ["hash", "text_sha256"], "group_size").select(*columns)
    return alone, shared, bits


def _kept() -> Column:
    return F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise: Hash = lambda c: c, content_hash: Hash = md5_bytes) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep``: "min" keeps the smallest id of a group, "max" the largest.
    Null text counts as empty; texts of any length are compared whole. A null id stays in its group and is never kept unless
    the whole group has none (keep_id is then null and kept false). Repeated rows of
    the id that stays are all marked kept; ``group_size`` counts rows. Empty input: no
    rows. Other columns are ignored. ``content_hash`` exists so that tests can force collisions.
    """
    alone, shared, _ = _parts(docs, id_col, text_col, keep, normalise, content_hash)
    return alone.unionByName(shared).select(F.col("id").alias(id_col), "keep_id", "group_size", _kept().alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise: Hash = lambda c: c) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (ids are taken to be unique).

    Rows without a copy are not moved; the others are joined with the ids that stay, which are unique, so no task is hot.
    Of rows with a null id one stays per text that no row with an id has: the one with the
    smallest hash of its columns. Null text counts as empty; empty input: no rows.
    """
    alone, shared, bits = _parts(docs, id_col, text_col, keep, normalise, md5_bytes)
    text = normalise(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    told = _with_repeats(docs.where(docs[id_col].isNotNull()), md5_bytes(text), bits)
    kept = shared.where(_kept()).select(F.col("id").alias("__kept_id")).distinct()
    copied = told.where("__again").drop("__again")
    named = told.where("NOT __again").drop("__again").unionByName(copied.join(kept, copied[id_col] == kept["__kept_id"], "left_semi"))
    nameless = docs.where(docs[id_col].isNull())
    if nameless.isEmpty():
        return named
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    firsts = nameless.groupBy(text.alias("__text")).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("__row"))
    lone = alone.unionByName(shared).where(F.col("keep_id").isNull()).select("text_sha256").distinct()
    return named.unionByName(firsts.join(lone, F.sha2("__text", 256) == F.col("text_sha256"), "left_semi").select("__row.*"))


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs, keep="max", normalise=ascii_lower)


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
