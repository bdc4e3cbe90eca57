"""Content dedup of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.skew import lookup_join
from loomgraph.operators.workspace import Workspace


def firsts(df: DataFrame, hash_col: str, order_col: str) -> DataFrame:
    """(hash, first, copies): the smallest order per hash. Copies shrink before the shuffle, so no hash is hot."""
    return df.groupBy(F.col(hash_col).alias("body_hash")).agg(F.min(order_col).alias("first"), F.count("*").alias("copies"))


def dedup(df: DataFrame, hash_col: str = "body_hash", order_col: str = "id") -> DataFrame:
    """Rows that come first of their hash; all empty bodies share one. The join is on the unique order."""
    return df.join(firsts(df, hash_col, order_col).select(F.col("first").alias(order_col)), order_col, "left_semi")


def duplicate_pairs(df: DataFrame, hash_col: str = "body_hash", order_col: str = "id") -> DataFrame:
    """(duplicate, original) for every row that is not first."""
    ws = Workspace(df.sparkSession, "content-dedup")
    keyed = ws.save(df.select(F.col(hash_col).alias("body_hash"), F.col(order_col).alias("o")), "keys")
    f = ws.save(firsts(keyed, "body_hash", "o").where("copies > 1"), "firsts")
    return lookup_join(keyed, f, ["body_hash"], "copies").where("o <> first").select(F.col("o").alias("duplicate"), F.col("first").alias("original"))


def not_done(df: DataFrame, ledger: DataFrame, key: str = "message_id") -> DataFrame:
    """Rows whose key the ledger does not have, whatever its status: failed ones count as done."""
    return df.join(ledger.select(key).distinct(), key, "left_anti")
