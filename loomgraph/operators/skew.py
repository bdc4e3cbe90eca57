"""Joins that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/SHARE of the rows. Fewer than SHARE keys
#: can, whatever the data, which bounds the broadcast side.
SHARE = 1000
#: Below so many rows a key is never worth special care.
LEAST = 64


def hot_keys(right: DataFrame, keys: list[str], rows: str, share: int = SHARE) -> list[int]:
    """Hashes of the hot keys of ``right``: fewer than ``share``."""
    total, most = right.agg(F.sum(rows), F.max(rows)).first()
    limit = max((total or 0) // share, LEAST)
    if not total or most <= limit:
        return []
    return [r[0] for r in right.where(F.col(rows) > limit).select(F.xxhash64(*keys)).collect()]


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, share: int = SHARE) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per key.

    ``rows`` is a column of ``right`` that counts the left rows of the key (or
    more).  Rows of hot keys meet a broadcast of fewer than ``share`` rows and are
    never shuffled; all others take a shuffle join.  Both sides are split by the hash
    of the key, so a cold key that shares a hot one's hash is treated as hot as well.
    With hot keys both inputs are read twice: they should be stored tables or cheap scans.
    """
    hot = hot_keys(right, keys, rows, share)
    if not hot:
        return left.join(right.hint("merge"), keys)
    is_hot = F.xxhash64(*keys).isin(hot)
    cold = left.where(~is_hot).join(right.where(~is_hot).hint("merge"), keys)
    return left.where(is_hot).join(F.broadcast(right.where(is_hot)), keys).unionByName(cold)
