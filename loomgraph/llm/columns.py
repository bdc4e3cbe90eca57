"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in; the rest, translate."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the columns an operator works on, under its own names: others may be called anything."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in names.items()))


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` and a column that is computed once per row: as a generator's output the optimizer can't repeat it inside lambdas."""
    return df.select("*", F.explode(F.array(value)).alias(name))
