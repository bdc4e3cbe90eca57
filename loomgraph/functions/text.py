"""Names: normalising, guards and similarity, all as native expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.schema import FUZZY

#: Longest name whose subsequence state fits a long without overflow.
NATIVE_LENGTH = 61


def strip_u(c: Column) -> Column:
    """Trim all Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_name(c: Column) -> Column:
    """Strip, lower-case, drop quotes at the ends, then fold runs of white space; not stripped again after the quotes."""
    unquoted = F.regexp_replace(F.lower(strip_u(c)), "^[\"']+|[\"']+$", "")
    return F.regexp_replace(unquoted, r"(?U)\s+", " ")


def is_email(c: Column) -> Column:
    return c.contains("@") & c.contains(".")


def is_digits(c: Column) -> Column:
    return c.rlike(r"^\p{Nd}+$")


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")), " ")


def lcs_native(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, one bit per character of ``a`` (Hyyrö 2004)."""
    m = F.length(a)
    full = F.call_function("shiftleft", F.lit(1).cast("long"), m) - 1
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i - 1)
    zero = F.lit(0).cast("long")
    places = lambda c: F.aggregate(F.sequence(F.lit(1), m), zero, lambda acc, i: acc.bitwiseOR(F.when(F.substring(a, i, F.lit(1)) == c, bit(i)).otherwise(zero)))

    def step(s: Column, c: Column) -> Column:
        u = s.bitwiseAND(places(c))
        return (s + u).bitwiseOR(s - u).bitwiseAND(full)

    left = F.aggregate(F.filter(F.split(b, ""), lambda x: x != ""), full, step)
    return F.when((m == 0) | (F.length(b) == 0), F.lit(0)).otherwise(m - F.bit_count(left))


def lcs_plain(x: str, y: str) -> int:
    row = [0] * (len(y) + 1)
    for c in x:
        last = 0
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
    return row[-1]


def similar(x: Column, y: Column, threshold: float = FUZZY) -> Column:
    """Indel similarity of two token-sorted names of at most NATIVE_LENGTH characters of at least ``threshold``; a bounded Levenshtein goes first."""
    slack = round((1 - threshold) * 1000)
    total = F.length(x) + F.length(y)
    most = F.floor(total * slack / 1000).cast("int")
    close = F.call_function("levenshtein", x, y, most) >= 0
    return close & (1000 * (total - 2 * lcs_native(x, y)) <= slack * total)


def similar_long(x: Column, y: Column, threshold: float = FUZZY) -> Column:
    """As ``similar`` for names of any length, in Arrow batches."""
    slack = round((1 - threshold) * 1000)

    @F.pandas_udf("boolean")
    def long_names(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([1000 * (len(p) + len(q) - 2 * lcs_plain(p, q)) <= slack * (len(p) + len(q)) for p, q in zip(x, y, strict=True)], dtype=bool)

    return long_names(x, y)
