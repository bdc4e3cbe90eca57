"""Corpus profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Half-open bounds of the length buckets.
LENGTH_BOUNDS = [0, 100, 500, 1000, 5000, 10000, 50000]


def value_counts(df: DataFrame, value: Column, name: str, top: int | None = None) -> DataFrame:
    out = df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), name).limit(top)


def folder_type(c: Column) -> Column:
    """Last segment of a backslash path."""
    return F.element_at(F.split(c, r"\\"), -1)


def length_stats(df: DataFrame, body: str = "body") -> DataFrame:
    n = F.length(body)
    return df.agg(F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.round(F.avg(n), 6).alias("mean_len"), F.median(n).alias("median_len"), F.round(F.stddev_samp(n), 6).alias("std_len"))


def length_buckets(df: DataFrame, body: str = "body") -> DataFrame:
    """Every bucket, empty ones too, with count and percentage."""
    n = F.length(body)
    bucket = F.lit(0)
    for k, low in enumerate(LENGTH_BOUNDS):
        bucket = F.when(n >= low, F.lit(k)).otherwise(bucket) if k == 0 else F.when(n >= low, k).otherwise(bucket)
    counted = df.where(n.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("c"))
    all_ = df.sparkSession.range(len(LENGTH_BOUNDS)).select(F.col("id").cast("int").alias("bucket"))
    joined = all_.join(counted, "bucket", "left").select("bucket", F.coalesce("c", F.lit(0)).alias("n"))
    total = counted.agg(F.sum("c").alias("total"))
    # One row meets seven.
    return joined.join(F.broadcast(total), F.lit(True)).select("bucket", "n", F.round(100 * F.col("n") / F.greatest(F.coalesce("total", F.lit(0)), F.lit(1)), 6).alias("pct"))


def date_range(df: DataFrame, date: str) -> DataFrame:
    low, high = F.min(date), F.max(date)
    return df.agg(low.alias("first"), high.alias("last"), F.floor((F.unix_timestamp(high) - F.unix_timestamp(low)) / 86400).alias("days"))


def monthly(df: DataFrame, date: str, top: int = 15) -> DataFrame:
    return value_counts(df.where(F.col(date).isNotNull()), F.date_format(date, "yyyy-MM"), "month", top)


def patterns(mail: DataFrame) -> DataFrame:
    """Counts and percentages of forwards, replies and quoted originals."""
    tests = {
        "forward_subject": F.col("subject").rlike("(?i)fw:|fwd:"),
        "reply_subject": F.col("subject").rlike("(?i)re:"),
        "original_message": F.col("body").rlike(r"(?i)-----\s*Original Message"),
        "forwarded_by": F.col("body").rlike(r"(?i)-----\s*Forwarded by"),
    }
    sums = mail.agg(F.count("*").alias("total"), *(F.count_if(t).alias(k) for k, t in tests.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("pattern"), F.col(k).alias("n"), F.round(100 * F.col(k) / F.greatest("total", F.lit(1)), 6).alias("pct")) for k in tests))).alias("r")).select("r.*")


def recipient_stats(mail: DataFrame) -> DataFrame:
    """Counts by comma, empty segments included; 0 for a blank field."""
    n = F.when(F.trim("to_raw") != "", F.size(F.split("to_raw", ","))).otherwise(0)
    some = lambda c: F.count_if(F.col(c).isNotNull() & (F.col(c) != ""))
    return mail.agg(F.round(F.avg(n), 6).alias("avg_recipients"), F.max(n).alias("max_recipients"), some("cc_raw").alias("with_cc"), some("bcc_raw").alias("with_bcc"))
