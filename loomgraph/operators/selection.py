"""Communication clusters and subset selection."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import strip_u

TOP_SENDERS, SEED_SENDERS, TOP_PAIRS, ROUNDS, LEAST_SCORE, FEW = 30, 20, 20, 15, 5, 1200


def network_rows(mail: DataFrame) -> DataFrame:
    """(sender, recipient, mailbox) per address of To and Cc that has an @, repeats kept; mail without a sender is left out."""
    every = F.split(F.concat_ws(",", "to_raw", "cc_raw"), ",")
    return mail.where("sender <> ''").select("sender", F.explode(F.filter(every, lambda a: F.contains(a, F.lit("@")))).alias("r"), "mailbox").select("sender", F.lower(strip_u(F.col("r"))).alias("recipient"), "mailbox")


def mailbox_counts(mail: DataFrame) -> DataFrame:
    """(mailbox, n, senders) of mail that has a sender: messages and distinct senders."""
    return mail.where("sender <> ''").groupBy("mailbox").agg(F.count("*").alias("n"), F.count_distinct("sender").alias("senders"))


def network_edges(comm: DataFrame) -> DataFrame:
    """Directed (sender, recipient, n) over addresses with an @, repeats counted."""
    return comm.where(F.col("recipient").contains("@") & (F.col("sender") != "")).groupBy("sender", "recipient").agg(F.count("*").alias("n"))


def top_senders(comm: DataFrame, domain: str = "@enron.com", top: int = TOP_SENDERS) -> DataFrame:
    return comm.where(F.col("sender").contains(domain)).groupBy("sender").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sender").limit(top)


def pair_scores(edges: DataFrame, senders: DataFrame) -> DataFrame:
    """Undirected scores among ``senders`` (at most 20 rows, hence broadcast); a pair may be one address twice."""
    few = senders.orderBy(F.desc("n"), "sender").limit(SEED_SENDERS).select("sender")
    both = edges.join(F.broadcast(few), "sender", "left_semi").join(F.broadcast(few.withColumnRenamed("sender", "recipient")), "recipient", "left_semi")
    return both.groupBy(F.least("sender", "recipient").alias("a"), F.greatest("sender", "recipient").alias("b")).agg(F.sum("n").alias("score"))


def top_pairs(pairs: DataFrame, top: int = TOP_PAIRS) -> DataFrame:
    return pairs.orderBy(F.desc("score"), "a", "b").limit(top)


def greedy_cluster(pairs: DataFrame, rounds: int = ROUNDS, least: int = LEAST_SCORE) -> list[str]:
    """Grow from the best pair by the candidate with the highest sum of scores; ties go to the smallest address.

    ``pairs`` has at most 20 x 20 rows by construction, which is what the driver gets.
    """
    score = {(r["a"], r["b"]): r["score"] for r in pairs.orderBy(F.desc("score"), "a", "b").limit(SEED_SENDERS * SEED_SENDERS).collect()}
    if not score:
        return []
    best = max(score, key=lambda p: (score[p], [-ord(c) for c in p[0]]))
    cluster = list(dict.fromkeys(min(p for p in score if score[p] == score[best])))
    names = sorted({x for p in score for x in p})
    for _ in range(rounds):
        gains = {c: sum(score.get((min(c, m), max(c, m)), 0) for m in cluster) for c in names if c not in cluster}
        if not gains:
            break
        pick = min(gains, key=lambda c: (-gains[c], c))
        if gains[pick] <= least:
            break
        cluster.append(pick)
    return cluster


def select_subset(mail: DataFrame, cluster: list[str]) -> DataFrame:
    """Mail of mailboxes that hold a cluster sender, from a cluster sender, or with a cluster address inside To."""
    boxes = mail.where(F.col("sender").isin(cluster)).select("mailbox").distinct()
    to = F.lower("to_raw")
    hit = F.col("sender").isin(cluster)
    for a in cluster:
        hit = hit | to.contains(a)
    marked = mail.join(boxes.withColumn("relevant", F.lit(True)), "mailbox", "left")
    return marked.where(F.coalesce("relevant", F.lit(False)) | hit).drop("relevant")


def trim_subset(mail: DataFrame, most: int = 2000, first: str = "2000-06-01", last: str = "2001-12-31") -> DataFrame:
    """Only when there are more than ``most``: the date window, then the first ``most`` by date."""
    n = mail.limit(most + 1).count()
    if n < FEW:
        warnings.warn(f"only {n} messages", stacklevel=2)
    if n <= most:
        return mail
    return mail.where(F.col("date").between(F.to_timestamp(F.lit(first)), F.to_timestamp(F.lit(last)))).orderBy("date", "id").limit(most)


def subset_stats(mail: DataFrame) -> DataFrame:
    return mail.agg(
        F.count("*").alias("n"), F.count_distinct("sender").alias("senders"), F.count_distinct("subject").alias("subjects"), F.count_if("is_forward").alias("forwards"), F.count_if("is_reply").alias("replies"),
        F.round(F.avg(F.col("is_reply").cast("int")), 6).alias("reply_share"), F.round(F.avg(F.length("body")), 6).alias("mean_len"),
    )
