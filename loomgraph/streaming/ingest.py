"""Incremental ingestion: first message per body, across micro-batches, with a ledger."""

from __future__ import annotations

import signal
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.functions.mail import parse_mail
from loomgraph.operators.content import firsts
from loomgraph.operators.extract import Extractor, extract
from loomgraph.schema import MAIL_RAW


def read_mail_stream(spark: SparkSession, folder: str, files_per_batch: int | None = 1) -> DataFrame:
    """Parquet files of (file, message) as they come, by the time of their last change; None: all that are there in one batch."""
    stream = spark.readStream.schema(MAIL_RAW)
    return (stream if files_per_batch is None else stream.option("maxFilesPerTrigger", files_per_batch)).parquet(folder)


def ingest_batch(batch: DataFrame, batch_id: int, table: str, extractor: Extractor | None = None, wait: Callable[[str, int], float] | None = None, done_before: int | None = None) -> None:
    """Parse, drop what the table has by message id or body, and write a partition of this batch's own.

    Message ids count as done if a batch before ``done_before`` has them (None: any earlier batch), so that a
    job cut into batches keeps messages that share an id, as one batch does. Of equal bodies the smallest file stays, once.
    The partition is named by the batch and overwritten, so a repeated batch changes nothing. With an
    extractor every new message is given to it, and its last answer is kept; where that is none the message
    failed, which counts as done like any other status.
    """
    spark = batch.sparkSession
    keyed = parse_mail(batch).select("message_id", "file_path", "sender", "subject", "date", "body", "body_hash").persist()  # read once, used twice
    best = firsts(keyed, "body_hash", "file_path").select("body_hash", F.col("first").alias("file_path"))
    new = keyed.join(best, ["body_hash", "file_path"], "left_semi")
    try:
        past = spark.read.parquet(table).where(F.col("batch") < batch_id)
        done = past if done_before is None else past.where(F.col("batch") < done_before)
        new = new.join(done.select("message_id").distinct(), "message_id", "left_anti").join(past.select("body_hash").distinct(), "body_hash", "left_anti")
    except Exception as e:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    new = new.dropDuplicates(["body_hash"])  # a file that came twice
    if extractor is None:
        told = new.withColumns({"status": F.lit("processed"), "answer": F.lit(None).cast("string"), "attempts": F.lit(0)})
    else:
        answers = extract(new.select("file_path", F.concat(F.lit("\n\n"), "body").alias("prompt")), extractor, "file_path", wait=wait)
        told = new.join(answers.select("file_path", F.col("raw").alias("answer"), "attempts", "error"), "file_path")
        told = told.withColumn("status", F.when(F.col("error").isNull(), "processed").otherwise("failed")).drop("error")
    told.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
    keyed.unpersist()


def ingest_stream(stream: DataFrame, table: str, checkpoint: str, extractor: Extractor | None = None, wait: Callable[[str, int], float] | None = None, done_before: int | None = None) -> StreamingQuery:
    """Run over what is there and stop; call again to go on from the checkpoint."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, i: ingest_batch(df, i, table, extractor, wait, done_before)).start()


def stop_gracefully(query: StreamingQuery) -> Callable[[int, object], None]:
    """Let SIGINT and SIGTERM stop the query, whose finished batches stay; a second one ends the process. Returns the handler."""
    asked = []

    def handle(number: int, frame: object) -> None:
        if asked:
            raise KeyboardInterrupt
        asked.append(number)
        query.stop()

    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, handle)
    return handle


def compact(spark: SparkSession, table: str, target: str) -> None:
    """The whole ledger in few files under one batch, that of its last, in a new place: partitions of old batches add up."""
    past = spark.read.parquet(table)
    last = past.agg(F.max("batch")).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    past.drop("batch").repartition(parts, "message_id").write.mode("overwrite").parquet(f"{target}/batch={last}")


def ledger(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table)


def progress(query: StreamingQuery) -> list[dict]:
    """Rows and rates per batch."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p.get("processedRowsPerSecond", 0.0)} for p in map(dict, query.recentProgress)]
