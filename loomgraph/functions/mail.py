"""RFC-822 messages parsed with native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import strip_u


def split_message(df: DataFrame, message: str = "message") -> DataFrame:
    """Add head (folded lines joined) and body: cut at the first blank line."""
    m = F.regexp_replace(F.col(message), "\r\n", "\n")
    at = F.instr(m, F.lit("\n\n"))
    head = F.when(F.startswith(m, F.lit("\n")), F.lit("")).when(at > 0, F.substring(m, F.lit(1), at - 1)).otherwise(m)
    body = F.when(F.startswith(m, F.lit("\n")), F.substring(m, F.lit(2), F.length(m))).when(at > 0, F.substring(m, at + 2, F.length(m))).otherwise(F.lit(""))
    return df.withColumns({"head": F.regexp_replace(head, "\n[ \t]+", " "), "body": body})


def header(name: str) -> Column:
    """A header's first value, empty if missing; names are matched in any case."""
    return F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*)$", 1)


def addresses(c: Column) -> Column:
    """Cut at every comma (quoted ones too), stripped, lower-cased, empty ones dropped."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.lower(strip_u(x))), lambda x: x != "")


def mail_date(c: Column) -> Column:
    """Weekday and zone comments are ignored; null if it is no date."""
    core = F.regexp_extract(c, r"\d{1,2} +[A-Za-z]{3}[a-z]* +\d{4} +\d{1,2}:\d{2}(:\d{2})?( *[+-]\d{4})?", 0)
    plain = F.regexp_replace(core, r"^(\d+) +([A-Za-z]{3})[a-z]* +(\d+) +([\d:]+) *([+-]\d+)?$", "$1 $2 $3 $4 $5")
    return F.try_to_timestamp(F.trim(plain), F.lit("d MMM yyyy H:mm[:ss][ Z]"))


def is_forward(subject: Column, body: Column) -> Column:
    """False for an empty body whatever the subject says."""
    low = F.lower(subject)
    said = low.contains("fw:") | low.contains("fwd:") | F.left(F.lower(body), F.lit(500)).contains("--- forwarded")
    return F.when(body != "", said).otherwise(F.lit(False))


def body_hash(body: Column) -> Column:
    return F.when(body == "", F.lit("")).otherwise(F.sha2(body, 256))


def parse_mail(raw: DataFrame, file: str = "file", message: str = "message") -> DataFrame:
    """One artifact per message; rows without message are dropped. Ids derive from the message id and file."""
    m = split_message(raw.where(F.col(message).isNotNull()), message)
    subject = header("Subject")
    return m.select(
        F.sha2(F.concat_ws("\u0001", header("Message-ID"), F.col(file)), 256).alias("id"),
        header("Message-ID").alias("message_id"),
        F.col(file).alias("file_path"),
        F.lower(strip_u(header("From"))).alias("sender"),
        F.nullif(header("X-From"), F.lit("")).alias("sender_name"),
        addresses(header("To")).alias("recipients"),
        addresses(header("Cc")).alias("cc"),
        subject.alias("subject"),
        mail_date(header("Date")).alias("date"),
        "body",
        body_hash(F.col("body")).alias("body_hash"),
        is_forward(subject, F.col("body")).alias("is_forward"),
        F.startswith(F.lower(subject), F.lit("re:")).alias("is_reply"),
        F.split_part(F.col(file), F.lit("/"), F.lit(1)).alias("mailbox"),
        header("Bcc").alias("bcc_raw"),
        header("To").alias("to_raw"),
        header("Cc").alias("cc_raw"),
        header("X-Folder").alias("x_folder"),
        header("X-Origin").alias("x_origin"),
        header("X-To").alias("x_to"),
    )


def header_projection(raw: DataFrame, file: str = "file", message: str = "message") -> DataFrame:
    """Headers and body of every row as they stand; a row without a message has an error instead."""
    names = {"from": "From", "to": "To", "cc": "Cc", "bcc": "Bcc", "subject": "Subject", "date": "Date", "x_from": "X-From", "x_to": "X-To", "x_folder": "X-Folder", "x_origin": "X-Origin"}
    m = split_message(raw, message)
    there = F.col(message).isNotNull()
    return m.select(F.col(file).alias("file"), *(F.when(there, header(h)).alias(k) for k, h in names.items()), F.when(there, F.col("body")).alias("body"), F.when(~there, F.lit("no message")).alias("error"))


def prompt(a: DataFrame) -> Column:
    """The text an extractor gets: at most 10 recipients, 5 copies and 2000 characters of body."""
    return F.concat(
        F.lit("Find the entities and claims of this message.\nFrom: "), "sender", F.lit(" ("), F.coalesce("sender_name", F.lit("unknown")), F.lit(")\nTo: "), F.array_join(F.slice("recipients", 1, 10), ", "),
        F.lit("\nCc: "), F.array_join(F.slice("cc", 1, 5), ", "), F.lit("\nSubject: "), "subject", F.lit("\nDate: "), F.coalesce(F.date_format("date", "yyyy-MM-dd HH:mm:ss"), F.lit("none")),
        F.lit("\nForward: "), F.col("is_forward").cast("string"), F.lit("\nReply: "), F.col("is_reply").cast("string"), F.lit("\n\n"), F.left(F.col("body"), F.lit(2000)),
    )
