"""WARC: archives as whole-file gzip streams, normalised to one gzip member per record.

``write_archives`` makes archives the way careless tools do: one gzip stream over
the whole file, which cannot be entered in the middle.  ``normalise_archives``
inflates each stream once, in pieces, rewrites every record as a gzip member of its
own and writes a sidecar index of offsets.  ``read_records`` seeks by that index.
Archives roll over at a byte size, so a task holds one record at a time and tasks
stay alike however large the input is.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.columns import pick
from loomgraph.llm.sieve import passes, sieve
from loomgraph.llm.storage import open_fs
from loomgraph.operators.skew import lookup_join
from loomgraph.operators.workspace import Workspace
from loomgraph.llm.worker import lean

#: Uncompressed bytes after which a new archive begins.
ROLL_BYTES = 64 << 20
READ_BYTES = 1 << 20


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record, or a revisit record that holds the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    # Header values are single lines; a url is kept as it is but for line breaks and blanks at its ends.
    target = " ".join((url or "").split("\r")).replace("\n", " ").strip()
    own = f"urn:uuid:{uuid.uuid4()}" if record_id is None else f"urn:page:{record_id}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{own}>", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines are joined."""
    out: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            k, _, v = line.partition(":")
            last = k.strip().lower()
            out[last] = v.strip()
    return out


def inflate(source, size: int = READ_BYTES) -> Iterator[bytes]:
    """Pieces of at most ``size`` bytes of a gzip stream, whether it has one member or many. A member cut off raises."""
    d, begun = zlib.decompressobj(31), False
    while data := source.read(size):
        while data:
            begun = True
            if piece := d.decompress(data, size):
                yield piece
            data = d.unconsumed_tail
            if d.eof:
                data, d, begun = d.unused_data, zlib.decompressobj(31), False
    while begun and not d.eof and (piece := d.decompress(b"", size)):
        yield piece
    if begun and not d.eof:
        raise ValueError("a gzip stream is cut off")


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) one after another from inflated pieces, holding one record.

    Blank lines before a record are skipped. A record cut off at the end raises.
    """
    have, done = bytearray(), False

    def more() -> bool:
        nonlocal done
        piece = next(pieces, None)
        if piece is None:
            done = True
            return False
        have.extend(piece)
        return True

    while True:
        while not have.lstrip(b"\r\n") and more():
            pass
        start = len(have) - len(have.lstrip(b"\r\n"))
        if start:
            del have[:start]
        if not have:
            return
        at = 0
        while (end := have.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(have) - 3)
            if not more():
                raise ValueError("a WARC record ends inside its header")
        headers = parse_headers(bytes(have[:end]))
        whole = end + 4 + int(headers.get("content-length", "0"))
        while len(have) < whole and more():
            pass
        if len(have) < whole:
            raise ValueError("a WARC record ends inside its block")
        yield headers, bytes(have[:whole]) + b"\r\n\r\n"
        del have[:whole]


def _writer(folder: str, roll: int, level: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, root = open_fs(folder)
        filesystem.create_dir(root, recursive=True)
        out = name = gz = None
        size = n = 0
        made = []
        for b in batches:
            for rid, url, html, refers in zip(b["id"], b["url"], b["payload"], b["refers_to"], strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, gz, size, n = filesystem.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                payload = bytes(html)
                rec = record_bytes(rid, url, payload, sha1_base32(payload), refers)
                out.write(gz.compress(rec))
                size, n = size + len(rec), n + 1
                if size >= roll:
                    out.write(gz.flush())
                    out.close()
                    made.append((f"{folder}/{name}", n, size))
                    out = None
        if out is not None:
            out.write(gz.flush())
            out.close()
            made.append((f"{folder}/{name}", n, size))
        if made:
            yield pd.DataFrame(made, columns=["archive", "records", "bytes"])

    return write


def write_archives(records: DataFrame, folder: str, roll: int = ROLL_BYTES, level: int = 1) -> DataFrame:
    """records(id string, url, payload binary, refers_to string) -> (archive, records, bytes).

    Every partition writes archives of about ``roll`` bytes, each one gzip stream.
    """
    return records.select("id", "url", "payload", "refers_to").mapInPandas(lean(_writer(folder, roll, level)), "archive string, records long, bytes long")


def _normaliser(folder: str, level: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, root = open_fs(folder)
        target.create_dir(root, recursive=True)
        for b in batches:
            for archive in b["archive"]:
                source, path = open_fs(archive)
                name = f"{uuid.uuid4().hex}.warc.gz"
                at = n = 0
                with source.open_input_stream(path, compression=None) as src, target.open_output_stream(f"{root}/{name}", compression=None) as out, target.open_output_stream(f"{root}/{name}.idx", compression=None) as idx:
                    for headers, rec in split_records(inflate(src)):
                        gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = gz.compress(rec) + gz.flush()
                        out.write(member)
                        line = {"offset": at, "length": len(member), "id": headers.get("warc-record-id", ""), "type": headers.get("warc-type", "")}
                        idx.write(json.dumps(line, separators=(",", ":")).encode() + b"\n")
                        at, n = at + len(member), n + 1
                yield pd.DataFrame([(f"{folder}/{name}", n, at)], columns=["archive", "records", "bytes"])

    return run


def normalise_archives(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """archives(archive) of any gzip layout -> the same records, a member each, beside ``<archive>.idx``."""
    return archives.select("archive").mapInPandas(lean(_normaliser(folder, level)), "archive string, records long, bytes long")


def read_index(archive: str) -> list[dict]:
    fs, path = open_fs(archive)
    with fs.open_input_stream(path + ".idx", compression=None) as f:
        return [json.loads(x) for x in io.BytesIO(f.read())]


def parse_record(rec: bytes) -> dict:
    """id, type, payload bytes and digest, refers_to. A revisit's come from its HTTP head and header fields."""
    head, _, block = rec.partition(b"\r\n\r\n")
    h = parse_headers(head)
    block = block[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    bare = lambda x: x.removeprefix("<urn:page:").removesuffix(">") if x and not x.startswith("<urn:uuid:") else None
    kind = h["warc-type"]
    length = len(payload) if kind == "response" else int(parse_headers(http).get("content-length", "0"))
    digest = sha1_base32(payload) if kind == "response" else h["warc-payload-digest"].removeprefix("sha1:")
    return {"id": bare(h["warc-record-id"]), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": bare(h.get("warc-refers-to")), "url": h.get("warc-target-uri", ""), "payload": payload if kind == "response" else None}


def _reader(columns: list[str]):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive in b["archive"]:
                fs, path = open_fs(archive)
                rows: list[dict] = []
                held = 0
                with fs.open_input_file(path) as f:
                    for e in read_index(archive):
                        f.seek(e["offset"])
                        r = parse_record(zlib.decompress(f.read(e["length"]), 31))
                        rows.append({k: r[k] for k in columns})
                        held += len(r["payload"] or b"") if "payload" in columns else 64
                        if held > 8 << 20:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return read


RECORD_TYPES = {"id": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "string", "url": "string", "payload": "binary"}


def read_records(archives: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Records of normalised archives, each found by its offset in the sidecar index."""
    columns = columns or list(RECORD_TYPES)
    return archives.select("archive").mapInPandas(lean(_reader(columns)), ", ".join(f"{c} {RECORD_TYPES[c]}" for c in columns))


def mark_revisits(pages: DataFrame, ws: Workspace, least_bytes: int = 0) -> DataFrame:
    """pages(id, url, payload) -> with refers_to: of equal payloads the largest id is the response.

    Payloads of fewer than ``least_bytes`` are always responses, as are those that only pages with
    a null id have. A row is told by its payload and own id alone, so repeated and null ids
    need no care. Equality is by SHA-256 and length. Payloads that no other page has pass by the sieve and
    are not shuffled; the others meet their group's row, those of hot groups by a bounded broadcast.
    """
    spark = pages.sparkSession
    content = {"n": F.octet_length("payload"), "h": F.unhex(F.sha2("payload", 256)), "k": F.xxhash64("payload")}
    long_enough = F.col("n") >= least_bytes
    keyed = pages.withColumns(content).where(long_enough).select("id", "h", "n", "k")
    groups = ws.save(keyed.groupBy("h", "n", "k").agg(F.max("id").alias("keep"), F.count("*").alias("rows")), "groups")
    maybe = passes(spark, sieve(groups.where("rows > 1 AND keep IS NOT NULL").select(F.col("k").alias("id"))), "k")
    rows = pages.withColumns(content).withColumn("maybe", maybe & long_enough)
    once = rows.where("NOT maybe").select("id", "url", "payload", F.lit(None).cast("string").alias("refers_to"))
    met = lookup_join(rows.where("maybe").drop("k"), groups.where(maybe).select("h", "n", "keep", "rows"), ["h", "n"], "rows")
    again = (F.col("rows") > 1) & (F.col("id").isNull() | (F.col("id") != F.col("keep")))
    return once.unionByName(met.select("id", "url", "payload", F.when(again, F.col("keep").cast("string")).alias("refers_to")))


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, roll: int = ROLL_BYTES) -> tuple[DataFrame, Workspace]:
    """Write a WARC record per page, normalise the archives and return (archives, workspace).

    Null html is an empty payload; a null url an empty target. Rows with a null id
    get a record id of their own, which reads back as null. Every row has a record, also where ids or
    rows repeat; repeated rows of a response are all responses. A payload of any length is
    one record, held whole. Empty table: no archives. Other columns are ignored.
    """
    ws = Workspace(pages.sparkSession, "warc")
    rows = pick(pages, id=id_col, url=url_col, html=html_col).select("id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    marked = mark_revisits(rows, ws, least_bytes)
    plain = ws.save(write_archives(marked.withColumn("id", F.col("id").cast("string")), ws.path("streams"), roll), "written")
    members = ws.save(normalise_archives(plain.repartition(max(1, plain.count())), ws.path("members")), "normalised")
    return members, ws


def op2_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives, _ = archive_pages(pages)
    back = read_records(archives.repartition(max(1, archives.count())), ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return back.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     g AS (SELECT html, max(page_id) AS keep FROM p GROUP BY html),
     s AS (SELECT html, keep, sha1(html) || '0' AS hex FROM g),
     b AS (SELECT html, keep, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
                 ((strpos('0123456789abcdef', substr(hex, CAST((5 * i) // 4 + 1 AS BIGINT), 1)) - 1) * 16
                + (strpos('0123456789abcdef', substr(hex, CAST((5 * i) // 4 + 2 AS BIGINT), 1)) - 1)) // CAST(pow(2, 3 - (5 * i) % 4) AS BIGINT)) % 32 AS BIGINT), 1) FOR i IN range(32)], '') AS digest FROM s)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, b.digest AS payload_digest,
       CASE WHEN p.page_id = b.keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = b.keep THEN NULL ELSE b.keep END AS refers_to
FROM p JOIN b ON p.html = b.html
"""
