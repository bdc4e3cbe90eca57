"""Media columns: GIF.

A reader of whole GIF streams: LZW codes, global and local palettes, interlacing,
transparency and the three disposal rules, giving timed frames with histograms of
their colours; and a writer that stores 8-bit samples losslessly as grey frames.

LZW is sequential, but the width of a code depends only on its place after the last
clear code.  So bits are packed and unpacked by numpy in runs of one width, and the
plain loop runs once per code, not per pixel.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from loomgraph.llm.columns import pick
from loomgraph.llm.worker import lean
from loomgraph.operators.workspace import Workspace

#: Row length of stored payloads, rows of one frame and hundredths of a second it shows.
WIDTH, ROWS, DELAY = 576, 16, 4
TABLE = 4096
BINS = 8
_ROOTS = [bytes([i]) for i in range(256)]
#: First row and step of the four passes of an interlaced image (GIF89a, appendix E).
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))
DISPOSE_BACKGROUND, DISPOSE_PREVIOUS = 2, 3


# -- LZW


def _runs(low_bits: int) -> Iterator[tuple[int, int]]:
    """(code width, number of codes that have it) after a clear code; the last is repeated."""
    width = low_bits + 1
    yield width, (1 << width) - (1 << low_bits) - 1
    while width < 12:
        width += 1
        yield width, 1 << (width - 1)
    while True:
        yield 12, TABLE


def lzw_encode(data: bytes) -> bytes:
    """8-bit samples to a code stream; the table is cleared as soon as it is full."""
    clear, end, most = 256, 257, TABLE - 258
    bits = []

    def put(codes: list[int]) -> None:
        at = 0
        for width, n in _runs(8):
            part = np.array(codes[at : at + n], dtype=np.uint16)
            bits.append(((part[:, None] >> np.arange(width, dtype=np.uint16)) & 1).astype(np.uint8).ravel())
            at += n
            if at >= len(codes):
                return

    table: dict[int, int] = {}
    get = table.get
    codes: list[int] = []
    emit = codes.append
    first = np.array([(clear >> i) & 1 for i in range(9)], dtype=np.uint8)
    bits.append(first)
    new = 258
    it = iter(data)
    at = next(it, None)
    for c in it:
        key = at << 8 | c
        known = get(key)
        if known is not None:
            at = known
            continue
        emit(at)
        at = c
        table[key] = new
        new += 1
        if new == TABLE:
            codes.append(clear)
            put(codes)
            table.clear()
            codes.clear()
            new = 258
    if at is not None:
        emit(at)
    emit(end)
    put(codes)
    return np.packbits(np.concatenate(bits), bitorder="little").tobytes()


def _expand(codes: list[int], low_bits: int, out: list[bytes]) -> None:
    """Append what the codes between two clear codes stand for."""
    clear = 1 << low_bits
    table = [*_ROOTS[:clear], b"", b""]
    if codes[0] >= clear:
        raise ValueError("an LZW stream begins with an unknown code")
    last = table[codes[0]]
    out.append(last)
    grow, add = table.append, out.append
    room = TABLE - len(table)
    for c in codes[1 : room + 1]:
        try:
            now = table[c]
        except IndexError:
            if c != len(table):
                raise ValueError("an LZW code is beyond the table") from None
            now = last + last[:1]
        grow(last + now[:1])
        add(now)
        last = now
    out += [table[c] for c in codes[room + 1 :]]


def lzw_decode(stream: bytes, low_bits: int) -> bytes:
    """The samples of a code stream; codes after the end code are ignored, a missing one is forgiven."""
    if not 1 <= low_bits <= 8:
        raise ValueError(f"LZW code size {low_bits}")
    bits = np.unpackbits(np.frombuffer(stream, dtype=np.uint8), bitorder="little")
    clear, end = 1 << low_bits, (1 << low_bits) + 1
    out: list[bytes] = []
    at, over = 0, False
    while not over:
        codes: list[int] = []
        for width, n in _runs(low_bits):
            n = min(n, (len(bits) - at) // width)
            if n == 0:
                over = True
                break
            wide = np.zeros((n, 16), dtype=np.uint8)
            wide[:, :width] = bits[at : at + n * width].reshape(n, width)
            part = np.packbits(wide, axis=1, bitorder="little").view("<u2").ravel()
            stop = np.flatnonzero((part == clear) | (part == end))
            if len(stop):
                k = int(stop[0])
                codes += part[:k].tolist()
                at += (k + 1) * width
                over = part[k] == end
                break
            codes += part.tolist()
            at += n * width
        if codes:
            _expand(codes, low_bits, out)
    return b"".join(out)


# -- the container


@dataclass
class Frame:
    delay: int  # hundredths of a second
    disposal: int
    left: int
    top: int
    samples: np.ndarray  # palette indices, rows x columns
    canvas: np.ndarray  # what is shown: rows x columns x RGBA


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        if len(parts[-1]) < n:
            raise ValueError("a GIF data block is cut off")
        at += 1 + n
    return b"".join(parts), at + 1


def read_gif(data: bytes) -> Iterator[Frame]:
    """Frames in order, composed on the canvas. Raises ValueError on broken data."""
    try:
        yield from _read_gif(data)
    except (IndexError, struct.error) as e:
        raise ValueError("a GIF is cut off") from e


def _read_gif(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at = 13

    def palette(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        p = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3)
        at += 3 * n
        return p

    shared = palette(flags)
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    delay = disposal = 0
    clear_index: int | None = None
    while True:
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown GIF block {kind}")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = palette(packed)
        if colours is None:
            colours = shared
        if colours is None:
            raise ValueError("a GIF image has no palette")
        low_bits = data[at]
        stream, at = _blocks(data, at + 1)
        pixels = np.frombuffer(lzw_decode(stream, low_bits), dtype=np.uint8)
        if len(pixels) < w * h:
            raise ValueError("a GIF image has too few pixels")
        samples = pixels[: w * h].reshape(h, w)
        if packed & 0x40:
            order = [y for start, step in PASSES for y in range(start, h, step)]
            straight = np.empty_like(samples)
            straight[order] = samples
            samples = straight
        before = canvas.copy() if disposal == DISPOSE_PREVIOUS else None
        area = canvas[top : top + h, left : left + w]
        seen = samples[: area.shape[0], : area.shape[1]]  # what lies beyond the screen is not shown
        shown = np.full((*seen.shape, 4), 255, dtype=np.uint8)
        table = np.zeros((256, 3), dtype=np.uint8)
        table[: len(colours)] = colours
        shown[..., :3] = table[seen]
        if clear_index is None:
            area[...] = shown
        else:
            np.copyto(area, shown, where=(seen != clear_index)[..., None])
        yield Frame(delay, disposal, left, top, samples, canvas.copy())
        if before is not None:
            canvas = before
        elif disposal == DISPOSE_BACKGROUND:
            area[...] = 0
        delay = disposal = 0
        clear_index = None


def write_gif(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """8-bit samples, a multiple of ``width``, as grey frames of at most ``rows`` rows."""
    if not payload or len(payload) % width:
        raise ValueError(f"{len(payload)} samples are no positive multiple of {width}")
    height = min(rows, len(payload) // width)
    grey = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), grey]
    for at in range(0, len(payload), width * rows):
        part = payload[at : at + width * rows]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08")
        stream = lzw_encode(part)
        for k in range(0, len(stream), 255):
            block = stream[k : k + 255]
            out += [bytes([len(block)]), block]
        out.append(b"\0")
    out.append(b"\x3b")
    return b"".join(out)


def read_samples(data: bytes) -> bytes:
    """What ``write_gif`` stored: the shown grey values of each frame's own rows."""
    return b"".join(np.ascontiguousarray(f.canvas[f.top : f.top + f.samples.shape[0], f.left : f.left + f.samples.shape[1], 0]).tobytes() for f in read_gif(data))


def histograms(canvas: np.ndarray) -> list[np.ndarray]:
    """Counts of red, green and blue in BINS equal ranges, over pixels that show something."""
    shown = canvas[canvas[..., 3] > 0] if (canvas[..., 3] == 0).any() else canvas.reshape(-1, 4)
    return [np.bincount(shown[:, k] // (256 // BINS), minlength=BINS) for k in range(3)]


# -- DataFrames


def frame_table(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per frame: id, frame, at_cs, delay_cs, left, top, width, height, disposal, red, green, blue, error.

    ``at_cs``: when the frame begins. red, green, blue: histograms of the composed canvas.
    Null media gives no rows. Broken media gives its readable frames, then a row that
    has only id, frame and error. Repeated rows are read again each.
    """
    kept = pick(media, id=id_col, media=media_col)
    names = ["id", "frame", "at_cs", "delay_cs", "left", "top", "width", "height", "disposal", "red", "green", "blue", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, data in zip(b["id"], b["media"], strict=True):
                if data is None:
                    continue
                rows, clock = [], 0
                try:
                    for f in read_gif(bytes(data)):
                        r, g, bl = (x.tolist() for x in histograms(f.canvas))
                        rows.append((key, len(rows), clock, f.delay, f.left, f.top, f.samples.shape[1], f.samples.shape[0], f.disposal, r, g, bl, None))
                        clock += f.delay
                except ValueError as e:
                    rows.append((key, len(rows), *[None] * 10, str(e)))
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names[1:9]})

    kinds = f"id {kept.schema['id'].dataType.simpleString()}, " + ", ".join(f"`{c}` long" for c in names[1:9]) + ", red array<long>, green array<long>, blue array<long>, error string"
    return kept.mapInPandas(lean(run), kinds).withColumnRenamed("id", id_col)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8, filled with bytes 255 up to a positive multiple of WIDTH, as a GIF.

    Null text is empty: one row of 255s. A long text is many frames of one GIF, held whole. Null and repeated ids
    pass through, a row each; other columns are ignored; empty tables give no rows.
    """
    kept = pick(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, sizes, media, held = [], [], [], 0
            for key, text in zip(b["id"], b["text"], strict=True):
                data = (text or "").encode()
                ids.append(key)
                sizes.append(len(data))
                media.append(write_gif(data + b"\xff" * (-len(data) % WIDTH if data else WIDTH)))
                held += len(media[-1])
                if held > 4 << 20:
                    yield pd.DataFrame({"id": ids, "n_bytes": sizes, "media": media})
                    ids, sizes, media, held = [], [], [], 0
            if ids:
                yield pd.DataFrame({"id": ids, "n_bytes": sizes, "media": media})

    return kept.mapInPandas(lean(run), f"id {kept.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def stored_digests(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read ``store_texts`` media back: digests of samples and media, and a feature of all frames' histograms. A row for each row."""
    kept = pick(stored, id=id_col, n_bytes="n_bytes", media="media")

    def digest(data: bytes) -> tuple:
        total, cs, n, parts = [np.zeros(BINS, dtype=np.int64) for _ in range(3)], 0, 0, []
        for f in read_gif(data):
            area = f.canvas[f.top : f.top + f.samples.shape[0], f.left : f.left + f.samples.shape[1]]
            parts.append(np.ascontiguousarray(area[..., 0]).tobytes())
            for t, h in zip(total, histograms(area), strict=True):
                t += h
            n, cs = n + 1, cs + f.delay
        payload = b"".join(parts)
        feature = f"frames={n};cs={cs};" + ";".join(f"{c}={','.join(map(str, t))}" for c, t in zip("rgb", total, strict=True))
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([digest(bytes(m)) for m in b["media"]], columns=names)
            out.insert(0, "id", b["id"].to_numpy())
            out.insert(1, "n_bytes", b["n_bytes"].to_numpy())
            yield out

    kinds = f"id {kept.schema['id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return kept.mapInPandas(lean(run), kinds).withColumnRenamed("id", id_col)


def op3_gif(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stored = Workspace(spark, "gif").save(store_texts(docs), "media")
    return stored_digests(stored)
