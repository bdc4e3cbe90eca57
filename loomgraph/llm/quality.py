"""Compression classifier.

Two zstandard dictionaries are built from good and from bad labelled text.  A text
compresses better under the dictionary of its kind.  It is compressed in short blocks, so
that the dictionary and not the text itself explains each of them, and every block of the
whole text counts: a block's difference is (bad - good) / (bad + good) of its two sizes, and the
text's is the lower quartile of its blocks', so that a text that is bad in a good part is
found as well.  This one number becomes a probability by a logistic fit (Platt) on labelled
texts that no dictionary has seen, weighted by how common either label is; the score
rises with the difference and depends on nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.columns import pick
from loomgraph.llm.worker import lean

#: At most so many labelled documents of each class are fitted on, by the hash of their
#: ids, and at most so many characters of all; half build dictionaries, half calibrate.
SAMPLE_DOCS = 3000
SAMPLE_CHARS = 24_000_000
#: Size of a dictionary and of the pieces it is made of, taken from anywhere in the sample's texts.
DICTIONARY_BYTES = 112 << 10
PIECE = 128
BLOCK = 64
QUARTILE = 0.25
LEVEL = 3
THRESHOLD = 0.7


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 4, is 2: no label of these is learned."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Sizes:
    """Compressed sizes of blocks under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = []
        for d in (good, bad):
            kept = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def difference(self, text: str) -> float:
        """The normalised size difference, -1 to 1; NaN of an empty text, which has no evidence."""
        data = text.encode()
        n = len(data)
        if not n:
            return float("nan")
        ends = [*range(BLOCK, n, BLOCK), n]
        if len(ends) > 1 and n - ends[-2] < BLOCK // 4:  # a short rest joins the block before it
            del ends[-2]
        blocks = [data[i:k] for i, k in zip([0, *ends], ends, strict=False)]
        good, bad = (np.fromiter(map(len, map(c, blocks)), dtype=np.float64, count=len(blocks)) for c in self.by)
        return float(np.quantile((bad - good) / (bad + good), QUARTILE))


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float  # never negative
    shift: float

    def sizes(self) -> Sizes:
        return Sizes(self.good, self.bad)

    def score(self, difference: np.ndarray) -> np.ndarray:
        """Probability of label 1. An empty text scores 0."""
        z = self.slope * np.nan_to_num(difference) + self.shift
        return np.where(np.isnan(difference), 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _dictionary(texts: list[str]) -> bytes:
    """Pieces from drawn places of all texts in turn until the dictionary is full."""
    draw = np.random.default_rng(17)
    sources = [t.encode() for t in texts if t]
    parts, held = [], 0
    while sources and held < DICTIONARY_BYTES:
        for t in sources:
            at = int(draw.integers(0, max(1, len(t) - PIECE + 1)))
            parts.append(t[at : at + PIECE])
            held += len(parts[-1])
            if held >= DICTIONARY_BYTES:
                break
    return b"\n".join(parts)[:DICTIONARY_BYTES].ljust(8, b"\n")


def fit(rows: list[tuple[str, int]], totals: dict[int, int] | None = None) -> Model:
    """rows: (text, 0 or 1), in an order that says nothing. Odd rows build dictionaries, even ones calibrate.

    ``totals``: how many texts of either label there are, of which ``rows`` is a sample.
    """
    kinds = {k: [t for t, y in rows if y == k] for k in (0, 1)}
    good, bad = (_dictionary(kinds[k][1::2]) for k in (1, 0))
    sizes = Sizes(good, bad)
    use = [(d, k) for k in (0, 1) for t in kinds[k][0::2] if not np.isnan(d := sizes.difference(t))]
    if not use:
        return Model(good, bad, 0.0, 0.0)
    x, y = (np.array(c, dtype=float) for c in zip(*use, strict=True))
    share = {k: (totals or {}).get(k, len(kinds[k])) / max(1, (y == k).sum()) for k in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    weight *= len(weight) / weight.sum()
    mean, scale = x.mean(), x.std() + 1e-6
    wide = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(2), np.array([0.05, 0.05])
    for _ in range(60):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(wide @ w, -30, 30)))
        grad = wide.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((wide * (weight * p * (1 - p) + 1e-9)[:, None]).T @ wide + np.diag(ridge), grad)
        size = np.abs(step).max()
        w -= step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    slope = max(0.0, float(w[0])) / scale
    return Model(good, bad, slope, float(w[1]) - slope * mean)


def usable_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, y) of rows labelled 0 or 1 that are not held out. Labels of null ids say nothing."""
    return pick(labels, id=id_col, y=label_col).where(F.col("y").isin(0, 1)).where(F.col("id").isNotNull() & ~held_out("id")).distinct()


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, docs_per_class: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """A bounded sample of labelled rows that are not held out, ordered by a hash of the id.

    At most 2 x docs_per_class ids are broadcast. The texts reach the driver one after another, until ``chars`` are held.
    """
    use = usable_labels(labels, id_col, label_col)
    order = F.xxhash64("id", F.lit(17))
    some = use.where("y = 0").orderBy(order, "id").limit(docs_per_class).unionByName(use.where("y = 1").orderBy(order, "id").limit(docs_per_class))
    texts = pick(docs, id=id_col, text=text_col).where("text IS NOT NULL")
    joined = texts.join(F.broadcast(some), "id").select("text", "y", order.alias("o"), "id")  # at most 2 x docs_per_class rows
    out, held = [], 0
    for r in joined.orderBy("o", "id", "text").toLocalIterator():
        if held > chars:
            break
        held += len(r["text"])
        out.append((r["text"], int(r["y"])))
    return out


def _differences(sizes: Sizes, texts: pa.Array) -> np.ndarray:
    """Size differences of a column of texts, one text at a time."""
    return np.fromiter((sizes.difference(t.as_py() or "") for t in texts), dtype=np.float64, count=len(texts))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted, difference) per row, by the text alone.

    Null text is empty; an empty text scores 0 and has a null difference. Whole texts of any length are scored.
    Null and repeated ids pass through, a row each; other columns are ignored; empty tables give no rows.
    """
    kept = pick(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = model.sizes()
        for b in batches:
            difference = _differences(sizes, b.column(1))
            score = model.score(difference)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(difference, mask=np.isnan(difference))], ["id", "score", "predicted", "difference"])

    return kept.mapInArrow(lean(run), f"id {kept.schema['id'].dataType.simpleString()}, score double, predicted int, difference double").withColumnRenamed("id", id_col)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of the labelled texts. Without any of a label, every text scores alike."""
    totals = {int(r["y"]): r["count"] for r in usable_labels(labels, id_col, label_col).groupBy("y").count().collect()}
    return fit(labelled_sample(docs, labels, id_col, text_col, label_col), totals)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``. No shuffle.

    Rows with null or repeated ids are judged by their texts like all others; empty texts go.
    """
    model = train(docs, labels, id_col, text_col)
    names = [f.name for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = model.sizes()
        for b in batches:
            yield b.filter(pa.array(model.score(_differences(sizes, b.column(at))) >= threshold))

    at = names.index(text_col)
    return docs.mapInArrow(lean(run), docs.schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "difference")
