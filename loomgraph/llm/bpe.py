"""BPE encoding and decoding by prefix-sharing trie traversal.

The ids of a word depend on its prefixes: if t is the last token of BPE(s), the
tokens before it are BPE of what precedes t.  So one token per prefix, its last
one, holds the whole encoding.  Distinct words go into a trie; a depth-first walk
finds each node's last token once, from those of the nodes above it, and all
words below share it; a word's ids are read off by walking back from its end.  A token may follow another when BPE of the two together
gives just these two; that test is kept by pair.

Words come from the tokenizer file's own rules.  Text of Latin letters (up to
U+017F) is split by a compiled pattern that states the file's rule for that range;
all other text is normalised and split by the tokenizers library itself.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from loomgraph.llm.columns import pick
from loomgraph.llm.worker import lean

#: Words kept with their ids in a worker, and words remembered as met once.
CACHED_WORDS = 250_000
CACHED_PAIRS = 250_000
#: Longer words (in bytes) share no trie and are not kept, so that memory is linear in a word's length.
LONG_WORD = 256
END = "</w>"
#: Any character that the compiled pattern does not cover, or whose lower case it does not.
_FAR = re.compile("[^\u0000-\u012f\u0131-ſ]")
_LETTER = "a-zªµºß-öø-ÿĀ-ſ"
_NUMBER = "0-9²³¹¼½¾"
_SPACE = " \t-\r\u0085 "
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


def byte_characters() -> list[str]:
    """A printable character per byte: its own where it prints, else from U+0100 on."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printing else chr(next(spare)) for b in range(256)]


class WordEncoder:
    """Splits texts, keeps the ids of words, and has the library encode words not seen before."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # A task has one core.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["end_of_word_suffix"] != END or model["dropout"] or model["unk_token"] or model["ignore_merges"]:
            raise ValueError("not an end-of-word BPE without unknown token")
        self.library = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max(*self.vocab.values(), *self.special.values()))
        for t, i in (*self.vocab.items(), *self.special.items()):
            self.tokens[i] = t
        self.byte_char = byte_characters()
        self.char_byte = {c: b for b, c in enumerate(self.byte_char)}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words: dict[str, bytes] = {}
        self.once: set[str] = set()
        self._prepare(model)

    def _prepare(self, model: dict) -> None:
        self.ends = np.array([t.endswith(END) for t in self.tokens])

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct words, as little-endian unsigned 32-bit integers."""
        words = list(words)
        ids = np.array(self.library.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1  # every word ends in an end token
        if len(cuts) != len(words):
            return {w: np.array(self.library.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes() for w in words}
        data, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return {w: data[i:k] for w, i, k in zip(words, at, at[1:], strict=False)}

    # -- texts

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if not text.isascii() and _FAR.search(text):
            mapped = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes([self.char_byte[c] for c in w]).decode("utf-8") for w, _ in mapped]
        return _WORDS.findall(text.lower())

    def encode_batch(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text. A word is kept when it is met again, so that rare ones do not crowd out others."""
        known = self.words
        get = known.get
        found: list[list[bytes | None]] = []
        gaps: list[tuple[list[bytes | None], int, str]] = []
        for text in texts:
            ids: list[bytes | None] = []
            if "<|" in text and self.cut_special:
                parts = self.cut_special.split(text)
            else:
                parts = [text]
            for part in parts:
                if part in self.special:
                    ids.append(self.special[part].to_bytes(4, "little"))
                    continue
                words = self.split(part)
                at = len(ids)
                ids += map(get, words)
                try:
                    start = at
                    while True:
                        at = ids.index(None, at)
                        gaps.append((ids, at, words[at - start]))
                        at += 1
                except ValueError:
                    pass
            found.append(ids)
        fresh = Counter([w for _, _, w in gaps])
        new = self.encode_words(fresh) if fresh else {}
        for ids, at, word in gaps:
            ids[at] = new[word]
        once = self.once
        for w, n in fresh.items():
            if len(new[w]) > 4 * LONG_WORD or len(w) > LONG_WORD:
                continue
            if n > 1 or w in once:
                known[w] = new[w]
            else:
                once.add(w)
        if len(once) > CACHED_WORDS:
            once.clear()
        if len(known) > CACHED_WORDS:  # words met early are the common ones
            self.words = dict(itertools.islice(known.items(), CACHED_WORDS // 2))
        return list(map(b"".join, found))

    def decode(self, ids: bytes) -> str:
        """The file names no decoder: tokens, special ones too, joined by blanks."""
        return " ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


class TrieEncoder(WordEncoder):
    """Encodes new words itself, in a trie of their prefixes."""

    def _prepare(self, model: dict) -> None:
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: r for r, m in enumerate(merges)}
        #: Characters of the longest token by its last two characters (and end mark).
        self.reach: dict[str, int] = {}
        for t in self.vocab:
            end = END if t.endswith(END) and len(t) > len(END) else ""
            body = t.removesuffix(end)
            if len(body) > 1:
                self.reach[body[-2:] + end] = max(len(body), self.reach.get(body[-2:] + end, 0))
        self.sides: dict[str, tuple | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    # -- the pair test

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(END) and len(token) > len(END):
            body = token[: -len(END)]
            return [*body[:-1], body[-1] + END]
        return list(token)

    def _merge(self, s: list[str], made: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """Plain BPE: the lowest-ranked pair, leftmost first, until none is left."""
        rank, none = self.rank, len(self.rank)
        while len(s) > 1:
            ranks = [rank.get(x, none) for x in zip(s, s[1:])]
            low = min(ranks)
            if low == none:
                break
            at = ranks.index(low)
            new = s[at] + s[at + 1]
            if made is not None:
                made[new] = s[at], s[at + 1]
            s[at : at + 2] = [new]
        return s

    def _sides(self, token: str) -> tuple[list[tuple[str, int]], list[tuple[str, int]]] | None:
        """What stands at the right and at the left end of a token while BPE makes it.

        Each with the rank of the merge that ends it. None if BPE does not give the token alone.
        """
        if token in self.sides:
            return self.sides[token]
        made: dict[str, tuple[str, str]] = {}
        out = None
        if self._merge(self._symbols(token), made) == [token]:
            out = []
            for end in (1, 0):
                side, at, ended = [], token, len(self.rank)
                while True:
                    side.append((at, ended))
                    if at not in made:
                        break
                    ended = self.rank[made[at]]
                    at = made[at][end]
                out.append(side)
            out = tuple(out)
        self.sides[token] = out
        return out

    def _may_start(self, token: str) -> bool:
        return self._sides(token) is not None

    def _may_follow(self, left: str, token: str) -> bool:
        """Whether BPE of both together gives just these two: no merge across comes before each side's own."""
        ok = self.pairs.get((left, token))
        if ok is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            mine, its = self._sides(left), self._sides(token)
            get, none = self.rank.get, len(self.rank)
            ok = mine is not None and its is not None and not any((r := get((a, b), none)) < ea and r <= eb for a, ea in mine[0] for b, eb in its[1])
            self.pairs[left, token] = ok
        return ok

    # -- the trie

    def _last_token(self, text: str, n: int, lasts: list[str], suffix: str = "") -> tuple[str, int]:
        """The last token of the first ``n`` characters of ``text`` and where it begins; lasts[d] is that of the first d."""
        vocab, pairs = self.vocab, self.pairs.get
        for at in range(max(0, n - self.reach.get(text[max(0, n - 2) : n] + suffix, 1)), n):
            token = text[at:n] + suffix
            if token not in vocab:
                continue
            if at:
                ok = pairs((lasts[at], token))
                if ok is None:
                    ok = self._may_follow(lasts[at], token)
            else:
                ok = self._sides(token) is not None
            if ok:
                return token, at
        raise ValueError(f"no token ends {text[max(0, n - 50) : n]!r}")

    def _walk_back(self, token: str, at: int, lasts: list[str], starts: list[int]) -> bytes:
        """Ids of a word from its last token: every prefix keeps no more than its last one and where that begins."""
        ids = [self.vocab[token]]
        while at:
            ids.append(self.vocab[lasts[at]])
            at = starts[at]
        return np.array(ids[::-1], dtype="<u4").tobytes()

    def _encode_long(self, chars: str) -> bytes:
        """A word on a path of its own."""
        lasts, starts = [""], [0]
        for n in range(1, len(chars)):
            token, at = self._last_token(chars, n, lasts)
            lasts.append(token)
            starts.append(at)
        return self._walk_back(*self._last_token(chars, len(chars), lasts, END), lasts, starts)

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct words, as little-endian unsigned 32-bit integers."""
        byte_char = self.byte_char
        root: dict = {}
        out: dict[str, bytes] = {}
        for word in words:
            chars = word if word.isascii() and word.isprintable() else "".join([byte_char[b] for b in word.encode()])
            if len(chars) > LONG_WORD:
                out[word] = self._encode_long(chars)
                continue
            node = root
            for c in chars[:-1]:
                below = node.get(c)
                if below is None:
                    below = node[c] = {}
                node = below
            if "" in node:
                node[""].append((chars[-1], word))
            else:
                node[""] = [(chars[-1], word)]
        lasts, starts = [""], [0]
        stack = [(root, "")]
        last_token, walk_back = self._last_token, self._walk_back
        while stack:
            node, text = stack.pop()
            n = len(text)
            if n:
                del lasts[n:], starts[n:]
                token, at = last_token(text, n, lasts)
                lasts.append(token)
                starts.append(at)
            for c, below in node.items():
                if c:
                    stack.append((below, text + c))
                else:
                    for last, word in below:
                        out[word] = walk_back(*last_token(text + last, n + 1, lasts, END), lasts, starts)
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    """One per worker process and file."""
    return TrieEncoder(path)


@functools.lru_cache(maxsize=2)
def library_encoder(path: str) -> WordEncoder:
    """The same ids from the library: for operators that only need them."""
    return WordEncoder(path)


def text_slices(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of runs of rows of about ``most`` bytes: a task holds one run as Python strings. Null: empty."""
    ids, texts = batch.column(0), batch.column(1)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    runs = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(ids)]
    for i, k in zip(cuts, cuts[1:], strict=False):
        if k > i:
            yield ids.slice(i, k - i), [t or "" for t in texts.slice(i, k - i).to_pylist()]


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): ids as little-endian unsigned 32-bit integers.

    Null text is empty. A text is encoded whole, in memory that grows with its length as a line does. Null and
    repeated ids pass through, a row each; other columns are ignored; empty tables give no rows.
    """
    kept = pick(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            for ids, texts in text_slices(b):
                yield pa.RecordBatch.from_arrays([ids, pa.array(enc.encode_batch(texts), pa.binary())], ["id", "ids"])

    return kept.mapInArrow(lean(run), f"id {kept.schema['id'].dataType.simpleString()}, ids binary").withColumnRenamed("id", id_col)


def decode_texts(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Every column of ``encoded`` and the decoded text. Null ids decode to null."""
    from pyspark.sql.functions import col, pandas_udf

    @pandas_udf("string")
    def decoded(ids: pd.Series) -> pd.Series:
        enc = encoder(tokenizer)
        return ids.map(lambda x: None if x is None else enc.decode(x))

    return encoded.withColumn(out_col, decoded(col(f"`{ids_col}`")))


def token_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode again, and return (id, n_tokens, ids_sha256, decoded_sha256) per row.

    Null text is empty; empty tables give no rows; repeated and null ids pass through.
    A text is encoded whole whatever its length.
    """
    kept = pick(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            for keys, texts in text_slices(b):
                ids = enc.encode_batch(texts)
                sums = [hashlib.sha256(x).hexdigest() for x in ids]
                back = [hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([keys, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sums), pa.array(back)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return kept.mapInArrow(lean(run), f"id {kept.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_digests(docs, public_tokenizers.path("word_bpe_49k.json"))
