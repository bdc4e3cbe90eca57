"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies. Native SQL functions only.

Texts become words of a-z and 0-9.  For templates of L words a text is cut into windows
of 2L words, L apart, so every stretch of L words lies whole in a window.  Window
and template signatures are minima of seeded hashes of their 5-word shingles; each
minimum is a band.  A window that holds CONTAINED of a template's shingles has at least

    J = c (L - 4) / (2 L - 4 + (1 - c) (L - 4)),  c = CONTAINED

in common with it, so with b bands it is missed with probability (1 - J) ** b at
most; ``bands_for`` picks b for MISS.  Retrieved pairs are then verified exactly, on
the shingles' words.

A band can only meet when the window holds the very shingle that is the template's
minimum, so this necessary condition is tested first, on a single hash per shingle,
and signatures are made only for windows, of that template's length, that fulfil it.

Templates are one-line notices and the whole texts of ``licenses/``. However many are given, they
are taken in slices of a bounded number of bands, each of which is a scan of its own.
"""

from __future__ import annotations

import functools
import math
import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.columns import ascii_lower, held, pick

SHINGLE = 5
CONTAINED = 0.8
MISS = 1e-6
#: Bands of the templates of one scan, which are broadcast; further templates get further scans.
MOST_BANDS = 20_000

# License notices as they are published. Whole texts are in the folder licenses.
NOTICES = {
    "mit": "Released under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
}


def license_texts() -> dict[str, str]:
    """The whole texts of the folder, named after their files."""
    return {f"{f.name.removesuffix('.txt')}-text": f.read_text(encoding="utf-8") for f in sorted(files("loomgraph.llm").joinpath("licenses").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


TEMPLATES = NOTICES | license_texts()


def plain_words(text: str) -> list[str]:
    return [x for x in re.split("[^a-z0-9]+", text.lower()) if x]


def slices(templates: dict[str, str], most: int = MOST_BANDS) -> list[dict[str, str]]:
    """Templates in runs of at most ``most`` bands (or one template)."""
    out: list[dict[str, str]] = [{}]
    held = 0
    for name, text in templates.items():
        n = bands_for(max(SHINGLE, len(plain_words(text))))
        if out[-1] and held + n > most:
            out.append({})
            held = 0
        out[-1][name] = text
        held += n
    return out


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def bands_for(length: int, contained: float = CONTAINED, miss: float = MISS) -> int:
    share = contained * (length - SHINGLE + 1) / (2 * length - SHINGLE + 1 + (1 - contained) * (length - SHINGLE + 1))
    return math.ceil(math.log(miss) / math.log(1 - share))


def shingle_hash(w: str, i: str) -> str:
    return "xxhash64(" + ", ".join(f"get({w}, {i} + {k})" for k in range(SHINGLE)) + ")"


def shingle_hashes(w: str) -> str:
    """SQL of the array of all shingles' hashes of the word array ``w``."""
    return f"transform(sequence(0, size({w}) - {SHINGLE}), i -> {shingle_hash(w, 'i')})"


def signature(hashes: str, bands: str) -> str:
    return f"transform(sequence(0, {bands} - 1), j -> array_min(transform({hashes}, x -> xxhash64(x, j))))"


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, length, bands, hashes, texts (its shingles), sig. Templates of fewer than 5 words are refused."""
    rows = []
    for name, text in templates.items():
        w = plain_words(text)
        if len(w) < SHINGLE:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        rows.append((name, w, len(w), bands_for(len(w))))
    t = spark.createDataFrame(rows, "license string, w array<string>, length int, bands int")
    t = t.withColumn("hashes", F.expr(shingle_hashes("w")))
    return t.select("license", "length", "bands", "hashes", F.expr(shingle_texts("w")).alias("texts"), F.expr(signature("hashes", "bands")).alias("sig"))


def shingle_texts(w: str) -> str:
    return f"array_distinct(transform(sequence(0, size({w}) - {SHINGLE}), i -> concat_ws(' ', " + ", ".join(f"get({w}, i + {k})" for k in range(SHINGLE)) + ")))"


def scan(docs: DataFrame, templates: dict[str, str], id_col: str = "doc_id", text_col: str = "text", contained: float = CONTAINED) -> DataFrame:
    """One row per id and license found: id, license, windows, containment (the best window's), first_word.

    Null text has no words. Texts of fewer than 5 words match nothing; long ones are read whole, window by window. Rows
    that repeat an id are told together, each window counted once per row; null ids are grouped as one. Other columns are
    ignored. Empty table, or no templates: no rows.
    """
    return functools.reduce(DataFrame.unionByName, (_scan(docs, some, id_col, text_col, contained) for some in slices(templates)))


def _scan(docs: DataFrame, templates: dict[str, str], id_col: str, text_col: str, contained: float) -> DataFrame:
    spark = docs.sparkSession
    known = template_table(spark, templates)
    # The shingles that are some template's minimum in some band, by base hash, and the lengths of these templates.
    low: dict[int, set[int]] = {}
    minima = known.select("length", F.explode(F.expr("transform(sequence(0, bands - 1), j -> array_min(transform(hashes, x -> struct(xxhash64(x, j) AS v, x AS x))).x)")).alias("x")).distinct()
    for r in minima.collect():  # at most a row per band
        low.setdefault(r["x"], set()).add(r["length"])
    number = lambda x: f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)"
    is_low = f"IN ({', '.join(map(number, sorted(low)))})" if low else "IS NULL"
    lengths = f"map_from_arrays(array({', '.join(map(number, sorted(low)))}), array({', '.join('array(' + ', '.join(map(str, sorted(low[x]))) + ')' for x in sorted(low))}))" if low else "map(0L, array(1))"
    # Nothing but the id, words and hit places leaves the scan.
    base = held(pick(docs, id=id_col, text=text_col), "w", words(F.col("text"))).drop("text").where(f"size(w) >= {SHINGLE}")
    hit = held(base, "hits", F.expr(f"filter(sequence(0, size(w) - {SHINGLE}), i -> {shingle_hash('w', 'i')} {is_low})")).where("size(hits) > 0")
    # Windows that hold a hit: k L <= i <= k L + 2 L - 5.
    at = f"array_distinct(flatten(transform(hits, i -> flatten(transform(element_at({lengths}, {shingle_hash('w', 'i')}), l -> transform(filter(array(i DIV l, i DIV l - 1), k -> k >= 0 AND i <= k * l + 2 * l - {SHINGLE}), k -> struct(l AS length, k AS k)))))))"
    places = hit.withColumn("row", F.monotonically_increasing_id()).select("id", "row", F.col("w").alias("all"), F.explode(F.expr(at)).alias("p")).select("id", "row", "all", "p.length", "p.k")
    windows = held(places, "w", F.expr("slice(all, cast(k * length + 1 AS int), 2 * length)")).drop("all").where(f"size(w) >= {SHINGLE}")
    bands = F.broadcast(known.groupBy("length").agg(F.max("bands").alias("bands")))
    signed = held(held(windows.join(bands, "length"), "hashes", F.expr(shingle_hashes("w"))), "sig", F.expr(signature("hashes", "bands")))
    theirs = known.select("license", "length", F.posexplode("sig").alias("band", "value"))
    met = signed.select("id", "row", "length", "k", "w", F.posexplode("sig").alias("band", "value")).join(F.broadcast(theirs), ["length", "band", "value"])
    found = met.groupBy("row", "id", "k", "license").agg(F.first("w").alias("w"))
    share = F.size(F.array_intersect(F.expr(shingle_texts("w")), "texts")) / F.size("texts")
    checked = found.join(F.broadcast(known.select("license", "length", "texts")), "license").withColumn("share", share).where(F.col("share") >= contained)
    return checked.groupBy(F.col("id").alias(id_col), "license").agg(F.count("*").alias("windows"), F.max("share").alias("containment"), F.min(F.col("k") * F.col("length")).alias("first_word"))


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, TEMPLATES)


def oracle(templates: dict[str, str]) -> str:
    """All windows of all texts, compared with every template directly."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in templates.items())
    return f"""
WITH t0(license, body) AS (VALUES {values}),
     t1 AS (SELECT license, list_filter(string_split_regex(lower(body), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM t0),
     t2 AS (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM t1),
     ts AS (SELECT DISTINCT license, len(w) AS length, array_to_string(w[i:i + 4], ' ') AS s FROM t2),
     tn AS (SELECT license, count(*) AS n FROM ts GROUP BY license),
     d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
     p AS (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS i FROM d WHERE len(w) >= 5),
     h AS (SELECT p.doc_id, p.i, ts.license, ts.length, ts.s FROM p JOIN ts ON array_to_string(p.w[p.i + 1:p.i + 5], ' ') = ts.s),
     k AS (SELECT doc_id, license, length, s, i // length AS k FROM h WHERE i <= (i // length) * length + 2 * length - 5
           UNION SELECT doc_id, license, length, s, i // length - 1 FROM h WHERE i // length >= 1 AND i <= (i // length - 1) * length + 2 * length - 5),
     c AS (SELECT doc_id, k.license, length, k, count(DISTINCT s) / any_value(n) AS share FROM k JOIN tn ON k.license = tn.license GROUP BY doc_id, k.license, length, k)
SELECT doc_id, license, count(*) AS windows, max(share) AS containment, CAST(min(k * length) AS BIGINT) AS first_word FROM c WHERE share >= {CONTAINED} GROUP BY doc_id, license
"""


ORACLE = oracle(TEMPLATES)
