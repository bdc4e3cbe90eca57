"""Structured extraction: answers of a pluggable extractor, cleaned and validated.

The contract is the validation, which is native; an extractor is anything that maps a
prompt to text.  The rule-based one here needs no network and is deterministic.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import CLAIM_TYPES, DEFAULT_CONFIDENCE, ENTITY_TYPES, MIN_CONFIDENCE

Extractor = Callable[[str], str]


def clean_answer(raw: Column) -> Column:
    """Strip; drop fence lines if the text begins with a fence; else take the widest braces if it does not begin with one."""
    text = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    bare = F.when(F.startswith(text, F.lit("```")), F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*```.*$\n?", ""), r"(?U)^\s+|\s+$", "")).otherwise(text)
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(F.startswith(bare, F.lit("{")), bare).when(inner != "", inner).otherwise(bare)


def parse_answers(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Add doc, a variant; null where the answer is no JSON object (the retry path)."""
    v = F.try_parse_json(clean_answer(F.col(raw)))
    return answers.withColumn("doc", F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v))


def _items(df: DataFrame, key: str, field: str) -> DataFrame:
    arr = F.try_variant_get("doc", f"$.{field}", "array<variant>")
    return df.where("doc IS NOT NULL").select(key, F.posexplode(arr).alias("pos", "item"))


def _text(path: str) -> Column:
    """A string member; null if missing or of another type."""
    v = F.try_variant_get("item", path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get("item", path, "string"))


def valid_entities(docs: DataFrame, key: str = "id") -> DataFrame:
    """(key, pos, name, entity_type, aliases): items without name or type, or of unknown type, are dropped alone."""
    out = _items(docs, key, "entities").select(key, "pos", _text("$.name").alias("name"), _text("$.entity_type").alias("entity_type"), F.coalesce(F.try_variant_get("item", "$.aliases", "array<string>"), F.array().cast("array<string>")).alias("aliases"))
    return out.where(F.col("name").isNotNull() & F.col("entity_type").isin(ENTITY_TYPES))


def valid_claims(docs: DataFrame, key: str = "id", least: float = MIN_CONFIDENCE) -> DataFrame:
    """(key, pos, claim_type, subject, object, detail, excerpt, confidence) of valid claims.

    A missing or null object is the subject, an empty one stays; excerpt defaults to '' and confidence
    to 0.7; confidence outside [0, 1] or below ``least``, or an unknown type, drops the item.
    """
    c = F.try_variant_get("item", "$.confidence", "variant")
    number = F.when(c.isNull() | F.is_variant_null(c), F.lit(DEFAULT_CONFIDENCE)).otherwise(F.try_variant_get("item", "$.confidence", "double"))
    out = _items(docs, key, "claims").select(key, "pos", _text("$.claim_type").alias("claim_type"), _text("$.subject").alias("subject"), F.coalesce(_text("$.object"), _text("$.subject")).alias("object"), _text("$.detail").alias("detail"), F.coalesce(_text("$.excerpt"), F.lit("")).alias("excerpt"), number.alias("confidence"))
    return out.where(F.col("subject").isNotNull() & F.col("claim_type").isin(CLAIM_TYPES) & F.col("confidence").between(0, 1) & (F.col("confidence") >= least))


def rule_extractor(prompt: str) -> str:
    """Capitalised runs are topics, addresses persons; neighbours in a sentence are mentioned together."""
    body = prompt.split("\n\n", 1)[-1]
    people = list(dict.fromkeys(re.findall(r"[\w.]+@[\w.]+", prompt)))
    names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]{3,}(?: [A-Z][a-z]{3,})*", body)))
    claims = [{"claim_type": "mentioned_in", "subject": a, "object": b, "excerpt": f"{a} {b}", "confidence": 0.8} for a, b in zip(names, names[1:], strict=False)]
    found = [{"name": p, "entity_type": "person", "aliases": []} for p in people] + [{"name": n, "entity_type": "topic", "aliases": []} for n in names]
    return json.dumps({"entities": found, "claims": claims})


def wait_for(error: str, attempt: int) -> float:
    """Seconds before the next attempt: five for a lost connection, ever ten more for a rate limit, else doubling."""
    return 5.0 if error == "connection" else 10.0 * (attempt + 1) if error == "rate limit" else 2.0**attempt


def extract(prompts: DataFrame, extractor: Extractor = rule_extractor, key: str = "id", retries: int = 3, wait: Callable[[str, int], float] | None = None, workers: int | None = None) -> DataFrame:
    """(key, raw, attempts, error): the first answer that is a JSON object with something in it, or the last.

    Failures, no JSON, and empty answers to bodies of more than 100 characters are tried again, after a wait
    by kind and attempt. ``workers``: so many extractors at once.
    """
    wait = wait or wait_for

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text in zip(b["key"], b["prompt"], strict=True):
                raw = error = None
                for n in range(retries + 1):
                    try:
                        raw, error = extractor(text), None
                        v = json.loads(raw[raw.index("{") : raw.rindex("}") + 1])
                        if v.get("entities") or v.get("claims") or len(text.split("\n\n", 1)[-1]) <= 100:
                            break
                        error = "empty"
                    except Exception as e:  # any extractor may fail in its own way
                        error = "rate limit" if re.search("rate.?limit|429", str(e), re.I) else "connection" if isinstance(e, ConnectionError) else type(e).__name__
                    if n < retries:
                        time.sleep(wait(error, n))
                rows.append((k, raw, n + 1, error))
            yield pd.DataFrame(rows, columns=["key", "raw", "attempts", "error"])

    some = prompts.select(F.col(key).alias("key"), "prompt")
    return (some if workers is None else some.repartition(workers)).mapInPandas(run, "key string, raw string, attempts int, error string").withColumnRenamed("key", key)


def run_stats(results: DataFrame, entities: DataFrame, claims: DataFrame, key: str = "id") -> DataFrame:
    n_e, n_c = entities.groupBy(key).agg(F.count("*").alias("e")), claims.groupBy(key).agg(F.count("*").alias("c"))
    r = results.join(n_e, key, "left").join(n_c, key, "left")
    s = r.agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum("e"), F.lit(0)).alias("entities"), F.coalesce(F.sum("c"), F.lit(0)).alias("claims"))
    return s.withColumns({"avg_entities": F.col("entities") / F.greatest("succeeded", F.lit(1)), "avg_claims": F.col("claims") / F.greatest("succeeded", F.lit(1))})
