"""Chat formatting: tool-call linking.

Messages hold calls as ``<tool_call>{"id": ..., "name": ..., "arguments": {...}}</tool_call>``
and results as ``<tool_result>{"id": ..., "content": ...}</tool_result>``.  Calls and results
meet in a hash join on conversation and identifier.  Calls that use other calls'
results (a string ``${id}`` anywhere in the arguments) are put in topological order
in distributed rounds, however deep they are.  Arguments are validated against JSON schemas,
and everything is written as canonical JSON: sorted keys, no spaces, UTF-8. Lone surrogates, which
UTF-8 cannot hold, are written as escapes, in identifiers and names too.

Only messages with tool blocks take part; they get a row key of their own, so null or repeated
conversations and turns are rows like any other.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.columns import pick
from loomgraph.llm.worker import lean
from loomgraph.operators.skew import lookup_join
from loomgraph.operators.workspace import Workspace

_TAG = re.compile(r"<tool_(call|result)>(.*?)</tool_\1>", re.S)
_USE = re.compile(r"\$\{([^}]+)\}")
_LONE = re.compile("[\ud800-\udfff]")

#: The schemas that the query validates against.
SCHEMAS: dict[str, dict] = {
    "search": {"type": "object", "required": ["query"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}}},
    "fetch": {"type": "object", "required": ["url"], "additionalProperties": False, "properties": {"url": {"type": "string", "minLength": 1}}},
    "calculate": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}}},
}


def canonical(value: Any) -> str:
    """Canonical JSON text: sorted keys, no spaces, integral floats as integers, lone surrogates escaped; NaN is refused."""

    def plain(v: Any) -> Any:
        if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
            return int(v)
        if isinstance(v, float) and not math.isfinite(v):
            raise ValueError("not a JSON number")
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return v

    return _safe(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _safe(text: str) -> str:
    """``text`` as UTF-8 can hold it."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(kind: str, v: Any) -> bool:
    if kind == "integer":
        return not isinstance(v, bool) and (isinstance(v, int) or isinstance(v, float) and v.is_integer())
    if kind == "number":
        return isinstance(v, int | float) and not isinstance(v, bool)
    return isinstance(v, _KINDS[kind])


def schema_errors(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with ``value``: type, enum, required, properties, additionalProperties, items, lengths, bounds, pattern."""
    out = []
    kinds = schema.get("type")
    if kinds and not any(_is(k, value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds if isinstance(kinds, str) else '/'.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k, v in value.items():
            if k in own:
                out += schema_errors(v, own[k], f"{at}.{k}")
            elif (more := schema.get("additionalProperties", True)) is False:
                out.append(f"{at}.{k}: not allowed")
            elif isinstance(more, dict):
                out += schema_errors(v, more, f"{at}.{k}")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            out.append(f"{at}: number of items")
        if "items" in schema:
            for i, v in enumerate(value):
                out += schema_errors(v, schema["items"], f"{at}[{i}]")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    if _is("number", value) and (value < schema.get("minimum", value) or value > schema.get("maximum", value)):
        out.append(f"{at}: out of bounds")
    return out


def _uses(v: Any) -> set[str]:
    if isinstance(v, str):
        return set(_USE.findall(v))
    return set().union(*map(_uses, v.values() if isinstance(v, dict) else v)) if isinstance(v, dict | list) else set()


def parse_messages(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """messages(row, conv, turn, text) -> one row per block: row, conv, turn, at, kind, call_id, name, uses, errors, body (canonical JSON)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["row", "conv", "turn", "at", "kind", "call_id", "name", "uses", "errors", "body"]
        for b in batches:
            rows = []
            for row, conv, turn, text in zip(b["row"], b["conv"], b["turn"], b["text"], strict=True):
                for at, (kind, body) in enumerate(_TAG.findall(text)):
                    errors: list[str] = []
                    call_id = name = None
                    uses: list[str] = []
                    try:
                        v = json.loads(body)
                        if not isinstance(v, dict):
                            raise ValueError("not an object")
                        call_id = v.get("id") if isinstance(v.get("id"), str) else None
                        if call_id is None:
                            errors.append("$.id: missing")
                        if kind == "call":
                            name = v.get("name") if isinstance(v.get("name"), str) else None
                            arguments = v.get("arguments", {})
                            uses = sorted(_uses(arguments) - {call_id})
                            if call_id in _uses(arguments):
                                errors.append("uses itself")
                            errors += schema_errors(arguments, schemas[name]) if name in schemas else ["unknown tool"]
                        out = canonical(v)
                    except (ValueError, RecursionError) as e:
                        errors, out = [f"not JSON: {type(e).__name__}"], None
                    call_id, name = (None if x is None else _safe(x) for x in (call_id, name))
                    rows.append((row, conv, turn, at, kind, call_id, name, list(map(_safe, uses)), list(map(_safe, errors)), out))
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({"conv": b["conv"].dtype, "turn": b["turn"].dtype})

    kind = {f.name: f.dataType.simpleString() for f in messages.schema}
    return messages.select("row", "conv", "turn", "text").mapInPandas(lean(run), f"row long, conv {kind['conv']}, turn {kind['turn']}, at int, kind string, call_id string, name string, uses array<string>, errors array<string>, body string")


def order_calls(calls: DataFrame, ws: Workspace) -> DataFrame:
    """calls(conv, call_id, uses) -> (conv, call_id, level): 0 uses none, else one more than the highest it uses; null in circles or after them.

    Uses of calls that the conversation does not have are ignored here. An edge (needs, w) says that
    the level is w more than that of ``needs``, or w at least where ``needs`` is null. An edge to a call that waits
    for one other only goes on to that one, so rounds grow with the logarithm of a chain's length. All edges
    lead to calls before their own, so the lowest level left is ready in every round: one that adds no call proves circles.
    A call that a great share of all others use is met by a bounded broadcast when uses are looked up; edges
    are distinct after that, and a join that is still uneven is split by adaptive execution.
    """
    key = ["conv", "call_id"]
    used = ws.save(calls.select(*key, F.explode("uses").alias("needs")).distinct(), "uses")
    known = ws.save(used.groupBy("conv", "needs").agg(F.count("*").alias("n")).join(calls.select("conv", F.col("call_id").alias("needs")), ["conv", "needs"]), "used")
    needs = lookup_join(used, known, ["conv", "needs"], "n").select(*key, "needs", F.lit(1).cast("long").alias("w"))
    edges = ws.save(needs, "needs")
    new = ws.save(calls.select(*key).join(edges, key, "left_anti").withColumn("level", F.lit(0).cast("long")), "level")
    done = [new]
    # Sums run over only in circles, where levels are null.
    more = F.try_add
    while True:
        told = edges.join(new.select("conv", F.col("call_id").alias("needs"), "level"), ["conv", "needs"], "left")
        told = told.select(*key, F.when(F.col("level").isNull(), F.col("needs")).alias("needs"), F.when(F.col("level").isNull(), F.col("w")).otherwise(F.col("level") + F.col("w")).alias("w"))
        told = ws.save(told.groupBy(*key, "needs").agg(F.max("w").alias("w")), "told")
        per = told.groupBy(*key).agg(F.count("needs").alias("open"), F.max("needs").alias("next"), F.max(F.when(F.col("needs").isNotNull(), F.col("w"))).alias("step"), F.max(F.when(F.col("needs").isNull(), F.col("w"))).alias("floor"))
        per = ws.save(per, "waits")
        ready = ws.save(per.where("open = 0").select(*key, F.col("floor").alias("level")), "level")
        if ready.isEmpty():
            break
        done.append(ready)
        if len(done) > 30:
            done = [ws.save(functools.reduce(DataFrame.unionByName, done), "levels")]
        single = per.where("open = 1").select("conv", F.col("call_id").alias("needs"), "next", "step", "floor")
        left = told.join(ready.select(*key), key, "left_anti").join(single, ["conv", "needs"], "left")
        on = F.array(F.struct(F.col("next").alias("needs"), more("w", "step").alias("w")), F.struct(F.lit(None).cast("string").alias("needs"), more("w", "floor").alias("w")))
        went = F.when(F.col("next").isNull(), F.array(F.struct("needs", "w"))).when(F.col("floor").isNull(), F.slice(on, 1, 1)).otherwise(on)
        after = ws.save(left.select(*key, F.explode(went).alias("e")).select(*key, "e.needs", "e.w").groupBy(*key, "needs").agg(F.max("w").alias("w")), "needs")
        ws.drop(edges, told, per)
        edges, new = after, ready
    return calls.select(*key).join(functools.reduce(DataFrame.unionByName, done), key, "left").withColumn("level", F.col("level").cast("int"))


def _tool_rows(conversations: DataFrame, ws: Workspace, **columns: str) -> DataFrame:
    """The messages that hold tool blocks, stored with a row key."""
    rows = pick(conversations, **columns).where(F.contains("text", F.lit("<tool_")))
    return ws.save(rows.withColumn("row", F.monotonically_increasing_id()), "messages")


def _linked(messages: DataFrame, schemas: dict[str, dict], ws: Workspace) -> DataFrame:
    """``link_calls`` of stored messages(row, conv, turn, text), with the row."""
    blocks = ws.save(parse_messages(messages, schemas), "blocks")
    place = F.struct("turn", "row", "at")
    sound = F.col("call_id").isNotNull() & F.col("conv").isNotNull()
    one = lambda k: F.when(F.col("kind") == k, place)
    # One row per identifier; copies shrink before the shuffle.
    firsts = blocks.where(sound).groupBy("conv", "call_id").agg(F.min(one("call")).alias("call"), F.min(one("result")).alias("result"), F.min_by("uses", one("call")).alias("uses"), F.count("*").alias("n"))
    firsts = ws.save(firsts, "firsts")
    levels = ws.save(order_calls(firsts.where("call IS NOT NULL").select("conv", "call_id", "uses"), ws).where("level IS NOT NULL"), "ordered")
    chosen = ws.save(firsts.drop("uses").join(levels, ["conv", "call_id"], "left"), "chosen")
    # An identifier may be repeated without end; blocks without one meet nothing.
    met = lookup_join(blocks.where(sound), chosen, ["conv", "call_id"], "n").drop("n")
    none = blocks.where(~sound)
    named = met.unionByName(none, allowMissingColumns=True)
    own = F.when(F.col("kind") == "call", F.col("call")).otherwise(F.col("result"))
    other = F.when(F.col("kind") == "call", F.col("result")).otherwise(F.col("call"))
    status = (
        F.when(F.col("call_id").isNull() | F.col("body").isNull() | F.col("conv").isNull(), "broken")
        .when(place != own, "repeated")
        .when(other.isNull(), F.when(F.col("kind") == "call", "unanswered").otherwise("orphan"))
        .when(F.struct(F.col("result.turn"), F.col("result.at")) < F.struct(F.col("call.turn"), F.col("call.at")), "early")
        .otherwise("linked")
    )
    return named.select("row", "conv", "turn", "at", "kind", "call_id", "name", "body", "errors", F.when(F.col("kind") == "call", F.col("level")).alias("level"), status.alias("status"), F.when(status == "linked", other["turn"]).alias("partner_turn"))


def link_calls(conversations: DataFrame, schemas: dict[str, dict], conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """One row per call or result: conv, turn, at, kind, call_id, name, body, errors, level, status, partner_turn.

    status: linked; unanswered (a call); orphan (a result); repeated (not the first
    call or result of its identifier); early (a result before its call); broken (no
    identifier or no JSON). Null conversations never link; a null turn comes before all others. Repeated rows
    count as repeats. Messages without blocks, null and empty ones give no rows. A block is held whole.
    """
    ws = Workspace(conversations.sparkSession, "tool-calls")
    return _linked(_tool_rows(conversations, ws, conv=conv_col, turn=turn_col, text=text_col), schemas, ws).drop("row")


def _message(role: str | None, text: str | None, blocks) -> str:
    """A message as canonical JSON; the bodies are canonical already."""
    content = text or ""
    parts = [f'"content":{canonical(_TAG.sub("", content) if blocks is not None else content)}', f'"role":{canonical(role)}']
    for kind, name in (("call", "tool_calls"), ("result", "tool_results")):
        if blocks is not None and len(some := [x for x in blocks if x["kind"] == kind]):
            parts.append(f'"{name}":[' + ",".join(f'{{"{kind}":{x["body"] or "null"},"errors":{canonical(list(x["errors"]))},"status":"{x["status"]}"}}' if kind < "errors" else f'{{"errors":{canonical(list(x["errors"]))},"{kind}":{x["body"] or "null"},"status":"{x["status"]}"}}' for x in some) + "]")
    return "{" + ",".join(parts) + "}"


def format_messages(conversations: DataFrame, schemas: dict[str, dict], conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv, turn, role, n_calls, n_results, n_linked, n_invalid, canonical.

    ``canonical`` is the message as canonical JSON: content without tool blocks, role, and
    its own calls in topological order (those without a level last) and results, each with its status. Null text is an
    empty content; null roles are null. Null and repeated conversations and turns are rows like any other.
    A message is held whole, with its blocks. Other columns are ignored. Empty table: no rows.
    """
    ws = Workspace(conversations.sparkSession, "tool-calls")
    names = {"conv": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    messages = _tool_rows(conversations, ws, **names)
    linked = _linked(messages, schemas, ws)
    per = linked.groupBy("row").agg(
        F.count_if(F.col("kind") == "call").alias("n_calls"),
        F.count_if(F.col("kind") == "result").alias("n_results"),
        F.count_if(F.col("status") == "linked").alias("n_linked"),
        F.count_if((F.size("errors") > 0)).alias("n_invalid"),
        F.sort_array(F.collect_list(F.struct(F.coalesce("level", F.lit(1 << 30)).alias("level"), "at", "kind", "call_id", "body", "status", "errors"))).alias("blocks"),
    )
    counts = ("n_calls", "n_results", "n_linked", "n_invalid")
    told = messages.join(per, "row", "left").select("conv", "turn", "role", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), "text", "blocks")
    rest = pick(conversations, **names).where(~F.coalesce(F.contains("text", F.lit("<tool_")), F.lit(False)))
    plain = rest.select("conv", "turn", "role", *(F.lit(0).cast("long").alias(c) for c in counts), "text", F.lit(None).cast(told.schema["blocks"].dataType).alias("blocks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns=["text", "blocks"]).assign(canonical=[_message(*x) for x in zip(b["role"], b["text"], b["blocks"], strict=True)])

    kind = {f.name: f.dataType.simpleString() for f in rest.schema}
    out = f"conv {kind['conv']}, turn {kind['turn']}, role {kind['role']}, n_calls long, n_results long, n_linked long, n_invalid long, canonical string"
    done = plain.mapInPandas(lean(run), out).unionByName(told.mapInPandas(lean(run), out))
    return done.withColumnsRenamed({"conv": conv_col, "turn": turn_col, "role": role_col})


def op5_tool_calls(spark, sf_dir: str) -> DataFrame:
    return format_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet"), SCHEMAS)


#: The test tables hold no tool calls; with calls, results are tested against brute force.
ORACLE = """
SELECT conv_id, turn, role, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_results, CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_invalid,
       CAST(json_object('content', coalesce(text, ''), 'role', role) AS VARCHAR) AS canonical
FROM conversations
"""
