"""Search, lookup, context, claims, paths and neighbourhoods over node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import induced
from loomgraph.operators.workspace import Workspace
from loomgraph.schema import CLAIM_TYPES

EDGE = ("src", "dst", "rel_type", "confidence", "mention_count")


class NotFound(LookupError):
    pass


class BadRequest(ValueError):
    pass


def _low(q: str) -> Column:
    return F.lower(F.lit(q))


def _any_alias(test) -> Column:
    return F.exists(F.coalesce("aliases", F.array().cast("array<string>")), test)


def search(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Names or aliases that hold the query literally in any case, most mentions first."""
    if not query:
        raise BadRequest("an empty query")
    hit = F.contains(F.lower("canonical_name"), _low(query)) | _any_alias(lambda a: F.contains(F.lower(a), _low(query)))
    return nodes.where(hit).orderBy(F.desc_nulls_first("mention_count"), "id").limit(limit)


def by_name(nodes: DataFrame, name: str) -> DataFrame:
    """At most one node: equal name, else equal alias, else the shortest name that holds it."""
    low = F.lower("canonical_name")
    rank = F.when(low == _low(name), 1).when(_any_alias(lambda a: F.lower(a) == _low(name)), 2).when(F.contains(low, _low(name)), 3)
    ranked = nodes.withColumn("rank", rank).where("rank IS NOT NULL")
    return ranked.orderBy("rank", F.when(F.col("rank") == 3, F.length("canonical_name")).otherwise(0), "id").limit(1)


def relationships(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per edge end of ``ids(id)``: outgoing, then incoming ones; a self-loop is both."""
    few = F.broadcast(ids.select("id"))  # one node, or a top-k
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    out = edges.join(few.withColumnRenamed("id", "src"), "src").select(F.col("src").alias("id"), F.lit("outgoing").alias("direction"), F.col("dst").alias("other_id"), *rest)
    into = edges.join(few.withColumnRenamed("id", "dst"), "dst").select(F.col("dst").alias("id"), F.lit("incoming").alias("direction"), F.col("src").alias("other_id"), *rest)
    names = nodes.select(F.col("id").alias("other_id"), F.col("canonical_name").alias("other_name"), F.col("entity_type").alias("other_type"))
    return out.unionByName(into).join(names, "other_id")


def entity_context(nodes: DataFrame, edges: DataFrame, entity_id: str) -> DataFrame:
    """One row: the node, its relationships (outgoing first, by confidence) and degree, in which self-loops count twice."""
    node = nodes.where(F.col("id") == entity_id)
    rel = relationships(nodes, edges, node)
    order = F.struct((F.col("direction") == "incoming").alias("d"), (-F.coalesce("confidence", F.lit(-1.0))).alias("c"), "other_id", "rel_type")
    packed = rel.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct("rel_type", "direction", "other_id", "other_name", "other_type", "confidence", "mention_count").alias("r")))), lambda x: x["r"]).alias("relationships"), F.count("*").alias("degree"))
    return node.join(packed, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def display(context: DataFrame, aliases: int = 10, relationships: int = 15) -> DataFrame:
    """A context as a page shows it: the first aliases and relationships, and how many there are."""
    names = F.coalesce("aliases", F.array().cast("array<string>"))
    rel = F.coalesce("relationships", F.array().cast(context.schema["relationships"].dataType))
    return context.withColumns({"n_aliases": F.size(names).cast("long"), "n_relationships": F.size(rel).cast("long"), "aliases": F.slice(names, 1, aliases), "relationships": F.slice(rel, 1, relationships)})


def claims_by_type(nodes: DataFrame, edges: DataFrame, rel_type: str, min_confidence: float = 0.0, limit: int = 20) -> DataFrame:
    """Edges of a type with their names, surest first. Unknown types are refused."""
    if rel_type.lower() not in CLAIM_TYPES:
        raise BadRequest(f"unknown claim type {rel_type}")
    top = edges.where((F.col("rel_type") == rel_type.upper()) & (F.col("confidence") >= min_confidence)).orderBy(F.desc_nulls_first("confidence"), F.desc_nulls_first("mention_count"), "src", "dst").limit(limit)
    name = lambda k, n: nodes.select(F.col("id").alias(k), F.col("canonical_name").alias(n))
    return top.join(name("src", "subject"), "src").join(name("dst", "object"), "dst").select("src", "dst", "subject", "rel_type", "object", "confidence", "mention_count")


def structured_query(nodes: DataFrame, edges: DataFrame, entity: str | None = None, claim_type: str | None = None, min_confidence: float = 0.0, limit: int = 20) -> DataFrame:
    """An entity's relationships, filtered by type and confidence (null is 0; a floor of 0 keeps all), or a type's claims. The entity goes first."""
    if entity:
        found = by_name(nodes, entity)
        if found.isEmpty():
            raise NotFound(entity)
        rel = relationships(nodes, edges, found)
        if claim_type:
            rel = rel.where(F.col("rel_type") == claim_type.upper())
        if min_confidence > 0:
            rel = rel.where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
        return rel.orderBy(F.desc("direction"), F.desc_nulls_last("confidence"), "other_id", "rel_type").limit(limit)
    if claim_type:
        return claims_by_type(nodes, edges, claim_type, min_confidence, limit)
    raise BadRequest("neither entity nor claim type")


def stored(edges: DataFrame, ws: Workspace) -> DataFrame:
    """``edges`` itself where it is a table of a workspace, else written once: every step of a search reads it again."""
    return edges if hasattr(edges, "_loom_path") else ws.save(edges, "edges")


def beside(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id) at the other end of some edge of ``ids(id)``, either way. A small ``ids`` is broadcast, so edges are read and not moved."""
    at = ids.select(F.col("id").alias("at"))
    out = edges.select("src", F.col("dst").alias("id")).join(at, F.col("src") == F.col("at")).select("id")
    into = edges.select(F.col("src").alias("id"), "dst").join(at, F.col("dst") == F.col("at")).select("id")
    return out.unionByName(into).distinct()


def reach(edges: DataFrame, start: DataFrame, depth: int, ws: Workspace) -> DataFrame:
    """(id, dist) of nodes within ``depth`` of ``start(id)``, by levels; start has distance 0. ``edges`` should be a stored table."""
    seen = ws.save(start.select("id", F.lit(0).alias("dist")), "level")
    frontier = seen
    for d in range(1, depth + 1):
        frontier = ws.save(beside(edges, frontier).join(seen, "id", "left_anti").select("id", F.lit(d).alias("dist")), "level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def circle(edges: DataFrame, start: DataFrame, depth: int) -> int | None:
    """Length, at most 3, of the shortest closed trail through the one start node: its self-loop, a double edge, a triangle."""
    touch = edges.join(F.broadcast(start.select(F.col("id").alias("c"))), (F.col("src") == F.col("c")) | (F.col("dst") == F.col("c"))).select(F.when(F.col("src") == F.col("c"), F.col("dst")).otherwise(F.col("src")).alias("n"), "c")
    per = touch.groupBy("n").agg(F.count("*").alias("k"), F.max(F.col("n") == F.col("c")).alias("loop"))
    loop, double = per.agg(F.max("loop"), F.max(F.when(~F.col("loop"), F.col("k")))).first()
    if loop and depth >= 1:
        return 1
    if double and double > 1 and depth >= 2:
        return 2
    if double and depth >= 3:
        mine = per.where("NOT loop").select(F.col("n").alias("id"))
        if not induced(edges.where("src <> dst"), mine).isEmpty():
            return 3
    return None


def neighbourhood(nodes: DataFrame, edges: DataFrame, start: DataFrame, depth: int = 2, cap: int = 50, clamp: int | None = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` of the one ``start`` node, nearest and most mentioned first up to ``cap``, with the centre; and the edges among them.

    The centre takes one of the places when it lies on a circle of at most ``depth`` edges, else it comes on top.
    """
    depth = min(depth, clamp) if clamp is not None else depth
    ws = Workspace(nodes.sparkSession, "neighbourhood")
    start, edges = ws.save(start.select("id").limit(1), "start"), stored(edges, ws)
    near = reach(edges, start, max(depth, 0), ws).where("dist > 0")
    if depth > 0 and (c := circle(edges, start, depth)):
        near = near.unionByName(start.select("id", F.lit(c).alias("dist")))
    best = near.join(nodes, "id").orderBy("dist", F.desc_nulls_first("mention_count"), "id").limit(cap).select("id", "dist")
    ids = ws.save(best.unionByName(start.select("id", F.lit(0).alias("dist"))).groupBy("id").agg(F.min("dist").alias("dist")), "ids")
    return nodes.join(F.broadcast(ids), "id"), induced(edges, F.broadcast(ids.select("id")))  # cap + 1 rows at most


def shortest_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, max_hops: int = 4) -> DataFrame:
    """(step, id, name, type, rel_type, src, dst): a shortest undirected path between the shortest names that hold the two texts.

    Of equal paths, the one with the smallest ids from the end. No rows if there is none or both ends are one node.
    """
    ws = Workspace(nodes.sparkSession, "path")
    pick = lambda q: nodes.where(F.contains(F.lower("canonical_name"), _low(q))).orderBy(F.length("canonical_name"), "id").select("id").limit(1)
    a, b = ws.save(pick(source), "source"), ws.save(pick(target), "target")
    edges = stored(edges, ws)
    levels = [a]
    seen = a
    found = False
    if not a.isEmpty() and not b.isEmpty() and a.join(b, "id", "left_semi").isEmpty():
        for _ in range(max_hops):
            level = ws.save(beside(edges, levels[-1]).join(seen, "id", "left_anti"), "level")
            if level.isEmpty():
                break
            levels.append(level)
            seen = seen.unionByName(level)
            if not level.join(b, "id", "left_semi").isEmpty():
                found = True
                break
    # Walk back: at most max_hops single rows.
    steps = []
    if found:
        at = b.first()[0]
        steps.append(at)
        for level in reversed(levels[:-1]):
            near = edges.where(F.col("src") == at).select(F.col("dst").alias("id")).unionByName(edges.where(F.col("dst") == at).select(F.col("src").alias("id")))
            at = near.join(level, "id", "left_semi").agg(F.min("id")).first()[0]
            steps.append(at)
        steps.reverse()
    path = nodes.sparkSession.createDataFrame([(i, x) for i, x in enumerate(steps)], "step int, id string")
    hops = nodes.sparkSession.createDataFrame([(i, *sorted(p)) for i, p in enumerate(zip(steps, steps[1:], strict=False), 1)], "step int, x string, y string")
    rel = edges.join(F.broadcast(hops), (F.least("src", "dst") == F.col("x")) & (F.greatest("src", "dst") == F.col("y"))).groupBy("step").agg(F.min(F.struct("rel_type", "src", "dst")).alias("r"))
    named = path.join(nodes.select("id", F.col("canonical_name").alias("name"), F.col("entity_type").alias("type")), "id")
    return named.join(rel, "step", "left").select("step", "id", "name", "type", "r.rel_type", "r.src", "r.dst")
