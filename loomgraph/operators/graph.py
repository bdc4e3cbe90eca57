"""Property graph: node and edge tables, statistics and degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import CLAIM_TYPES


def node_table(entities: DataFrame) -> DataFrame:
    return entities.select("id", "canonical_name", "entity_type", F.initcap("entity_type").alias("label"), "aliases", "mention_count")


def excerpts(evidence: Column) -> Column:
    """At most five, of 200 characters each."""
    return F.transform(F.slice(evidence, 1, 5), lambda e: F.left(e["excerpt"], F.lit(200)))


def edge_table(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """Claims of known types whose both ends are nodes."""
    ids = nodes.select("id")
    known = claims.where(F.col("claim_type").isin(CLAIM_TYPES))
    kept = known.join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi").join(ids.withColumnRenamed("id", "object_id"), "object_id", "left_semi")
    return kept.select(
        F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), F.upper("claim_type").alias("rel_type"), F.col("id").alias("claim_id"), "confidence", "mention_count", F.coalesce("detail", F.lit("")).alias("detail"), excerpts(F.col("evidence")).alias("excerpts")
    )


def unique_ids(nodes: DataFrame) -> DataFrame:
    """Ids that break uniqueness, with their counts; empty when the constraint holds."""
    return nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def endpoints(edges: DataFrame) -> DataFrame:
    """(id) once per edge and distinct end: a self-loop counts once."""
    return edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))


def degrees(edges: DataFrame) -> DataFrame:
    return endpoints(edges).groupBy("id").agg(F.count("*").alias("degree"))


def top_degree(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    best = degrees(edges).orderBy(F.desc("degree"), "id").limit(top)
    return nodes.join(F.broadcast(best), "id").select("id", F.col("canonical_name").alias("name"), F.col("entity_type").alias("type"), "degree")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes no edge touches; a self-loop touches."""
    return nodes.join(endpoints(edges).distinct(), "id", "left_anti")


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    parts = nodes.agg(F.count("*").alias("n")).withColumn("stat", F.lit("nodes"))
    parts = parts.unionByName(edges.agg(F.count("*").alias("n")).withColumn("stat", F.lit("relationships")))
    return parts.unionByName(isolated(nodes, edges).agg(F.count("*").alias("n")).withColumn("stat", F.lit("isolated"))).select("stat", "n")


def type_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def full_stats(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """One row of six keys: total_nodes, total_relationships, node_types, rel_types, top_connected, isolated_nodes.

    Lists are short: a row per type, and ``top`` nodes.
    """
    listed = lambda df, *cols: F.transform(F.array_sort(F.collect_list(F.struct(*cols))), lambda x: x["r"])
    kinds = lambda df, c, name: type_counts(df, c).agg(F.map_from_entries(listed(df, (-F.col("n")).alias("o"), F.col(c).alias("t"), F.struct(F.col(c).alias("type"), "n").alias("r"))).alias(name))
    best = top_degree(nodes, edges, top).agg(listed(nodes, (-F.col("degree")).alias("o"), "id", F.struct("name", "type", "degree").alias("r")).alias("top_connected"))
    out = nodes.agg(F.count("*").alias("total_nodes"))
    # All sides have one row.
    for one in (edges.agg(F.count("*").alias("total_relationships")), kinds(nodes, "entity_type", "node_types"), kinds(edges, "rel_type", "rel_types"), best, isolated(nodes, edges).agg(F.count("*").alias("isolated_nodes"))):
        out = out.join(F.broadcast(one), F.lit(True))
    return out


def edge_counts(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: relationships made of claims, and claims skipped for want of a node. Claims of unknown types are in neither."""
    known = claims.where(F.col("claim_type").isin(CLAIM_TYPES)).agg(F.count("*").alias("known"))
    made = edge_table(claims, nodes).agg(F.count("*").alias("created"))
    return made.join(F.broadcast(known), F.lit(True)).select("created", (F.col("known") - F.col("created")).alias("skipped"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids(id)``."""
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def top_subgraph(nodes: DataFrame, edges: DataFrame, top: int = 60) -> tuple[DataFrame, DataFrame]:
    ids = degrees(edges).orderBy(F.desc("degree"), "id").limit(top)
    return nodes.join(F.broadcast(ids), "id"), induced(edges, F.broadcast(ids.select("id")))
