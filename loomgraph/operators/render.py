"""Display tables: sizes, labels, colours, widths and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import EDGE_COLOURS, NODE_COLOURS, OTHER_EDGE, OTHER_NODE


def colour(c: Column, known: dict[str, str], other: str) -> Column:
    out = None
    for k, v in known.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(other)


def nodes_interactive(nodes: DataFrame) -> DataFrame:
    size = F.greatest(F.lit(10), F.least(F.lit(40), F.coalesce(F.nullif("mention_count", F.lit(0)), F.lit(1))))
    tip = F.concat("canonical_name", F.lit(" ("), "entity_type", F.lit(")\nMentions: "), F.coalesce("mention_count", F.lit(0)).cast("string"))
    return nodes.select("id", F.left("canonical_name", F.lit(25)).alias("label"), tip.alias("title"), size.cast("long").alias("size"), colour(F.col("entity_type"), NODE_COLOURS, OTHER_NODE).alias("color"))


def edges_interactive(edges: DataFrame) -> DataFrame:
    width = F.greatest(F.lit(1.0), F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.5)) * 3)
    return edges.select("src", "dst", F.col("rel_type").alias("label"), colour(F.col("rel_type"), EDGE_COLOURS, OTHER_EDGE).alias("color"), F.round(width, 6).alias("width"))


def nodes_static(nodes: DataFrame, centre: str | None = None, degree: str = "degree") -> DataFrame:
    """Overview sizes by degree; with a centre, spotlight sizes by mentions."""
    label = F.left("canonical_name", F.lit(20))
    if centre is None:
        size = F.greatest(F.lit(8), F.least(F.lit(50), 2 * F.col(degree)))
        return nodes.select("id", label.alias("label"), size.cast("long").alias("size"), F.lit(1).alias("border"))
    here = F.col("id") == centre
    size = F.when(here, 30).otherwise(F.greatest(F.lit(8), F.least(F.lit(25), F.coalesce("mention_count", F.lit(0)))))
    return nodes.select("id", label.alias("label"), size.cast("long").alias("size"), F.when(here, 3).otherwise(1).alias("border"))


def edges_static(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "rel_type", F.round(F.greatest(F.lit(0.5), 2 * F.coalesce("confidence", F.lit(0.5))), 6).alias("width"))


def safe_name(c: Column) -> Column:
    return F.translate(F.lower(c), " ", "_")


def percent(c: Column) -> Column:
    return F.coalesce(F.format_string("%.0f%%", c * 100), F.lit("?"))


def short(c: Column, most: int = 150) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def path_text(path: DataFrame) -> DataFrame:
    """One text for a path; arrows point forward whatever way an edge goes."""
    part = F.concat(F.when(F.col("rel_type").isNotNull(), F.concat(F.lit(" —["), "rel_type", F.lit("]→ "))).otherwise(""), F.lit("**"), "name", F.lit("** ("), "type", F.lit(")"))
    return path.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", part.alias("t")))), lambda x: x["t"]), "").alias("path"), F.count("*").alias("nodes"))
