"""Sinks. Spark's commit protocol stands in for write-then-rename."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import unique_ids
from loomgraph.schema import DEDUP_VERSION, SCHEMA_VERSION


def subset_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def extraction_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("extraction_version").json(path)


def graph_tables(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Replace the graph. Node ids must be unique; edges are laid out by type so that a type's claims are one folder."""
    if not unique_ids(nodes).isEmpty():
        raise ValueError("node ids are not unique")
    nodes.sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("rel_type").parquet(f"{path}/edges")


def stats_json(stats: DataFrame) -> DataFrame:
    """The one row of a graph's statistics as JSON text."""
    return stats.select(F.to_json(F.struct("*")).alias("json"))


def graph_document(entities: DataFrame, claims: DataFrame, stats: DataFrame, path: str) -> None:
    """Replace a resolved graph: entities, claims, and one row of versions, time and reduction statistics."""
    entities.write.mode("overwrite").parquet(f"{path}/entities")
    claims.write.mode("overwrite").parquet(f"{path}/claims")
    head = stats.select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(DEDUP_VERSION).alias("dedup_version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.struct("*").alias("stats"))
    head.write.mode("overwrite").json(f"{path}/document")


PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title><svg id="g" viewBox="-320 -320 640 640" width="100%" height="95%"></svg>
<script>const N={nodes},E={edges},at={{}},g=document.getElementById("g"),put=(t,a,s)=>{{const x=document.createElementNS("http://www.w3.org/2000/svg",t);for(const k in a)x.setAttribute(k,a[k]);if(s)x.textContent=s;g.append(x);return x}};
N.forEach((n,i)=>at[n.id]=[280*Math.cos(2*Math.PI*i/N.length),280*Math.sin(2*Math.PI*i/N.length)]);
E.forEach(e=>at[e.src]&&at[e.dst]&&put("line",{{x1:at[e.src][0],y1:at[e.src][1],x2:at[e.dst][0],y2:at[e.dst][1],stroke:"#999","stroke-width":e.width||1}}));
N.forEach(n=>{{put("circle",{{cx:at[n.id][0],cy:at[n.id][1],r:n.size/4,fill:n.color||"#4FC3F7"}});put("text",{{x:at[n.id][0],y:at[n.id][1],"font-size":7}},n.label)}});</script>
"""


def graph_page(nodes: DataFrame, edges: DataFrame, title: str) -> DataFrame:
    """(html): display tables of a bounded subgraph (a top-k or a capped neighbourhood) as one page that needs nothing else."""
    packed = lambda df, name: df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*sorted(df.columns))))).alias(name))
    safe = lambda c: F.regexp_replace(c, "<", r"\\u003c")
    before, rest = PAGE.replace("{{", "{").replace("}}", "}").replace("{title}", html.escape(title)).split("{nodes}")
    middle, after = rest.split("{edges}")
    both = packed(nodes, "n").join(F.broadcast(packed(edges, "e")), F.lit(True))
    return both.select(F.concat(F.lit(before), safe("n"), F.lit(middle), safe("e"), F.lit(after)).alias("html"))


def context_pack(query: str, context: DataFrame) -> DataFrame:
    """One JSON document of a query and its context rows (a node's context or a top-k of claims)."""
    rows = F.collect_list(F.struct(*context.columns))
    return context.agg(F.to_json(F.struct(F.lit(query).alias("query"), rows.alias("context"))).alias("pack"))
