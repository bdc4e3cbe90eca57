"""The retrieval endpoints as functions over a graph's tables.

Answers are DataFrames; what an HTTP server would answer with 404 or 400 raises NotFound or BadRequest.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame

from loomgraph.operators import graph, retrieval
from loomgraph.operators.retrieval import NotFound
from loomgraph.operators.workspace import Workspace
from loomgraph.sources.readers import cached


class GraphService:
    def __init__(self, nodes: DataFrame, edges: DataFrame, stats_path: str | None = None):
        self.nodes, self.edges, self.stats_path = nodes, edges, stats_path
        self.spark = nodes.sparkSession

    def health(self) -> dict[str, str]:
        return {"status": "ok", "graph": self.spark.sparkContext.applicationId}

    def stats(self) -> DataFrame:
        """Stored statistics where there are some, else the six keys anew."""
        fresh = lambda: graph.full_stats(self.nodes, self.edges)
        return fresh() if self.stats_path is None else cached(self.spark, self.stats_path, fresh)

    def overview(self) -> DataFrame:
        """nodes, edges, type_counts, rel_counts, top_entities."""
        s = self.stats()
        return s.select(s["total_nodes"].alias("nodes"), s["total_relationships"].alias("edges"), s["node_types"].alias("type_counts"), s["rel_types"].alias("rel_counts"), s["top_connected"].alias("top_entities"))

    def search(self, q: str, limit: int = 10) -> DataFrame:
        return self._some(retrieval.search(self.nodes, q, limit), q)

    def entity(self, name: str) -> DataFrame:
        """The context of the node a name finds."""
        found = self._some(retrieval.by_name(self.nodes, name), name)
        return retrieval.entity_context(self.nodes, self.edges, found.first()["id"])

    def query(self, entity: str | None = None, claim_type: str | None = None, min_confidence: float = 0.0, limit: int = 20) -> DataFrame:
        return retrieval.structured_query(self.nodes, self.edges, entity, claim_type, min_confidence, limit)

    def path(self, source: str, target: str, max_hops: int = 4) -> DataFrame:
        return self._some(retrieval.shortest_path(self.nodes, self._stored, source, target, max_hops), f"{source} to {target}")

    def neighbourhood(self, name: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        found = self._some(retrieval.by_name(self.nodes, name), name)
        return retrieval.neighbourhood(self.nodes, self._stored, found, depth)

    @functools.cached_property
    def _stored(self) -> DataFrame:
        """The edges as a stored table, written by the first search along them and read by all others."""
        return retrieval.stored(self.edges, Workspace(self.spark, "service"))

    def _some(self, df: DataFrame, what: str) -> DataFrame:
        if df.isEmpty():
            raise NotFound(what)
        return df
