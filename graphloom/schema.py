"""The graph as DataFrames: nodes, edges, embeddings and metrics, and the predicates that all operators share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

NODE_COLUMNS = {
    "id": "string", "content": "string", "node_type": "string", "domain": "string", "ts": "timestamp", "referent_ts": "timestamp",
    "access_count": "int", "last_accessed": "timestamp", "source_file": "string", "decayed": "int", "permanent": "int", "tags": "string", "metadata": "string",
}
EDGE_COLUMNS = {"parent_id": "string", "child_id": "string", "weight": "double", "reasoning": "string"}


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    emb: DataFrame
    metrics: DataFrame | None = None

    def with_(self, **parts) -> Graph:
        return Graph(**({"nodes": self.nodes, "edges": self.edges, "emb": self.emb, "metrics": self.metrics} | parts))


def normalized(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The given columns with their types; those that are missing become nulls, those not named go."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def normalize_nodes(df: DataFrame) -> DataFrame:
    """Any version's nodes in the current schema; seeds and core memories become permanent."""
    out = normalized(df, NODE_COLUMNS)
    always = F.col("node_type").isin("seed", "core_memory") & (F.coalesce("permanent", F.lit(0)) == 0)
    return out.withColumn("permanent", F.when(always & F.lit("permanent" not in df.columns), 1).otherwise(F.col("permanent"))) if "permanent" not in df.columns else out


def normalize_edges(df: DataFrame) -> DataFrame:
    """One edge for each ordered pair."""
    return normalized(df, EDGE_COLUMNS).dropDuplicates(["parent_id", "child_id"])


def is_live(prefix: str = "") -> Column:
    return F.coalesce(F.col(f"{prefix}decayed"), F.lit(0)) == 0


def live(nodes: DataFrame) -> DataFrame:
    return nodes.where(is_live())


def domain_of() -> Column:
    return F.coalesce("domain", F.lit("unknown"))


def either_way(edges: DataFrame) -> DataFrame:
    """(a, b) for each edge in both directions, distinct."""
    return edges.select(F.col("parent_id").alias("a"), F.col("child_id").alias("b")).union(edges.select("child_id", "parent_id")).distinct()


def live_edges(graph: Graph) -> DataFrame:
    """Edges with both ends live: two semi-joins."""
    ids = live(graph.nodes).select("id")
    return graph.edges.join(ids.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").join(ids.withColumnRenamed("id", "child_id"), "child_id", "left_semi")
