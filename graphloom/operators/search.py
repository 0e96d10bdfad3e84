"""Search: vector top-k, novelty, nearest neighbours, keywords, content, tags, related nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import keywords, relevance, tag_any
from ..functions.vector import cosine, literal, sound
from ..schema import Graph, live
from .similarity import best_at_least, top_each


def scored(emb: DataFrame, query: list[float]) -> DataFrame:
    """node_id and cosine to the query, for sound vectors of its dimension; a query without a norm gives 0."""
    return sound(emb, len(query)).select("node_id", cosine(F.col("vector"), literal(query)).alias("sim"))


def top_k(graph: Graph, query: list[float], k: int, include_decayed: bool = False) -> DataFrame:
    emb = graph.emb if include_decayed else graph.emb.join(live(graph.nodes), F.col("node_id") == F.col("id"), "left_semi")
    return scored(emb, query).orderBy(F.desc("sim"), "node_id").limit(k)


def novelty(graph: Graph, candidates: DataFrame, threshold: float, dim: int | None = None) -> DataFrame:
    """For (cand_id, vector): nearest live node, its cosine (0 at least) and whether the candidate is new."""
    own = live(graph.nodes).select("id").join(graph.emb, F.col("id") == F.col("node_id")).select("node_id", "vector")
    best = best_at_least(candidates.select(F.col("cand_id").alias("node_id"), "vector"), own, 0.0, dim)
    out = candidates.join(best, F.col("cand_id") == F.col("a"), "left")
    return out.select("cand_id", F.coalesce("sim", F.lit(0.0)).alias("max_sim"), F.col("b").alias("nearest"), (F.coalesce("sim", F.lit(0.0)) < threshold).alias("is_novel"))


def nearest(emb: DataFrame, dim: int | None = None) -> DataFrame:
    """Every node's largest cosine to another node."""
    return best_at_least(emb, emb, -1.5, dim, True).select(F.col("a").alias("node_id"), F.col("sim").alias("max_sim"))


def similar_links(graph: Graph, new: DataFrame, k: int = 3, least: float = 0.3, dim: int | None = None) -> DataFrame:
    """(a, b, sim): the live nodes that each new node (node_id, vector) gets an edge from: its k most similar ones."""
    own = live(graph.nodes).select("id").join(graph.emb, F.col("id") == F.col("node_id")).select("node_id", "vector")
    return top_each(new.select("node_id", "vector"), own, k, least, dim)


def diverse(graph: Graph, candidates: DataFrame, most: float = 0.85, dim: int | None = None) -> DataFrame:
    """The candidates (cand_id, vector) that no other live node is more similar to than `most`."""
    own = live(graph.nodes).select("id").join(graph.emb, F.col("id") == F.col("node_id")).select("node_id", "vector")
    near = best_at_least(candidates.select(F.col("cand_id").alias("node_id"), "vector"), own, most, dim, True).where(F.col("sim") > most)
    return candidates.join(near, F.col("cand_id") == F.col("a"), "left_anti")


def private_candidates(graph: Graph, as_of, days: int, tag: str = "vault:private") -> DataFrame:
    """Live nodes with a tag that are older than `days`, oldest first."""
    return live(graph.nodes).where(tag_any([tag]) & (F.col("ts") < as_of - F.expr(f"INTERVAL {days} DAYS"))).orderBy("ts", "id")


def saturated_themes(graph: Graph, as_of, days: int = 14) -> DataFrame:
    """What think cycles have made of late, newest first."""
    return live(graph.nodes).where((F.col("source_file") == "system_generated") & (F.col("ts") > as_of - F.expr(f"INTERVAL {days} DAYS"))).orderBy(F.desc("ts"), "id")


def content_like(graph: Graph, fragment: str, k: int) -> DataFrame:
    return live(graph.nodes).where(F.col("content").ilike(f"%{fragment}%")).select("id", F.lit(1.0).alias("score")).orderBy("id").limit(k)


def keyword_top(graph: Graph, query: str, k: int = 5, least: float = 0.1) -> DataFrame:
    score = F.round(relevance(F.col("content"), keywords(query)), 6)
    return live(graph.nodes).select("id", score.alias("score")).where(F.col("score") > least).orderBy(F.desc("score"), "id").limit(k)


def related(graph: Graph, node: str, k: int = 10) -> DataFrame:
    """Neighbours by either direction, a pair with both edges twice."""
    one = graph.edges.where(F.col("parent_id") == node).select(F.col("child_id").alias("id"), "weight", F.lit("out").alias("direction"))
    two = graph.edges.where(F.col("child_id") == node).select(F.col("parent_id").alias("id"), "weight", F.lit("in").alias("direction"))
    return one.union(two).join(live(graph.nodes).select("id"), "id").orderBy(F.desc("weight"), "id", "direction").limit(k)


def parents_ranked(graph: Graph, node: str) -> DataFrame:
    return graph.edges.where(F.col("child_id") == node).join(graph.nodes, F.col("parent_id") == F.col("id")).select("parent_id", "weight", "reasoning", "node_type").orderBy(F.desc("weight"), "parent_id")
