"""Retrieval plans: hybrid ranking, and the beam walk with its final ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import Knobs
from ..functions.clock import event_clock, recency_weight
from ..functions.text import tag_any, tag_none
from ..operators import vector_index
from ..operators.search import top_k
from ..operators.walk import beam_events, khop_from
from ..schema import Graph, domain_of, live


def _filtered(nodes: DataFrame, domain=None, tags=None, exclude_tags=None) -> DataFrame:
    out = live(nodes)
    if domain is not None:
        out = out.where(F.col("domain") == domain)
    if tags:
        out = out.where(tag_any(tags))
    return out.where(tag_none(exclude_tags)) if exclude_tags else out


def details(graph: Graph, ids: list[str], domain=None, tags=None, exclude_tags=None) -> DataFrame:
    """The live nodes of a list that pass the filters, with their domain from the column or else from the metadata."""
    rows = graph.nodes.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    told = F.coalesce(F.col("domain"), F.get_json_object("metadata", "$.domain") if domain is None and "domain" not in graph.nodes.columns else F.lit(None), F.lit("unknown"))
    return _filtered(graph.nodes, domain, tags, exclude_tags).join(F.broadcast(rows), "id", "left_semi").withColumn("domain", told)


def seeds_of(graph: Graph, query: list[float], k: int, index: vector_index.Index | None = None, probes: int | None = None) -> list[tuple[str, float]]:
    """The k nearest live nodes with their cosines: by a scan of all vectors, or from the cells of an index that are probed."""
    found = top_k(graph, query, k) if index is None else vector_index.top_k(index, graph, query, k, probes)
    return [(r["node_id"], r["sim"]) for r in found.collect()]


def hybrid(graph: Graph, query: list[float], as_of, k: int = 10, depth: int = 2, domain=None, exclude_tags=None, index: vector_index.Index | None = None, probes: int | None = None) -> DataFrame:
    """Top k by (0.5 similarity + 0.5 / path length) * recency over 2k seeds and what lies within `depth` hops of them."""
    hits = seeds_of(graph, query, 2 * k, index, probes)
    walked = khop_from(graph, [i for i, _ in hits], depth)
    named = F.broadcast(graph.nodes.sparkSession.createDataFrame(hits, "node_id string, sim double"))  # 2k rows
    every = walked.join(named, F.col("id") == F.col("node_id"), "left").select("id", "hops", F.coalesce("sim", F.lit(0.0)).alias("sim"))
    rows = _filtered(graph.nodes, domain, None, exclude_tags).join(every, "id")
    score = (0.5 * F.col("sim") + 0.5 / (F.col("hops") + 1)) * recency_weight(event_clock(), as_of)
    return rows.select("id", "node_type", domain_of().alias("domain"), "hops", F.round("sim", 6).alias("sim"), F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def beam(graph: Graph, query: list[float], k: int = 10, knobs: Knobs = Knobs(), domain=None, tags=None, exclude_tags=None, index: vector_index.Index | None = None, probes: int | None = None) -> DataFrame:
    """Beam walk from the nearest seeds; all nodes taken are ranked, cut to 3k, filtered, cut to k."""
    seeds = seeds_of(graph, query, knobs.seeds, index, probes)
    taken = [(i, float(s), level) for level, i, s, _ in beam_events(graph, query, seeds, knobs.picks, knobs.hops)]
    spark = graph.nodes.sparkSession
    rows = spark.createDataFrame(taken, "id string, sim double, level int").orderBy(F.desc("sim"), "id").limit(3 * k)
    keep = _filtered(graph.nodes, domain, tags, exclude_tags)
    return keep.join(F.broadcast(rows), "id").select("id", "node_type", "level", F.round("sim", 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
