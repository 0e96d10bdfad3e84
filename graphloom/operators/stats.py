"""Descriptive statistics of a graph; each is one pass with partial aggregation, or a few joined at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import cluster_colour, reason_bucket, tag_list
from ..functions.vector import fault
from ..schema import Graph, domain_of, is_live, live


def _count(test) -> F.Column:
    return F.coalesce(F.count_if(test), F.lit(0))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent_id").alias("id")).union(edges.select("child_id"))


def orphans(graph: Graph) -> DataFrame:
    """Live nodes without an edge."""
    return live(graph.nodes).join(endpoints(graph.edges), "id", "left_anti")


def graph_summary(graph: Graph) -> DataFrame:
    n = graph.nodes.agg(
        _count(is_live()).alias("active_nodes"),
        F.count("*").alias("total_nodes"),
        _count(F.col("source_file") == "system_generated").alias("think_node_count"),
        _count(is_live() & (F.col("permanent") > 0)).alias("permanent_nodes"),
        _count(is_live() & (F.col("permanent") == 1)).alias("auto_permanent"),
        _count(is_live() & (F.col("permanent") == 2)).alias("manually_pinned"),
    )
    e = graph.edges.agg(F.count("*").alias("edges"))
    m = graph.emb.join(live(graph.nodes), F.col("node_id") == F.col("id"), "left_semi").agg(F.count("*").alias("embedded_nodes"))
    o = orphans(graph).agg(F.count("*").alias("orphan_count"))
    one = n.join(e).join(m).join(o)  # four single rows
    active = F.greatest(F.lit(1), "active_nodes")
    return one.select(
        "*",
        (F.col("total_nodes") - F.col("active_nodes")).alias("decayed_nodes"),
        F.round(F.col("edges") / active, 2).alias("edge_node_ratio"),
        F.round(F.col("embedded_nodes") / active, 4).alias("embedding_coverage"),
        F.round(F.col("orphan_count") / active * 100, 1).alias("orphan_pct"),
        F.round(F.col("permanent_nodes") / active, 4).alias("permanent_ratio"),
    )


def embedding_coverage(graph: Graph) -> DataFrame:
    embedded = graph.emb.join(live(graph.nodes), F.col("node_id") == F.col("id"), "left_semi").agg(F.count("*").alias("embedded"))
    return embedded.join(live(graph.nodes).where("content is not null and trim(content) <> ''").agg(F.count("*").alias("embeddable")))


def domain_counts(graph: Graph) -> DataFrame:
    return live(graph.nodes).groupBy(domain_of().alias("domain")).agg(F.count("*").alias("n"))


def node_type_top(graph: Graph, k: int = 5) -> DataFrame:
    return live(graph.nodes).groupBy("node_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node_type").limit(k)


def permanence_by_access(graph: Graph) -> DataFrame:
    kind = F.when(F.coalesce("permanent", F.lit(0)) > 0, "permanent").otherwise("other")
    return graph.nodes.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min("access_count").alias("low"), F.round(F.avg("access_count"), 6).alias("mean"), F.max("access_count").alias("high"))


def recommended_threshold(graph: Graph) -> DataFrame:
    """The access count at rank floor(0.75 n) of live nodes with any, at least 5; 10 if there are none.

    Ranked over the counts of equal values, so no task gets all nodes.
    """
    counts = live(graph.nodes).where("access_count > 0").groupBy("access_count").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("access_count"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    return upto.where(F.col("upto") > F.floor(F.col("total") * 0.75)).agg(F.coalesce(F.when(F.min("access_count") < 5, 5).otherwise(F.min("access_count")), F.lit(10)).alias("threshold"))


def integrity(graph: Graph, dim: int) -> DataFrame:
    bad = graph.emb.select("node_id", F.coalesce(fault("vector", dim), F.lit("sound")).alias("state"))
    ids = live(graph.nodes).select("id")
    lost = graph.emb.join(graph.nodes, F.col("node_id") == F.col("id"), "left_anti").select(F.lit("without_node").alias("state"))
    bare = ids.join(graph.emb, F.col("node_id") == F.col("id"), "left_anti").select(F.lit("without_embedding").alias("state"))
    return bad.select("state").union(lost).union(bare).groupBy("state").agg(F.count("*").alias("n"))


def permanence_integrity(graph: Graph) -> DataFrame:
    p = F.coalesce("permanent", F.lit(0))
    return graph.nodes.agg(_count((p > 0) & ~is_live()).alias("permanent_decayed"), _count(~p.isin(0, 1, 2)).alias("odd_value"), _count((p == 1) & (F.col("access_count") < 10)).alias("permanent_low_access"))


def integrity_ids(graph: Graph, dim: int) -> DataFrame:
    """(state, id) of what integrity() counts, the sound vectors aside."""
    bad = graph.emb.select(F.col("node_id").alias("id"), fault("vector", dim).alias("state")).where("state is not null").select("state", "id")
    lost = graph.emb.join(graph.nodes.select("id"), F.col("node_id") == F.col("id"), "left_anti").select(F.lit("without_node").alias("state"), F.col("node_id").alias("id"))
    bare = live(graph.nodes).select("id").join(graph.emb, F.col("node_id") == F.col("id"), "left_anti").select(F.lit("without_embedding").alias("state"), "id")
    return bad.union(lost).union(bare)


def embedding_stats(graph: Graph) -> DataFrame:
    return graph.emb.groupBy("model").agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("dim_low"), F.max(F.size("vector")).alias("dim_high"))


def embedding_overview(graph: Graph) -> DataFrame:
    """One row: nodes (live, with text), how many of them have a vector, how many lack one, the share in per cent and the last update, if vectors have a time."""
    own = live(graph.nodes).where("content is not null and trim(content) <> ''").select("id")
    time = F.max("updated_at") if "updated_at" in graph.emb.columns else F.max(F.lit(None).cast("timestamp"))
    have = graph.emb.join(own, F.col("node_id") == F.col("id"), "left_semi").agg(F.count("*").alias("embedded"), time.alias("last_updated"))
    n = F.greatest(F.col("nodes"), F.lit(1))
    both = own.agg(F.count("*").alias("nodes")).join(have)  # two single rows
    return both.select("nodes", "embedded", (F.col("nodes") - F.col("embedded")).alias("missing"), F.round(F.col("embedded") * 100 / n, 4).alias("coverage_percent"), "last_updated")


def degrees_without(edges: DataFrame) -> DataFrame:
    """(parent_id, child_id, rest): for each edge how many other edges its child has at either end, as if the edge were gone; 0 would be an orphan."""
    ends = edges.select(F.explode(F.array_distinct(F.array("parent_id", "child_id"))).alias("child_id")).groupBy("child_id").agg(F.count("*").alias("n"))
    same = edges.groupBy("parent_id", "child_id").agg(F.count("*").alias("own"))
    return same.join(ends, "child_id").select("parent_id", "child_id", (F.col("n") - F.col("own")).alias("rest"))


def degrees(graph: Graph) -> DataFrame:
    """out_degree and in_degree of every node."""
    out = graph.edges.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("out_degree"))
    into = graph.edges.groupBy(F.col("child_id").alias("id")).agg(F.count("*").alias("in_degree"))
    return graph.nodes.select("id").join(out, "id", "left").join(into, "id", "left").na.fill(0)


def degree_stats(graph: Graph) -> DataFrame:
    return degrees(graph).agg(*[f(c).alias(f"{n}_{c}") for c in ("out_degree", "in_degree") for n, f in (("mean", lambda c: F.round(F.avg(c), 6)), ("most", F.max))])


def hubs(graph: Graph, least: int = 3, k: int = 10) -> DataFrame:
    d = degrees(graph).select("id", (F.col("out_degree") + F.col("in_degree")).alias("degree"))
    return d.where(F.col("degree") >= least).orderBy(F.desc("degree"), "id").limit(k)


def reasoning_buckets(graph: Graph) -> DataFrame:
    return graph.edges.groupBy(reason_bucket().alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("mean_weight"))


def cluster_members(graph: Graph) -> DataFrame:
    """(source_file, node_type, id, colour): the members of source_clusters(), a row each, with the colour of their cluster."""
    return graph.nodes.select(F.coalesce("source_file", F.lit("unknown")).alias("source_file"), "node_type", "id", cluster_colour(F.col("node_type")).alias("colour"))


def source_counts(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy(F.coalesce("source_file", F.lit("unknown")).alias("source_file")).agg(F.count("*").alias("n"))


def node_detail(graph: Graph, node: str) -> DataFrame:
    """(relation, id, content, weight): what a node is derived from and what it leads to, heaviest first."""
    up = graph.edges.where(F.col("child_id") == node).select(F.lit("derived_from").alias("relation"), F.col("parent_id").alias("other"), "weight")
    down = graph.edges.where(F.col("parent_id") == node).select(F.lit("leads_to").alias("relation"), F.col("child_id").alias("other"), "weight")
    both = up.union(down).join(graph.nodes.select("id", "content"), F.col("other") == F.col("id"))
    return both.select("relation", "id", "content", "weight").orderBy("relation", F.desc("weight"), "id")


def of_types(graph: Graph, types: list[str], with_decayed: bool = False) -> Graph:
    """The nodes of some types and the edges between them."""
    n = (graph.nodes if with_decayed else live(graph.nodes)).where(F.col("node_type").isin(types))
    ids = n.select("id")
    e = graph.edges.join(ids.toDF("parent_id"), "parent_id", "left_semi").join(ids.toDF("child_id"), "child_id", "left_semi")
    return graph.with_(nodes=n, edges=e.select(*graph.edges.columns))


def brain_stats(graph: Graph, hotspot: str = "hotspot", near: float = 0.82) -> DataFrame:
    """One row: live nodes, edges, share with a vector, hotspots, orphans and pairs that are nearly the same."""
    from .similarity import live_vectors, pair_count

    n = live(graph.nodes).agg(F.count("*").alias("nodes"), _count(F.col("node_type") == hotspot).alias("hotspots"))
    e = graph.edges.agg(F.count("*").alias("edges"))
    m = live_vectors(graph).agg(F.count("*").alias("embedded"))
    o = orphans(graph).agg(F.count("*").alias("orphans"))
    d = pair_count(live_vectors(graph), near).select(F.col("n").alias("near_duplicates"))
    share = F.round(F.col("embedded") / F.greatest(F.lit(1), "nodes"), 4)
    return n.join(e).join(m).join(o).join(d).withColumn("coverage", share).drop("embedded")  # five single rows


def source_clusters(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy("source_file", "node_type").agg(F.count("*").alias("size"), F.min("id").alias("first_id"))


def tag_counts(graph: Graph) -> DataFrame:
    return graph.nodes.select(F.explode(tag_list()).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def recent_activity(graph: Graph, k: int = 3) -> DataFrame:
    return live(graph.nodes).select("id", "node_type", "ts").orderBy(F.desc("ts"), "id").limit(k)


def underrepresented_domains(graph: Graph, as_of, days: int = 30, k: int = 3) -> DataFrame:
    made = F.col("source_file").like("system\\_generated%") | F.col("source_file").like("extractor%")
    recent = live(graph.nodes).where(made & (F.col("ts") >= as_of - F.expr(f"INTERVAL {days} DAYS")))
    return recent.groupBy(domain_of().alias("domain")).agg(F.count("*").alias("n")).orderBy("n", "domain").limit(k)


def recent_count(graph: Graph, as_of, days: int = 7) -> DataFrame:
    return graph.nodes.agg(_count(F.col("ts") > as_of - F.expr(f"INTERVAL {days} DAYS")).alias("n"))
