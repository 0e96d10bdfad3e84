"""Lifecycle: access, decay, permanence, garbage collection, audit log. Each takes a state and returns rows or a new state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.clock import age_days
from ..schema import Graph, either_way, is_live, live
from ..shared import cut

def _spared() -> F.Column:
    return F.coalesce("permanent", F.lit(0)) == 0


def touched(nodes: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """Nodes with the access of `ids` counted."""
    hit = ids.select(F.col("id").alias("hit")).distinct()
    both = nodes.join(hit, F.col("id") == F.col("hit"), "left")
    out = both.withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.col("hit").isNotNull().cast("int"))
    if "last_accessed" in nodes.columns:
        out = out.withColumn("last_accessed", F.when(F.col("hit").isNotNull(), as_of).otherwise(F.col("last_accessed")))
    return out.select(*nodes.columns)


def decay_candidates(graph: Graph, as_of, days: int = 14) -> DataFrame:
    """Live, not permanent, never accessed, old nodes without a live neighbour (over edges made symmetric, so an equi-join)."""
    alive = live(graph.nodes).select(F.col("id").alias("b"))
    anchored = either_way(graph.edges).join(alive, "b", "left_semi").select(F.col("a").alias("id"))
    old = live(graph.nodes).where(_spared() & (F.col("access_count") == 0) & (F.col("ts") < as_of - F.expr(f"INTERVAL {days} DAYS")))
    return old.join(anchored, "id", "left_anti").select("id")


def cascade(graph: Graph, dead: DataFrame, as_of, days: int = 30) -> DataFrame:
    """(id, round): nodes that decay as all their parents have; a fixpoint, starting from dead or decayed parents.

    Only children of what died in the round before are looked at again.
    """
    may = live(graph.nodes).where(_spared() & (F.col("access_count") == 0) & (age_days("ts", as_of) >= days)).select("id")
    may = cut(may.join(dead.select("id"), "id", "left_anti"))
    gone = cut(graph.nodes.where(~is_live()).select("id").union(dead.select("id")).distinct())
    known = graph.nodes.select("id", F.lit(True).alias("there"))
    # the edges that matter: into what may decay. Those from parents that are alive hold it until the parent goes
    into = graph.edges.join(may.withColumnRenamed("id", "child_id"), "child_id", "left_semi").select("parent_id", "child_id").distinct()
    into = into.join(known, F.col("parent_id") == F.col("id"), "left").drop("id").join(gone.withColumn("gone", F.lit(True)), F.col("parent_id") == F.col("id"), "left").drop("id")
    into = cut(into.select("parent_id", "child_id", (F.coalesce("there", F.lit(False)) & F.col("gone").isNull()).alias("holds")))
    new, died, out, n = dead.select("id").distinct(), None, None, 0
    while True:
        n += 1
        touched_now = into.join(new, F.col("parent_id") == F.col("id"), "left_semi").select("child_id").distinct()
        held = into.where("holds").join(touched_now, "child_id", "left_semi")
        if died is not None:
            touched_now = touched_now.join(died, F.col("child_id") == F.col("id"), "left_anti")
            held = held.join(died, F.col("parent_id") == F.col("id"), "left_anti")
        new = cut(touched_now.join(held, "child_id", "left_anti").select(F.col("child_id").alias("id")))
        if not new.take(1):
            return out if out is not None else new.withColumn("round", F.lit(0))
        named = new.withColumn("round", F.lit(n))
        out, died = (named, new) if out is None else (out.unionByName(named), died.unionByName(new))


def decayed(graph: Graph, ids: DataFrame) -> Graph:
    gone = ids.select(F.col("id").alias("gone")).distinct()
    nodes = graph.nodes.join(gone, F.col("id") == F.col("gone"), "left").withColumn("decayed", F.when(F.col("gone").isNotNull(), 1).otherwise(F.col("decayed")))
    return graph.with_(nodes=nodes.select(*graph.nodes.columns))


def auto_decay(graph: Graph, as_of, days: int = 14, cascading: bool = True) -> tuple[Graph, DataFrame]:
    """New state, and (id, reason) of what decayed."""
    direct = cut(decay_candidates(graph, as_of, days))
    log = direct.withColumn("reason", F.lit("direct"))
    if cascading:
        start = direct.union(graph.nodes.where(~is_live()).select("id")).distinct()
        log = log.unionByName(cascade(graph, start, as_of).select("id", F.lit("cascade").alias("reason")))
    return decayed(graph, log), log


def promotion_candidates(graph: Graph, at: int = 10) -> DataFrame:
    return live(graph.nodes).where(_spared() & (F.col("access_count") >= at)).select("id")


def pinned(nodes: DataFrame, ids: list[str], level: int = 2) -> DataFrame:
    """Nodes with `ids` pinned (2), promoted (1) or released (0)."""
    return nodes.withColumn("permanent", F.when(F.col("id").isin(ids), level).otherwise(F.col("permanent")))


def fitness(graph: Graph) -> DataFrame:
    """(id, branching, cross_links, fitness) of live nodes: children, and half of each cross link at either end."""
    out = graph.edges.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("branching"))
    cross = graph.edges.where(F.col("reasoning").ilike("%cross_link%"))
    ends = cross.select(F.col("parent_id").alias("id")).union(cross.where("parent_id <> child_id").select("child_id"))
    links = ends.groupBy("id").agg(F.count("*").alias("cross_links"))
    both = live(graph.nodes).select("id").join(out, "id", "left").join(links, "id", "left").na.fill(0)
    return both.withColumn("fitness", F.col("branching") + 0.5 * F.col("cross_links"))


def gc_candidates(graph: Graph, as_of, threshold: float = 0.05, grace_days: int = 7, penalty: float = 1.5, probes: int | None = None, seed: int = 0) -> DataFrame:
    """(id, fitness, threshold) of live nodes that are not permanent, were not accessed within the grace period (one that never was has
    no grace) and are not fit enough; of these `probes` by the order of a seeded hash, or all.
    """
    limit = F.when(F.coalesce("source_file", F.lit("")).contains("think_cycle"), threshold * penalty).otherwise(threshold)
    seen = age_days("last_accessed", as_of) if "last_accessed" in graph.nodes.columns else F.lit(None).cast("double")
    old = live(graph.nodes).where(_spared() & (F.coalesce(seen, F.lit(float("inf"))) >= grace_days)).withColumn("threshold", limit)
    found = old.join(fitness(graph), "id").where(F.col("fitness") < F.col("threshold")).select("id", "fitness", "threshold")
    return found if probes is None else found.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(probes)


def collected(graph: Graph, ids: DataFrame, mode: str = "soft") -> Graph:
    """soft: flagged; hard: gone from all three tables; off: as it was."""
    if mode == "off":
        return graph
    if mode == "soft":
        return decayed(graph, ids)
    gone = cut(ids.select(F.col("id").alias("gone")).distinct())
    edges = graph.edges.join(gone, F.col("parent_id") == F.col("gone"), "left_anti").join(gone, F.col("child_id") == F.col("gone"), "left_anti")
    return graph.with_(nodes=graph.nodes.join(gone, F.col("id") == F.col("gone"), "left_anti"), edges=edges, emb=graph.emb.join(gone, F.col("node_id") == F.col("gone"), "left_anti"))


def core_memory(graph: Graph) -> DataFrame:
    """(id, change): the floor(sqrt N) fittest live nodes should be core memories; who is promoted, kept or demoted."""
    f = fitness(graph)
    n = int(f.count() ** 0.5)
    should = f.orderBy(F.desc("fitness"), "id").limit(n).select("id")
    has = live(graph.nodes).where("node_type = 'core_memory'").select(F.col("id").alias("has"))
    both = should.join(has, F.col("id") == F.col("has"), "full")
    return both.select(F.coalesce("id", "has").alias("id"), F.when(F.col("has").isNull(), "promote").when(F.col("id").isNull(), "demote").otherwise("keep").alias("change"))


def with_core_memories(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    c = changes.toDF("changed", "change")
    kind = F.when(F.col("change") == "promote", "core_memory").when((F.col("change") == "demote") & (F.col("node_type") != "seed"), "derived").otherwise(F.col("node_type"))
    up = F.col("change") == "promote"
    both = nodes.join(c, F.col("id") == F.col("changed"), "left").withColumn("node_type", kind)
    return both.withColumn("permanent", F.when(F.coalesce(up, F.lit(False)) & (F.coalesce("permanent", F.lit(0)) == 0), 1).otherwise(F.col("permanent"))).select(*nodes.columns)


def fitness_with_depth(graph: Graph, depth: DataFrame) -> DataFrame:
    """fitness() with a tenth of each node's derivation depth (id, depth) added."""
    both = fitness(graph).join(depth.toDF("deep", "depth"), F.col("id") == F.col("deep"), "left")
    d = F.coalesce("depth", F.lit(0))
    return both.select("id", "branching", "cross_links", d.alias("depth"), (F.col("fitness") + 0.1 * d).alias("fitness"))


def decayed_by_type(graph: Graph) -> DataFrame:
    """Decayed nodes by type with their share of all that decayed."""
    by = graph.nodes.where(~is_live()).groupBy("node_type").agg(F.count("*").alias("n"))
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def permanent_nodes(nodes: DataFrame) -> DataFrame:
    """(id, node_type, access_count, level) of pinned and promoted live nodes."""
    return live(nodes).where(F.coalesce("permanent", F.lit(0)) > 0).select("id", "node_type", "access_count", F.when(F.col("permanent") == 2, "pinned").otherwise("promoted").alias("level"))


def prunable(graph: Graph, as_of, days: int = 14) -> DataFrame:
    """(id, reason) of what auto_decay() would flag, without flagging it."""
    return auto_decay(graph, as_of, days)[1]
