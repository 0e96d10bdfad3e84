"""The consolidation cycle: link, merge, score, collect, promote, dream. A function of a state; lineage is cut between phases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Knobs, Profile
from ..functions.text import content_id
from ..operators import consolidate as c, lifecycle as life
from ..operators.audit import kept, rows
from ..operators.embed import Encoder, encoded, unembedded
from ..operators.observed import counted_cut
from ..operators.similarity import cosine_pairs, jaccard_pairs, word_classes
from ..schema import Graph, live
from ..shared import cut


def _settled(graph: Graph) -> Graph:
    return graph.with_(nodes=cut(graph.nodes), edges=cut(graph.edges))


def cycle(
    graph: Graph, profile: Profile, as_of, knobs: Knobs = Knobs(), gc_mode: str = "soft", cross_source_only: bool = False, most_links: int | None = None,
    model_fn: Callable[[str], str] | None = None, encoder: Encoder | None = None, model: str = "hashing", audit: DataFrame | None = None, limit: int | None = None, probes: int | None = None,
) -> tuple[Graph, dict]:
    """The new state and what was done. A second cycle on the result links and merges nothing new.

    Phases: link, merge, score, collect, promote, core memories, dream, vectors for what has none (with an encoder). The report's
    `audit` is the log given, within its retention, with a row for each node that a merge or the collection flagged. `limit`: only
    the oldest nodes are linked and merged.
    """
    report: dict = {}

    def kept_and_counted(rows: DataFrame, name: str, count=F.count(F.lit(1))) -> DataFrame:
        """The rows, written; their number goes to the report out of the job that writes them."""
        rows, seen = counted_cut(rows, n=count)
        report[name] = seen["n"]
        return rows

    vectors = kept_and_counted(c.oldest_vectors(graph, limit), "nodes_selected")
    links = kept_and_counted(c.new_links(graph, profile, cross_source_only, most_links, vectors), "links")
    graph = _settled(c.linked(graph, links))
    pairs = cut(cosine_pairs(vectors, profile.dedup, dim=profile.dim))
    clusters = kept_and_counted(c.cliques(pairs), "clusters", F.count_if(F.col("cluster") == F.col("id")))  # a cluster is named by one of its ids
    graph, losers = c.merged(graph, c.keepers(graph, clusters))
    losers = kept_and_counted(losers, "merged")
    log = cut(rows(graph, losers.withColumn("reason", F.lit("dedup_merge")), as_of))
    graph = _settled(graph)
    core = cut(life.core_memory(graph))
    gone = kept_and_counted(life.gc_candidates(graph, as_of, knobs.gc_threshold, knobs.grace_days, knobs.think_penalty, probes), "collected")
    if gc_mode == "off":
        report["collected"] = 0
    else:
        log = cut(log.unionByName(rows(graph, gone.select("id", F.lit("gc_fitness").alias("reason")), as_of)))
    graph = _settled(life.collected(graph, gone, gc_mode))
    up = kept_and_counted(life.promotion_candidates(graph, knobs.promote_at), "permanent")
    marked = graph.nodes.join(up.select(F.col("id").alias("up")), F.col("id") == F.col("up"), "left")
    graph = graph.with_(nodes=marked.withColumn("permanent", F.when(F.col("up").isNotNull(), 1).otherwise(F.col("permanent"))).select(*graph.nodes.columns))
    core = core.join(gone.select("id"), "id", "left_anti") if gc_mode != "off" else core
    report["core"] = {r["change"]: r["n"] for r in core.groupBy("change").agg(F.count("*").alias("n")).collect()}
    graph = _settled(graph.with_(nodes=life.with_core_memories(graph.nodes, core)))
    graph, report["dream"] = dream(graph, links, as_of, model_fn)
    if encoder:
        new = kept_and_counted(encoded(unembedded(graph), encoder, model), "embedded")
        graph = graph.with_(emb=graph.emb.select("node_id", "vector", "model").unionByName(new))
    report["audit"] = log if audit is None else cut(kept(audit, F.lit(as_of)).unionByName(log, allowMissingColumns=True))
    return graph, report


def cycle_by_words(graph: Graph, as_of, link: float = 0.3, merge: float = 0.82, knobs: Knobs = Knobs()) -> tuple[Graph, dict]:
    """The cycle of a graph without vectors: the word sets of its live nodes take their place. Equal texts are merged by class."""
    alive = live(graph.nodes).select("id", "content")
    classes = cut(word_classes(alive))
    pairs = cut(jaccard_pairs(alive, link))
    known = graph.edges.select(F.least("parent_id", "child_id").alias("a"), F.greatest("parent_id", "child_id").alias("b")).distinct()
    links = cut(pairs.where(F.col("sim") < merge).join(known, ["a", "b"], "left_anti"))
    graph = _settled(c.linked(graph, links))
    alike = c.cliques(pairs.where(F.col("sim") >= merge))
    named = classes.join(alike.toDF("cluster", "class"), "class", "left").select(F.coalesce("cluster", "class").alias("cluster"), "id")
    several = cut(named.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster"))
    graph, losers = c.merged(graph, c.keepers(graph, named.join(several, "cluster")))
    gone = cut(life.gc_candidates(graph, as_of, knobs.gc_threshold, knobs.grace_days, knobs.think_penalty))
    graph = _settled(life.collected(graph, gone))
    return graph, {"links": links.count(), "merged": losers.count(), "collected": gone.count()}


def event_counts(events: DataFrame) -> DataFrame:
    """(event, n) of a cycle's log (event, details)."""
    return events.groupBy("event").agg(F.count("*").alias("n"))


def events_of(spark: SparkSession, report: dict) -> DataFrame:
    """A cycle's report as a log: a row for each phase and its number."""
    rows = [(k, int(v)) for k, v in report.items() if isinstance(v, int)] + [(f"core_{k}", int(n)) for k, n in report.get("core", {}).items()]
    return spark.createDataFrame(rows, "event string, n long")


def dream(graph: Graph, links, as_of, model_fn: Callable[[str], str] | None = None) -> tuple[Graph, str | None]:
    """A node made from the strongest pair of two sources, with an edge from each; without a model, from a template."""
    best = c.dream_pair(graph, links).first()
    if best is None:
        return graph, None
    texts = {r["id"]: r["content"] for r in graph.nodes.where(F.col("id").isin(best["a"], best["b"])).select("id", "content").collect()}
    a, b = texts[best["a"]], texts[best["b"]]
    content = model_fn(f"Connect these two statements:\n1. {a}\n2. {b}") if model_fn else f"Connection between: {a[:100]} / {b[:100]}"
    spark = graph.nodes.sparkSession
    node = spark.createDataFrame([(content,)], "content string").select(content_id("content").alias("id"), "content", F.lit("dream").alias("node_type"), F.lit(0).alias("access_count"), F.lit("system_generated").alias("source_file"), F.lit(0).alias("decayed"), F.lit(0).alias("permanent"), F.lit(as_of).alias("ts"))
    new = cut(node.join(graph.nodes.select("id"), "id", "left_anti"))
    edges = new.select(F.explode(F.array(F.lit(best["a"]), F.lit(best["b"]))).alias("parent_id"), F.col("id").alias("child_id"), F.lit(0.8).alias("weight"), F.lit("derived_from - Dream synthesis").alias("reasoning"))
    return graph.with_(nodes=graph.nodes.unionByName(new, allowMissingColumns=True), edges=graph.edges.unionByName(edges, allowMissingColumns=True)), content
