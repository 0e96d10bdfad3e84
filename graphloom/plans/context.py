"""Texts for a prompt: the three-layer session context, keyword context with its chains, retrieval results, the summary report.

Each layer is a small query whose few rows come to the driver, where the text is put together.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..config import Knobs
from ..functions.text import summary
from ..operators import audit, lineage, metrics, search, stats, walk
from ..operators.lifecycle import touched
from ..schema import Graph, domain_of, live
from . import retrieve


def overview(graph: Graph) -> str:
    """How many nodes and edges there are, and the three most frequent types."""
    n = live(graph.nodes).count()
    text = f"Graph: {n} nodes, {graph.edges.count()} edges."
    types = [f"{r['n']} {r['node_type']}" for r in stats.node_type_top(graph, 3).collect()]
    return f"{text} Types: {', '.join(types)}." if types else text


def recent(graph: Graph, as_of, domain: str | None = None, k: int = 3) -> str:
    """The nodes that changed last, one a line, with `today` or month and day."""
    changed = F.coalesce(F.col("last_updated"), F.col("ts")) if "last_updated" in graph.nodes.columns else F.col("ts")
    rows = live(graph.nodes).withColumn("changed", changed).where("changed is not null")
    if domain is not None:
        rows = rows.where(F.col("domain") == domain)
    when = F.when(F.to_date("changed") == F.to_date(F.lit(as_of)), "today").otherwise(F.date_format("changed", "MM-dd"))
    some = rows.orderBy(F.desc("changed"), "id").limit(k).select("node_type", summary("content").alias("text"), when.alias("when"), "changed", "id").collect()
    some.sort(key=lambda r: r["id"])
    some.sort(key=lambda r: r["changed"], reverse=True)
    lines = [f"{i}. [{r['node_type']}] {r['text']} ({r['when']})" for i, r in enumerate(some, 1)]
    return "\n".join(lines) or "No recent activity found."


def _line(r) -> str:
    return f"[{r['node_type'].upper()}] {r['content']}" + (f" (Domain: {r['domain']})" if r["domain"] and r["domain"] != "unknown" else "")


def within_budget(rows: list, budget: int) -> tuple[list, int]:
    """The first rows up to the one that overflows the budget, and their tokens."""
    out, used = [], 0
    for r in rows:
        size = len(_line(r)) // 3
        if used + size > budget:
            break
        out.append(r)
        used += size
    return out, used


def results_text(rows: list, paths: bool = False) -> str:
    """Ranked rows (node_type, content, domain, score, and path with `paths`), numbered, each with its relevance."""
    if not rows:
        return "No relevant context found."
    lines = ["=== RELEVANT CONTEXT ==="]
    for i, r in enumerate(rows, 1):
        lines.append(f"{i}. {_line(r)}")
        if paths and len(r["path"]) > 1:
            lines.append("   Path: " + ("... → " if len(r["path"]) > 3 else "") + " → ".join(r["path"][-3:]))
        lines += [f"   Relevance: {r['score']:.3f}", ""]
    return "\n".join(lines)


def _with_content(graph: Graph, ranked: DataFrame) -> list:
    few = F.broadcast(ranked.select("id", "score"))  # a top-k
    return graph.nodes.select("id", "content", "node_type", domain_of().alias("domain")).join(few, "id").orderBy(F.desc("score"), "id").collect()


def session_context(graph: Graph, as_of, query: list[float] | None = None, domain=None, tags=None, exclude_tags=None, knobs: Knobs = Knobs()) -> tuple[str, list[str], int, Graph]:
    """(text, ids used, tokens, the state with their access counted): overview, what is recent, and with a query what the beam walk finds
    within half the token budget.
    """
    first, second = overview(graph), recent(graph, as_of, domain)
    parts, used, tokens = ["=== GRAPH OVERVIEW ===", first, "", "=== RECENT ACTIVITY ===", second], [], 0
    if query is not None:
        rows, tokens = within_budget(_with_content(graph, retrieve.beam(graph, query, knobs.top_k, knobs, domain, tags, exclude_tags)), knobs.token_budget // 2)
        used = [r["id"] for r in rows]
        if rows:
            parts += ["", "=== RELEVANT CONTEXT ===", "\n".join(f"{i}. {_line(r)}" for i, r in enumerate(rows, 1))]
            ids = graph.nodes.sparkSession.createDataFrame([(i,) for i in used], "id string")
            graph = graph.with_(nodes=touched(graph.nodes, ids, F.lit(as_of)))
    parts += ["", "=== END CONTEXT ==="]
    return "\n".join(parts), used, len(first) // 3 + len(second) // 3 + tokens + 50, graph


def keyword_rows(graph: Graph, query: str, k: int = 5) -> list[dict]:
    """The nodes that share keywords with a query, best first, each with its chain of heaviest parents and its direct parents."""
    ranked = search.keyword_top(graph, query, k)
    texts = {r["id"]: r for r in graph.nodes.select("id", "content", "node_type").join(F.broadcast(ranked), "id").collect()}
    ids = graph.nodes.sparkSession.createDataFrame([(i,) for i in texts], "id string")
    chains: dict[str, list] = {}
    for r in lineage.parent_chain(graph, 3).join(F.broadcast(ids), "id").orderBy("id", "step").collect():
        chains.setdefault(r["id"], []).append(r["ancestor"])
    up = graph.edges.join(F.broadcast(ids.withColumnRenamed("id", "child_id")), "child_id").join(graph.nodes.select(F.col("id").alias("parent_id"), "content"), "parent_id")
    parents: dict[str, list] = {}
    for r in up.select("child_id", "content", "weight", "parent_id").orderBy(F.desc("weight"), "parent_id").collect():
        parents.setdefault(r["child_id"], []).append(r["content"])
    rows = [{"id": i, "content": r["content"], "node_type": r["node_type"], "score": r["score"], "chain": chains.get(i, []), "parents": parents.get(i, [])} for i, r in texts.items()]
    return sorted(rows, key=lambda r: (-r["score"], r["id"]))


def keyword_text(rows: list[dict]) -> str:
    """The rows of keyword_rows(), numbered, with the beginnings of what they are derived from."""
    if not rows:
        return ""
    lines = ["Existing reasoning on this topic:", ""]
    for i, r in enumerate(rows, 1):
        lines.append(f"{i}. {r['content']}")
        if r["parents"]:
            lines.append(f"   (derived from: {'; '.join(p[:60] + '...' for p in r['parents'])})")
        lines.append("")
    return "\n".join(lines)


def context_counts(text: str) -> tuple[int, int]:
    """How many nodes a context lists, and its tokens: those it states, else a quarter of its characters."""
    told = re.search(r"\(~(\d+) tokens\)", text)
    return len(re.findall(r"(?m)^\d+\. \[", text)), int(told[1]) if told else len(text) // 4


def explain(graph: Graph, query: list[float], as_of, k: int = 5, depth: int = 2) -> dict:
    """What each stage of the hybrid plan sees: the hits (the first five with their texts), the walk (ten of its nodes) and the results."""
    hits = search.top_k(graph, query, 2 * k).collect()
    spark = graph.nodes.sparkSession
    walked = walk.khop(graph, spark.createDataFrame([(r["node_id"],) for r in hits], "id string"), depth)
    by = {r["hops"]: r["n"] for r in walked.groupBy("hops").agg(F.count("*").alias("n")).collect()}
    names = [r["node_id"] for r in hits[:5]]
    texts = {r["id"]: r["text"] for r in graph.nodes.where(F.col("id").isin(names)).select("id", F.substring("content", 1, 60).alias("text")).collect()}
    results = retrieve.hybrid(graph, query, as_of, k, depth).collect()
    return {
        "hits": [{"id": r["node_id"], "sim": r["sim"], "content": texts.get(r["node_id"], "Unknown") + "..."} for r in hits[:5]],
        "walk": {"depth": depth, "found": sum(by.values()), "by_hops": by, "some": [tuple(r) for r in walked.orderBy("hops", "id").limit(10).collect()]},
        "results": [r.asDict() for r in results],
        "summary": {"hits": len(hits), "expansion": sum(by.values()) - len(hits), "results": len(results)},
    }


def beam_summary(graph: Graph, query: list[float], knobs: Knobs = Knobs()) -> dict:
    """What a beam walk takes: seeds, all nodes, and the share of seeds among the best results."""
    seeds = [(r["node_id"], r["sim"]) for r in search.top_k(graph, query, knobs.seeds).collect()]
    taken = [(s, i) for _, i, s, _ in walk.beam_events(graph, query, seeds, knobs.picks, knobs.hops)]
    best = [i for _, i in sorted(taken, key=lambda x: (-x[0], x[1]))[: knobs.top_k]]
    own = {i for i, _ in seeds}
    return {"seeds_found": len(seeds), "bfs_explored": len(taken), "results_returned": len(best), "overlap_ratio": sum(i in own for i in best) / len(best) if best else 0.0}


def summary_report(graph: Graph) -> str:
    """Counts, types, reasons, hubs and sources as text."""
    d = stats.degree_stats(graph).first()
    lines = ["GRAPH SUMMARY", "=" * 50, "", "Overview:", f"  Total nodes: {graph.nodes.count()}", f"  Total edges: {graph.edges.count()}"]
    lines.append(f"  Average connectivity: {d['mean_in_degree'] or 0:.1f} in, {d['mean_out_degree'] or 0:.1f} out")
    types = graph.nodes.groupBy("node_type").agg(F.count("*").alias("n")).orderBy("node_type").collect()
    lines += ["", "Node Types:", *[f"  {r['node_type']}: {r['n']} nodes" for r in types]]
    buckets = stats.reasoning_buckets(graph).orderBy(F.desc("n"), "bucket").collect()
    lines += ["", "Reasoning Patterns:", *[f"  {r['bucket']}: {r['n']} edges" for r in buckets]]
    hubs = stats.hubs(graph, k=5).join(graph.nodes.select("id", "content", "node_type"), "id").orderBy(F.desc("degree"), "id").collect()
    if hubs:
        lines += ["", "Hub Nodes (most connected):", *[f"  [{r['degree']}] {r['content']} ({r['node_type']})" for r in hubs]]
    sources = stats.source_counts(graph).orderBy(F.desc("n"), "source_file").limit(50).collect()
    return "\n".join([*lines, "", "Source Files (the 50 largest):", *[f"  {r['source_file']}: {r['n']} nodes" for r in sources]])


def trend_report(history: DataFrame, as_of, days: int = 7) -> str:
    """A metrics history as text: the last measurement, each series' change, and what is an anomaly or a concern."""
    last = history.orderBy(F.desc("ts")).limit(1).collect()
    if not last:
        return "METRICS REPORT\n" + "=" * 50 + "\nNo historical data available."
    latest = last[0].asDict()
    lines = ["METRICS REPORT", "=" * 50, f"Latest measurement: {latest.pop('ts')}", f"Data points: {history.count()} total", "", "Latest values:"]
    lines += [f"  {k}: {v}" for k, v in latest.items() if v is not None]
    rows = metrics.trends(history, as_of, days).orderBy("series").collect()
    lines += ["", f"Trends (last {days} days):"]
    if not rows:
        return "\n".join([*lines, "  Fewer than two points."])
    for r in rows:
        change = "stable" if abs(r["change_pct"]) < 1 else f"{'up' if r['change_pct'] > 0 else 'down'} {abs(r['change_pct']):.1f}%"
        lines.append(f"  {r['series']}: {change}{', an anomaly' if r['anomaly'] else ''}{', a concern' if r['concern'] else ''}")
    return "\n".join(lines)


def audit_report(log: DataFrame, as_of, days: int = 7) -> str:
    """The decay log of the last days as text."""
    rows = audit.rollup(log, as_of, days).orderBy("measure", F.desc("n"), "key").collect()
    of = lambda name: [(r["key"], int(r["n"])) for r in rows if r["measure"] == name]
    total = {r["key"]: r["n"] for r in rows if r["measure"] == "total"}
    lines = [f"DECAY AUDIT (last {days} days)", "=" * 50, f"Total events: {int(total.get('events', 0))}", f"Today: {int(total.get('today', 0))}, daily mean {total.get('daily_mean', 0.0):.2f}"]
    if total.get("anomaly"):
        lines.append("Today has over twice the daily mean.")
    for title, name in (("By reason", "reason"), ("By type", "node_type"), ("By source", "source_file")):
        if of(name):
            lines += ["", f"{title}:", *[f"  {k}: {n}" for k, n in of(name)]]
    return "\n".join(lines)
