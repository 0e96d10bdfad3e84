"""The command line over a stored graph, and over the catalogue of queries.

python -m graphloom COMMAND [--graph FOLDER] [--config FILE] [ARGUMENTS]; --help lists the commands.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import SparkSession, functions as F

from . import config, facade, store
from .operators import audit, consolidate, lifecycle, lineage, metrics, search, stats, vector_index, walk
from .plans import context, retrieve, session
from .queries import QUERIES
from .sources import files
from .sources.registry import Archive, Notes, Registry, Sessions, StateFolder, Vault


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom")
    top.add_argument("--graph", help="folder of the graph")
    top.add_argument("--config", help="settings file")
    top.add_argument("--now", help="the present, an ISO time in UTC")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, *arguments, **flags):
        p = sub.add_parser(name)
        for a in arguments:
            p.add_argument(a, nargs="*" if a.endswith("s") else None)
        for f, default in flags.items():
            p.add_argument(f"--{f.replace('_', '-')}", default=default, **({"action": "store_true"} if default is False else {"type": type(default) if default is not None else str}))

    for name in ("init", "stats", "report", "sleep", "permanent", "list-tags", "audit", "dimensions", "recent"):
        command(name)
    command("query", "name", "sf_dir", rows=20)
    command("sql", "statement", rows=20)
    command("context", "hints", domain=None)
    command("keywords", "hints")
    command("explain", "hints")
    command("retrieve", "hints", k=10)
    command("extract", "file", plan=False)
    command("ingest-answer", "file")
    command("think", plan=False, domain=None)
    command("ingest", "source", "path")
    command("pin", "ids")
    command("unpin", "ids")
    command("why", "id")
    command("how", "a", "b")
    command("prune", apply=False, days=14)
    command("compact", threshold=0.9)
    command("embed")
    command("embedding-stats")
    command("search", "hints", k=10, indexed=False)
    command("index", rebuild=False)
    command("content", "id")
    command("related", "id", k=5)
    command("migrate-files", "path")
    command("metrics", hours=24)
    command("export", "path")
    command("backup")
    return top


def _shown(df, rows: int = 50) -> None:
    df.show(rows, truncate=80)


def main(args: list[str]) -> int:
    a = _parser().parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "query":
        if a.name not in QUERIES:
            print("queries:", *sorted(QUERIES), sep="\n")
            return 2
        _shown(QUERIES[a.name](spark, a.sf_dir), a.rows)
        return 0
    settings = config.load(a.config)
    registry = Registry(StateFolder(spark, f"{config.graph_path(a.graph, settings)}/_sources"))
    for source in (Notes(), Vault(), Sessions(), Archive()):
        registry.register(source)
    brain = facade.Brain(spark, settings, registry=registry, folder=config.graph_path(a.graph, settings))
    now = dt.datetime.fromisoformat(a.now) if a.now else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    g = brain.graph()
    as_of = F.lit(now)
    vector = (lambda: brain._vector(" ".join(a.hints))) if getattr(a, "hints", None) else lambda: None
    if a.command == "init":
        store.save(g, brain.folder)
    elif a.command == "stats":
        _shown(stats.graph_summary(g))
        print(f"new in the last 7 days: {stats.recent_count(g, as_of).first()['n']}")
    elif a.command == "report":
        print(context.summary_report(g))
    elif a.command == "recent":
        print(context.recent(g, now))
    elif a.command == "sql":
        _shown(store.sql(g, a.statement), a.rows)
    elif a.command == "context":
        print(brain.session_context(now, a.hints, a.domain))
    elif a.command == "keywords":
        print(context.keyword_text(context.keyword_rows(g, " ".join(a.hints))))
    elif a.command == "explain":
        print(json.dumps(context.explain(g, vector(), as_of), indent=2, default=str))
    elif a.command == "retrieve":
        _shown(retrieve.hybrid(g, vector(), as_of, a.k), a.k)
    elif a.command == "extract":
        with open(a.file, encoding="utf-8") as f:
            text = f.read()
        print(session.extraction_plan(text, settings.knobs()) if a.plan else json.dumps(brain.extract(text, now)))
    elif a.command == "ingest-answer":
        with open(a.file, encoding="utf-8") as f:
            after, made = session.ingest_answer(g, f.read(), now, settings.user_domain, settings.ai_domain, encoder=brain.encoder)
        store.save(after, brain.folder)
        print(len(made))
    elif a.command == "think":
        print(session.thinking_plan(g, settings.knobs(), a.domain) if a.plan else brain.think(now, a.domain))
    elif a.command == "ingest":
        print(json.dumps(brain.ingest(a.source, a.path, now)))
    elif a.command in ("pin", "unpin"):
        print(brain.pin(a.ids, 2 if a.command == "pin" else 0))
    elif a.command == "permanent":
        _shown(lifecycle.permanent_nodes(g.nodes))
    elif a.command == "list-tags":
        _shown(stats.tag_counts(g).orderBy(F.desc("n"), "tag"))
    elif a.command == "audit":
        _shown(lineage.contradictions(g))
        _shown(lineage.audit_orphans(g))
        _shown(lineage.weak_chains(g))
        _shown(lineage.cycle_lists(g).orderBy("length", "cycle"))
    elif a.command == "why":
        print(json.dumps(lineage.why_tree(g, a.id), indent=2))
    elif a.command == "how":
        _shown(walk.how(g, a.a, a.b))
    elif a.command == "prune":
        print(brain.prune(as_of, a.apply, a.days))
    elif a.command == "compact":
        after, losers = consolidate.compacted(g, a.threshold)
        log = audit.rows(g, losers.withColumn("reason", F.lit("dedup_merge")), now)
        print(log.count())
        store.save(after, brain.folder)
    elif a.command == "embed":
        print(brain.embed())
    elif a.command == "embedding-stats":
        _shown(stats.embedding_overview(g))
        _shown(stats.embedding_stats(g))
    elif a.command == "search":
        found = brain.index() if a.indexed else None
        _shown(search.top_k(g, vector(), a.k) if found is None else vector_index.top_k(found, g, vector(), a.k), a.k)
    elif a.command == "index":
        print(json.dumps(brain.indexed(a.rebuild)))
    elif a.command == "content":
        print((store.node(g, a.id, ["content"]) or {}).get("content"))
    elif a.command == "related":
        _shown(search.related(g, a.id).limit(a.k), a.k)
    elif a.command == "dimensions":
        _shown(store.dimensions(g))
    elif a.command == "migrate-files":
        after, n = session.migrated(g, files.notes(spark, a.path), now, settings.user_domain, settings.ai_domain)
        store.save(after, brain.folder)
        print(n)
    elif a.command == "metrics":
        _shown(metrics.summary(g, as_of, a.hours))
        _shown(metrics.by_type(g.metrics, as_of, a.hours))
    elif a.command == "export":
        files.export_full(g, a.path, now)
    elif a.command == "backup":
        print(brain.backup(now.isoformat(timespec="seconds")))
    elif a.command == "sleep":
        print(json.dumps(brain.sleep(now), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
