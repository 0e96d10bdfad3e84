"""Contexts, session plans, sources, the store and the command line, with fakes in place of models."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import config, facade, schema, store
from graphloom.__main__ import main
from graphloom.functions import text as tx
from graphloom.operators import audit, consolidate, embed, ingest, lifecycle, metrics, search
from graphloom.plans import context, retrieve, session, sleep
from graphloom.sources import files
from graphloom.sources.registry import Archive, Notes, Registry, Sessions, Source, Vault
from tests.test_operators import graph, ids

NOW = dt.datetime(2024, 3, 31)


@pytest.fixture(scope="module")
def small(spark):
    vectors = {"a": [1, 0, 0], "b": [0.9, 0.2, 0], "c": [0, 1, 0], "d": [0, 0, 1], "e": [0.5, 0.9, 0]}
    nodes = [{"id": i, "content": f"the parser {i} keeps tokens", "access": k, "type": "fact" if k % 2 else "belief", "domain": "user" if k < 3 else None, "ts": NOW - dt.timedelta(days=k)} for k, i in enumerate(vectors)]
    g = graph(spark, nodes, [("a", "b", 0.9), ("c", "b", 0.4), ("b", "d", 0.8)], vectors.items())
    return g.with_(nodes=schema.normalize_nodes(g.nodes))


def test_session_context(small):
    text, used, tokens, after = context.session_context(small, NOW, [1.0, 0.0, 0.0])
    lines = text.split("\n")
    assert lines[:2] == ["=== GRAPH OVERVIEW ===", "Graph: 5 nodes, 3 edges. Types: 3 belief, 2 fact."]
    assert lines[4] == "1. [belief] the parser a keeps tokens (today)" and lines[5] == "2. [fact] the parser b keeps tokens (03-30)"
    assert used[:2] == ["a", "b"] and "1. [BELIEF] the parser a keeps tokens (Domain: user)" in lines and lines[-1] == "=== END CONTEXT ==="
    assert ids(after.nodes.where("id = 'b'"), "access_count") == [2] and tokens > 50
    assert context.session_context(small, NOW)[1] == [] and context.recent(small, NOW, "nobody") == "No recent activity found."
    assert context.context_counts(text) == (3 + len(used), len(text) // 4)
    assert context.context_counts("1. [X] y\n(~17 tokens)") == (1, 17)
    rows = [{"node_type": "fact", "content": "x" * 30, "domain": "unknown"}] * 3
    assert len(context.within_budget(rows, 24)[0]) == 2


def test_result_texts(small):
    rows = [{"node_type": "fact", "content": "abc", "domain": "user", "score": 0.5, "path": ["w", "x", "y", "z"]}]
    assert context.results_text(rows, True) == "=== RELEVANT CONTEXT ===\n1. [FACT] abc (Domain: user)\n   Path: ... → x → y → z\n   Relevance: 0.500\n"
    assert context.results_text([]) == "No relevant context found."
    found = context.keyword_rows(small, "parser b")
    assert found[0]["id"] == "a" and {r["id"]: r["chain"] for r in found}["d"] == ["b", "a"]
    assert "   (derived from: the parser a keeps tokens...; the parser c keeps tokens...)" in context.keyword_text(found).split("\n")
    told = context.explain(small, [1.0, 0.0, 0.0], F.lit(NOW), 2)
    assert told["summary"]["hits"] == 4 and told["walk"]["by_hops"][0] == 4 and told["hits"][0]["content"].startswith("the parser a")
    assert context.beam_summary(small, [1.0, 0.0, 0.0])["overlap_ratio"] == 1.0
    report = context.summary_report(small)
    assert "  Total edges: 3" in report and "  [3] the parser b keeps tokens (fact)" in report
    assert ids(retrieve.details(small, ["a", "zz"]), "id") == ["a"]


def test_end_of_session(small, spark):
    encoder = lambda texts: np.array([[1.0, 0.05, 0.0] if "parser" in t else [0.0, 0.0, -1.0] for t in texts])
    answer = json.dumps([{"content": "the parser is new", "type": "fact", "domain": "user", "tags": ["A ", "b"], "referent_time": "2024-01-02T03:04:05Z"}, {"content": "nothing else", "keep": False}, {"content": "far off", "referent_time": "last year"}])
    after, report = session.end_session(small, "a conversation that is long enough", NOW, lambda _: answer, encoder)
    assert len(report["nodes"]) == 2 and report["edges"] == 3
    new = {r["content"]: r for r in after.nodes.where("source_file = 'session'").collect()}
    assert new["the parser is new"]["tags"] == "a,b" and new["the parser is new"]["referent_ts"] == dt.datetime(2024, 1, 2, 3, 4, 5) and new["far off"]["referent_ts"] is None
    child = new["the parser is new"]["id"]
    assert ids(after.edges.where(F.col("child_id") == child), "parent_id", "weight") == [("a", 0.8), ("b", 0.8), ("e", 0.8)]
    again, second = session.end_session(after, "a conversation that is long enough", NOW, lambda _: answer, encoder)
    assert second == {"nodes": [], "edges": 0} and again.edges.count() == after.edges.count()
    assert session.end_session(small, "We will keep the old parser for now.", NOW, lambda _: "no array")[1]["nodes"]
    assert session.inferred_time("x", lambda _: "2024-01-01T00:00:00Z, surely") == "2024-01-01T00:00:00Z" and session.inferred_time("x", lambda _: "NONE") is None and session.inferred_time("x", lambda _: "yesterday") is None


def test_thinking_gates(small):
    near = lambda texts: np.array([[1.0, 0.0, 0.0] if "near" in t else [-1.0, -1.0, -1.0] for t in texts])
    counted = session.Counted(lambda _: '[{"content": "a near thought"}, {"content": "another one"}]')
    after, n = session.think(small, counted, NOW, encoder=near)
    assert n == 1 and ids(after.nodes.where("source_file = 'system_generated'"), "content") == ["another one"] and after.emb.count() == 6
    assert counted.usage()["calls"] == 1 and counted.usage()["output_tokens"] == 14
    pairs = session.tension_candidates(small)
    assert pairs and {r["a"] for r in pairs} <= set("abcde")
    said = json.dumps([{"pair": 1, "tension": "they differ", "type": "contradiction", "resolution_hint": "ask"}, {"pair": 99, "tension": "x", "type": "y"}])
    after, made = session.tension(small, lambda p: said if "Pair 1" in p else "", NOW)
    row = after.nodes.where("node_type = 'tension'").first() if made else None
    assert len(made) == 1 and row["content"] == "TENSION (contradiction): they differ [Resolution hint: ask]" and after.edges.where(F.col("child_id") == made[0]).count() == 2
    assert session.tension(small, lambda _: "[]", NOW)[1] == []


def test_handed_over(small, spark):
    plan = json.loads(session.thinking_plan(small, seed=1))
    assert plan["operation"] == "think" and len(plan["nodes"]) == 5 and json.loads(session.extraction_plan("t"))["text"] == "t"
    answer = json.dumps({"insights": [{"content": "an operating principle"}, {"content": "I like tea", "type": "fact"}]})
    after, made = session.ingest_answer(small, answer, NOW, tags=["x"], parents=[n["id"] for n in plan["nodes"]])
    assert ids(after.nodes.where(F.col("id").isin(made)), "content", "domain", "tags") == [("I like tea", "user", "x"), ("an operating principle", "ai", "x")] and after.edges.count() == 3 + 10
    rows = spark.createDataFrame([("f", "d", None, "text")], "source_file string, domain string, referent_time string, text string")
    told = session.told_by_model(rows, lambda _: "# Heading\n[Fact] this is a typed statement\nwe decided to classify this one\nshort\n---", ("fact", "insight"))
    assert ids(told, "content", "node_type") == [("this is a typed statement", "fact"), ("we decided to classify this one", "decision")]
    notes = spark.createDataFrame([("a.md", "x" * 120 + "\n\n```code" + "y" * 60 + "\n\n" + "word " * 200)], "path string, text string")
    after, n = session.migrated(small, notes, NOW)
    assert n == 2 and sorted(map(len, ids(after.nodes.where("source_file = 'migration:a.md'"), "content"))) == [120, 500]
    assert session.migrated(after, notes, NOW)[1] == 0


def test_cycle_with_audit(small, spark):
    old = audit.rows(small, spark.createDataFrame([("d", "direct")], "id string, reason string"), dt.datetime(2024, 1, 1))
    g = small.with_(emb=small.emb.where("node_id <> 'e'"))
    after, report = sleep.cycle(g, config.Profile("t", 3, 0.5, 0.95, 0.9), NOW, gc_mode="off", encoder=lambda t: np.ones((len(t), 3)), audit=old)
    assert report["merged"] == 1 and report["embedded"] == 1 and after.emb.count() == 5
    assert ids(report["audit"].where("decay_reason = 'dedup_merge'"), "node_id") == ["a"] and report["audit"].where("decay_reason = 'direct'").count() == 0
    assert {r["event"]: r["n"] for r in sleep.events_of(spark, {"merged": 1, "core": {"promote": 2}}).collect()} == {"merged": 1, "core_promote": 2}
    with pytest.raises(Exception, match="not a reason"):
        audit.rows(small, spark.createDataFrame([("d", "boredom")], "id string, reason string"), NOW).collect()
    after, report = sleep.cycle_by_words(small.with_(nodes=small.nodes.withColumn("content", F.lit("the same words here"))), NOW)
    assert report["merged"] == 4


def test_hard_merge(small, spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "c")], "cluster string, id string")
    after, made = consolidate.hard_merged(small, pairs, NOW)
    new = made.first()["id"]
    assert ids(after.nodes, "id") == sorted(["b", "d", "e", new]) and ids(after.edges, "parent_id", "child_id") == sorted([("b", "d"), (new, "b")]) and after.emb.count() == 3
    row = after.nodes.where(F.col("id") == new).first()
    assert row["access_count"] == 2 and row["ts"] == NOW - dt.timedelta(days=2) and row["node_type"] == "belief"
    assert consolidate.compacted(small, 0.95)[1].count() == 1


def test_sources(spark, tmp_path, small):
    folder = tmp_path / "vault"
    (folder / "work").mkdir(parents=True)
    (folder / "a.md").write_text("---\ntitle: First\ntags: [x, y]\n---\nThis note links to [[b]] and is long enough.")
    (folder / "b.md").write_text("This is the other note, which is long enough too.")
    assert files.front_matter((folder / "a.md").read_text())["title"] == "First" and files.front_matter("no rules") == {}
    assert files.with_front_matter(files.notes(spark, str(folder))).where("path = 'a.md'").first()["fields"]["tags"].replace(" ", "") == "x,y"
    states: dict = {}
    registry = Registry(states)
    vault = Vault()
    registry.register(vault)
    g, report = registry.run("vault", small, str(folder), NOW)
    assert report == {"created": 2, "errors": []} and g.edges.count() == 5 and ids(states["vault"], "path") == ["a.md", "b.md"]
    assert registry.run("vault", g, str(folder), NOW)[1]["created"] == 0 and registry.run("nobody", g, "", NOW)[1]["errors"]
    with pytest.raises(ValueError):
        registry.register(Vault())
    with pytest.raises(TypeError):
        registry.register(object())
    (tmp_path / "s").mkdir()
    line = lambda t: json.dumps({"role": "user", "content": t * 120, "timestamp": "2024-01-01T00:00:00Z"}) + "\n"
    (tmp_path / "s" / "one.jsonl").write_text(line("x") + "not json\n")
    registry.register(Sessions())
    g, report = registry.run("sessions", small, str(tmp_path / "s"), NOW)
    assert report["created"] == 1 and ids(g.nodes.where("domain = 'conversations'"), "source_file", "referent_ts") == [("extractor:session:one", dt.datetime(2024, 1, 1))]
    (tmp_path / "s" / "one.jsonl").write_text(line("x") + "not json\n" + line("y"))
    source = registry.get("sessions")
    assert source.found(spark, str(tmp_path / "s"), None).count() == 1
    talk = [{"uuid": "u1", "name": "Talk", "updated_at": "2", "chat_messages": [{"sender": "human", "text": "z" * 60 + tx.TOOL_MARKS[1], "content": []}, {"sender": "assistant", "text": tx.TOOL_MARKS[0], "content": []}]}]
    (tmp_path / "chat.json").write_text(json.dumps(talk))
    registry.register(Archive())
    g, report = registry.run("archive", small, str(tmp_path / "chat.json"), NOW)
    assert report["created"] == 1 and g.nodes.where("content = 'Talk (human): " + "z" * 60 + "'").count() == 1
    assert registry.run("archive", g, str(tmp_path / "chat.json"), NOW)[1]["created"] == 0

    class Broken(Source):
        name = "broken"

        def found(self, spark, path, model_fn):
            raise OSError("unreadable")

    registry.register(Broken())
    assert registry.run_all(small, "nowhere", NOW)[1]["broken"]["errors"] == ["unreadable"] and "broken" not in states
    assert isinstance(Notes(), Source)


def test_store(spark, tmp_path, small):
    folder = str(tmp_path / "g")
    assert store.load(spark, folder).nodes.count() == 0
    first = store.save(small, folder)
    second = store.save(small.with_(edges=small.edges.limit(1)), folder)
    third = store.save(small, folder)
    assert store.versions(spark, folder) == [third, second] == [3, 2] and first == 1 and store.load(spark, folder, second).edges.count() == 1
    back = store.load(spark, folder)
    assert back.edges.count() == 3 and store.node(back, "a", ["id", "access_count"]) == {"id": "a", "access_count": 0} and store.node(back, "zz") is None
    assert store.sql(back, "SELECT count(*) AS n FROM nodes WHERE id > :low", low="b").first()["n"] == 3
    assert "vector" in store.tables(back)["emb"] and store.dimension_mismatch(back, 3) == {} and store.dimension_mismatch(back, 4) == {3: 5}
    with pytest.raises(ValueError):
        store.re_encoded(back, embed.hashing_encoder(4), "h")
    assert store.re_encoded(back, embed.hashing_encoder(4), "h", True).emb.count() == 5


def test_backups_and_exports(spark, tmp_path, small):
    assert files.backup(small, str(tmp_path / "b"), "2024-01-01T00:00:00") == (True, [])
    assert files.backup(small, str(tmp_path / "b"), "2024-01-01T03:00:00") == (False, [])
    assert files.backup(small, str(tmp_path / "b"), "2024-01-20T00:00:00")[1] == ["2024-01-01T00:00:00"]
    assert [p.name for p in (tmp_path / "b").iterdir()] == ["2024-01-20T00_00_00"]
    files.export_full(small, str(tmp_path / "out"), NOW)
    assert spark.read.json(str(tmp_path / "out" / "cluster_members")).where("colour = '#51CF66'").count() == 3


def test_metrics_store(spark, tmp_path):
    path = str(tmp_path / "m")
    metrics.record(spark, path, "retrieval", 5.0, NOW, seeds_found=3, bfs_explored=9)
    put = lambda kind, ms: metrics.record(spark, path, kind, ms, NOW)
    assert metrics.timed(put, "embed")(lambda x: x + 1)(1) == 2 and metrics.timed(put, "embed", False)(lambda: 7)() == 7
    rows = metrics.recorded(spark, path)
    assert ids(rows, "metric_type") == ["embed", "retrieval"] and metrics.retrieval_breakdown(rows, F.lit(NOW)).first()["bfs_bonus"] == 6.0
    metrics.exported(rows, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x")).count() == 2
    metrics.cleared(spark, path)
    assert metrics.recorded(spark, path).count() == 0


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("BUDGET", "900")
    (tmp_path / "c.json").write_text('{"performance": {"token_budget": "${BUDGET:-5}", "top_k": 3}, "domain_aliases": {"old": "new"}}')
    s = config.load(str(tmp_path / "c.json"), gc_mode="hard")
    assert (s.token_budget, s.top_k, s.gc_mode, s.aliases()["old"], s.knobs().token_budget) == (900, 3, "hard", "new", 900)
    assert s.to_dict()["scoring_weights"]["embedding"] == pytest.approx(0.7) and s.due("think") == 12
    for bad in ({"top_k": 0}, {"access_weight": 0.9, "temporal_weight": 0.2}, {"nothing": 1}, {"gc_mode": "x"}):
        with pytest.raises(ValueError):
            config.load(**bad)
    monkeypatch.setenv("GRAPHLOOM_PATH", "/env")
    assert config.graph_path(None, s) == "/env" and config.graph_path("/arg", s) == "/arg" and config.profile("all-MiniLM-L6-v2").dim == 384


def test_new_rows(spark, small):
    found = spark.createDataFrame([(" x y ", None), ("x y", "fact"), ("", "fact"), ("the parser a keeps tokens", "fact")], "content string, node_type string")
    rows = ingest.ingested(found, small.nodes, "s", NOW)
    assert ids(rows, "content", "source_file", "domain") == [("x y", "extractor:s", "default")]
    assert ids(ingest.last_stamp(spark.createDataFrame([(1, 1, "a"), (1, 2, " "), (1, 3, "b"), (2, 1, "")], "k int, o int, t string"), "k", "o", "t")) == [(1, "b")]
    assert ids(lifecycle.gc_candidates(small, F.lit(NOW), 2.0, probes=2), "id") != [] and lifecycle.gc_candidates(small, F.lit(NOW), 2.0, probes=2).count() == 2
    assert search.diverse(small, small.emb.selectExpr("concat('x', node_id) AS cand_id", "vector"), 0.99).count() == 0


def test_command_line(spark, tmp_path, small, capsys):
    folder = str(tmp_path / "g")
    store.save(small, folder)
    at = ["--graph", folder, "--now", "2024-03-31T00:00:00"]
    for args in (["stats"], ["report"], ["pin", "a"], ["permanent"], ["why", "d"], ["how", "a", "d"], ["list-tags"], ["prune"], ["audit"], ["dimensions"], ["sql", "SELECT count(*) AS n FROM edges"], ["keywords", "parser"], ["think", "--plan"], ["recent"]):
        assert main([*at, *args]) == 0
    out = capsys.readouterr().out
    assert "Total nodes: 5" in out and '"operation": "think"' in out and "| pinned" in out.replace("|pinned", "| pinned")
    for args in (["embed"], ["embedding-stats"], ["index"], ["index"], ["search", "parser", "--indexed"], ["search", "parser"], ["content", "a"], ["related", "b"]):
        assert main([*at, *args]) == 0
    told = capsys.readouterr().out
    assert '"added": ' in told and "the parser a keeps tokens" in told and "coverage_percent" in told
    assert main(["query", "nothing", "x"]) == 2
    brain = facade.Brain(spark, config.Settings(), folder=folder, encoder=lambda t: np.ones((len(t), 3)))
    assert brain.extract("We will extend the parser next week.", NOW)["nodes"] and "=== RELEVANT CONTEXT ===" in brain.operate("context", NOW, hints=["parser"])
    with pytest.raises(ValueError):
        brain.operate("fly", NOW)


def test_reports_as_text(spark, small):
    history = spark.createDataFrame([(NOW - dt.timedelta(days=2), 10.0, 100.0, 1.0, 2.0), (NOW, 20.0, 100.0, 2.0, 2.0)], "ts timestamp, avg_nodes double, avg_tokens double, avg_latency_ms double, orphan_count double")
    text = context.trend_report(history, F.lit(NOW))
    assert "Data points: 2 total" in text and "  avg_nodes: up 100.0%, an anomaly" in text and "  avg_tokens: stable" in text and "  avg_latency_ms: up 100.0%, an anomaly, a concern" in text
    assert context.trend_report(history.limit(0), F.lit(NOW)).endswith("No historical data available.") and "Fewer than two points" in context.trend_report(history.limit(1), F.lit(NOW))
    log = audit.rows(small, spark.createDataFrame([("a", "direct"), ("b", "cascade"), ("c", "cascade")], "id string, reason string"), NOW)
    said = context.audit_report(log, F.lit(NOW))
    assert "Total events: 3" in said and "  cascade: 2" in said and said.index("cascade: 2") < said.index("direct: 1")
