"""Operators on small graphs whose results are known, and against sequential versions."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom import config, schema
from graphloom.functions import clock, text as tx
from graphloom.operators import audit, consolidate, ingest, lifecycle, lineage, search, similarity, stats, walk
from graphloom.plans import retrieve, sleep
from graphloom.schema import Graph
from graphloom.sources import files
from graphloom.streaming import ingest as streaming

NOW = dt.datetime(2024, 3, 31)
EDGE = "parent_id string, child_id string, weight double, reasoning string"
NODE = "id string, content string, node_type string, domain string, ts timestamp, access_count int, source_file string, decayed int, permanent int, tags string, metadata string"


def graph(spark, nodes, edges, vectors=()):
    rows = []
    for n in nodes:
        n = {"id": n} if isinstance(n, str) else n
        rows.append((n["id"], n.get("content", n["id"]), n.get("type", "fact"), n.get("domain"), n.get("ts", NOW), n.get("access", 0), n.get("source"), n.get("decayed", 0), n.get("permanent", 0), n.get("tags"), "{}"))
    e = [(*x, None)[:4] if len(x) == 3 else x for x in edges]
    emb = spark.createDataFrame([(i, [float(x) for x in v], "m") for i, v in vectors], "node_id string, vector array<double>, model string")
    return Graph(spark.createDataFrame(rows, NODE), spark.createDataFrame(e, EDGE), emb)


def ids(df, *columns):
    return sorted(tuple(r) if len(r) > 1 else r[0] for r in (df.select(*columns) if columns else df).collect())


LINEAGE = [("seed1", "belief1", 0.9), ("belief1", "derived1", 0.8), ("derived1", "question1", 0.7), ("question1", "derived2", 0.6), ("belief1", "derived2", 0.5, "contradicts it"), ("seed1", "weak1", 0.1)]


@pytest.fixture(scope="module")
def lines(spark):
    return graph(spark, ["seed1", "belief1", "derived1", "question1", "derived2", "weak1", "orphan1"], LINEAGE)


def test_lineage(lines):
    assert ids(lineage.why(lines, "derived2"), "ancestor") == ["belief1", "derived1", "question1", "seed1"]
    assert [r["ancestor"] for r in lineage.why(lines, "derived2").where("is_root").collect()] == ["seed1"]
    assert lineage.why(lines, "orphan1").count() == 0
    assert ids(lineage.weak_chains(lines)) == [("weak1", 0.1)]
    assert ids(lineage.audit_orphans(lines)) == ["orphan1"] and lineage.contradictions(lines).count() == 1
    found = walk.how(lines, "seed1", "derived2").collect()
    assert [(r["distance"], r["id"], r["weight"], r["direction"]) for r in found] == [(0, "seed1", None, None), (1, "belief1", 0.9, "outgoing"), (2, "derived2", 0.5, "outgoing")]
    assert walk.how(lines, "derived2", "seed1").collect()[1]["direction"] == "incoming" and walk.how(lines, "seed1", "orphan1").count() == 0
    assert walk.how(lines, "seed1", "seed1").first()["distance"] == 0
    assert walk.distance(lines, "seed1", "derived2").first()["hops"] == 2 and walk.distance(lines, "seed1", "orphan1").count() == 0
    tree = lineage.why_tree(lines, "derived2")
    assert [p["node"]["id"] for p in tree["parents"]] == ["question1", "belief1"] and tree["parents"][1]["node"]["cycle_detected"]


def test_cycles_end(spark, lines):
    extra = spark.createDataFrame([("derived2", "belief1", 0.3, None)], EDGE)
    g = lines.with_(edges=lines.edges.union(extra))
    assert ids(lineage.cyclic(g)) == ["belief1", "derived1", "derived2", "question1"] and lineage.cyclic(lines).count() == 0
    assert lineage.depth(g).count() >= 3


def test_walk(spark):
    e = [("weather1", "weather2", 0.8), ("weather2", "mood1", 0.7), ("mood1", "mood2", 0.9), ("health1", "health2", 0.6), ("weather1", "health2", 0.5), ("weather1", "decayed1", 0.9)]
    g = graph(spark, [*{x for a, b, _ in e for x in (a, b)} - {"decayed1"}, {"id": "decayed1", "decayed": 1}], e)
    seeds = g.nodes.where("id = 'weather1'")
    assert ids(walk.khop(g, seeds, 1), "id") == ["health2", "weather1", "weather2"]
    assert ids(walk.khop(g, seeds, 2), "id") == ["health1", "health2", "mood1", "weather1", "weather2"]
    assert ids(walk.khop(g, seeds, 0), "id") == ["weather1"]
    both = g.nodes.where("id in ('weather1', 'decayed1', 'mood2')")
    for wide in (0, 1, 2, 3, 100):  # the frontier is a literal set, or becomes a table at some hop, or is one from the start
        assert ids(walk.khop(g, both, 2, wide)) == [("health1", 2), ("health2", 1), ("mood1", 1), ("mood2", 0), ("weather1", 0), ("weather2", 1)]


def test_decay(spark):
    old, young = NOW - dt.timedelta(days=60), NOW
    n = [{"id": i, "ts": old} for i in ("root", "child1", "child2", "grandchild1", "grandchild2", "isolated_old", "connected_old")]
    n += [{"id": "anchored_parent", "permanent": 1}, {"id": "recent_obs", "access": 5, "ts": young}, {"id": "accessed_old", "access": 3, "ts": old}]
    e = [("root", "child1", 1.0), ("root", "child2", 1.0), ("child1", "grandchild1", 1.0), ("child2", "grandchild2", 1.0), ("anchored_parent", "grandchild1", 1.0), ("connected_old", "recent_obs", 1.0)]
    g, now = graph(spark, n, e), F.lit(NOW)
    assert ids(lifecycle.decay_candidates(g, now)) == ["isolated_old"]
    after, log = lifecycle.auto_decay(g, now)
    assert ids(log) == [("isolated_old", "direct")] and ids(after.nodes.where("decayed = 1"), "id") == ["isolated_old"]
    assert audit.rows(g, log, NOW).count() == 1
    dead = g.nodes.where("id = 'root'").select("id")
    assert ids(lifecycle.cascade(lifecycle.decayed(g, dead), dead, now), "id") == ["child1", "child2", "grandchild2"]


def test_beam_is_sequential(spark):
    rng = random.Random(4)
    names = [f"n{i:02d}" for i in range(40)]
    vectors = {i: [rng.gauss(0, 1) for _ in range(4)] for i in names if rng.random() < 0.9}
    e = sorted({(rng.choice(names), rng.choice(names)) for _ in range(90)})
    g = graph(spark, names, [(a, b, 1.0) for a, b in e if a != b], vectors.items())
    q = [1.0, 0.5, -0.2, 0.1]

    def cos(i):
        v = vectors.get(i)
        return 0.0 if v is None else sum(a * b for a, b in zip(v, q)) / (sum(a * a for a in v) ** 0.5 * sum(b * b for b in q) ** 0.5)

    near = {i: {b if a == i else a for a, b in e if i in (a, b) and a != b} for i in names}
    seeds = [(i, cos(i)) for i in sorted(vectors, key=lambda i: (-cos(i), i))[:3]]
    taken, frontier = [i for i, _ in seeds], [i for i, _ in seeds]
    for _ in range(3):
        level = []
        for f in frontier:
            for i in sorted(near[f] - set(taken), key=lambda i: (-round(cos(i), 12), i))[:2]:
                taken.append(i)
                level.append(i)
        frontier = level
    for wide in (0, 4, 1000):  # neighbours are ranked where they are, or on the driver
        assert [i for _, i, _, _ in walk.beam_events(g, q, seeds, 2, 3, wide)] == taken
    assert retrieve.beam(g, q, 5).count() == 5


def test_cliques_are_not_components(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("x", "y", 1.0), ("y", "z", 1.0), ("x", "z", 1.0)], "a string, b string, sim double")
    assert ids(consolidate.cliques(pairs), "id", "cluster") == [("a", "a"), ("b", "a"), ("x", "x"), ("y", "x"), ("z", "x")]
    assert ids(consolidate.components(pairs)) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("z", "x")]


def test_cycle_settles(spark):
    base = [[1, 0, 0, 0], [0.999, 0.01, 0, 0], [0.92, 0.39, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
    n = [{"id": f"n{i}", "access": i, "source": f"s{i % 2}", "content": f"text {i}", "ts": NOW - dt.timedelta(days=30)} for i in range(5)]
    g = graph(spark, n, [("n3", "n4", 0.5)], [(f"n{i}", v) for i, v in enumerate(base)])
    p = config.Profile("t", 4, 0.85, 0.99, 0.9)
    after, report = sleep.cycle(g, p, NOW, gc_mode="off")
    assert report["clusters"] == 1 and report["merged"] == 1 and report["links"] == 2 and report["dream"]
    live = ids(schema.live(after.nodes), "id")
    assert "n0" not in live and "n1" in live and len(live) == 5
    ends = {r["parent_id"] for r in after.edges.collect()} | {r["child_id"] for r in after.edges.collect()}
    assert "n0" not in ends and after.edges.groupBy("parent_id", "child_id").count().where("count > 1").count() == 0
    again, second = sleep.cycle(after, p, NOW, gc_mode="off")
    assert second["links"] == 0 and second["merged"] == 0
    hard, third = sleep.cycle(g, p, NOW, gc_mode="hard")
    assert hard.nodes.count() < after.nodes.count() or third["collected"] == 0


def test_recency_and_event_time(spark):
    df = spark.createDataFrame([(NOW,), (NOW - dt.timedelta(days=365),), (None,), (NOW + dt.timedelta(days=1),)], "ts timestamp")
    got = [round(r[0], 4) for r in df.select(clock.recency_weight(F.col("ts"), F.lit(NOW))).collect()]
    assert got == [1.0, 0.6839, 1.0, 1.0]
    t = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00",), ("x",), ("",), (None,), ("2024-01-01T02:00:00+02:00",)], "t string")
    assert [r[0] is not None for r in t.select(clock.event_time(F.col("t"))).collect()] == [True, False, False, False, False, True]
    with pytest.raises(Exception, match="not a time"):
        t.select(clock.event_time(F.col("t"), strict=True)).collect()


def test_text(spark):
    def one(column, value):
        return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]

    assert sorted(one(tx.anchors, "On 2024-01-05 we met Monday, 3 days ago and in March 2021")) == ["2021", "2024", "2024-01-05", "3 days ago", "march 20", "march 2021", "monday"]
    assert [r["content"] for r in one(tx.extracted, "I decided to write the whole thing again. my opinion is tests help us.")][:2] == ["Decision: write the whole thing again", "Belief: tests help us"]
    assert one(tx.paragraphs, "---\na: b\n---\n# Head\n\nA paragraph  with [a link](http://x) and more\n\nshort") == ["A paragraph with a link and more"]
    assert one(tx.wikilinks, "see [[Note A|alias]] and [[ B ]]") == ["Note A", "B"]
    assert one(lambda c: tx.statement_kind(c), "We found that it works") == "insight"
    assert one(lambda c: tx.merged_tags(c, F.lit("b,a")), "c, a") == "a,b,c"
    kind, rest = tx.typed_statement("t", ("fact", "belief"))
    assert tuple(spark.createDataFrame([("[Belief] so it is",)], "t string").select(kind, rest).first()) == ("belief", "so it is")
    assert tx.keywords("What is the Spark engine?") == ["spark", "engine"]


def test_config(monkeypatch):
    monkeypatch.setenv("X_NAME", "v")
    assert config.expand_env("${X_NAME:-d}/${Y_NAME:-d}") == "v/d"
    assert [config.retention_hours(x) for x in ("24h", "2d", "1w", "5")] == [24, 48, 168, 5]
    with pytest.raises(ValueError):
        config.Profile("bad", 4, 0.9, 0.8, 0.9)
    with pytest.raises(KeyError):
        config.profile("unknown")


def test_stats_odd(spark):
    empty = graph(spark, [{"id": "x"}], []).with_(nodes=graph(spark, ["x"], []).nodes.limit(0))
    assert stats.graph_summary(empty).first()["active_nodes"] == 0 and stats.recommended_threshold(empty).first()[0] == 10
    g = graph(spark, ["a", "b", "c"], [], [("a", [1, 0]), ("b", [0, 0]), ("c", [float("nan"), 1]), ("z", [1])])
    assert dict(ids(stats.integrity(g, 2))) == {"sound": 1, "zero_norm": 1, "not_finite": 1, "wrong_dim": 1, "without_node": 1}
    assert ids(search.top_k(g, [1.0, 0.0], 5), "node_id") == ["a"]
    assert ids(stats.integrity_ids(g, 2)) == [("not_finite", "c"), ("without_node", "z"), ("wrong_dim", "z"), ("zero_norm", "b")]


def test_bad_vectors_take_no_part(spark):
    """NaN, infinite, zero and wrong-dimension vectors are left in: searches and joins see the sound ones only."""
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1, 0]), ("b", [0.9, 0.1]), ("c", [1]), ("d", [nan, 1]), ("e", [0, 0]), ("f", [inf, 1]), ("g", [0, 1, 1]), ("h", [0, 1])]
    g = graph(spark, [i for i, _ in rows], [], rows)
    assert ids(search.top_k(g, [1.0, 0.0], 9), "node_id") == ["a", "b", "h"]
    assert ids(similarity.cosine_pairs(g.emb, 0.5), "a", "b") == [("a", "b")]
    assert similarity.pair_count(g.emb, 0.5).first()[0] == 1
    assert {r["node_id"]: round(r["max_sim"], 3) for r in search.nearest(g.emb).collect()} == {"a": 0.994, "b": 0.994, "h": 0.11}
    cand = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [nan, 1.0]), ("z", [1.0])], "cand_id string, vector array<double>")
    found = {r["cand_id"]: (r["nearest"], r["is_novel"]) for r in search.novelty(g, cand, 0.9).collect()}
    assert found == {"x": ("a", False), "y": (None, True), "z": (None, True)}
    assert ids(search.similar_links(g, g.emb.where("node_id in ('a', 'd')"), 3, 0.0), "a", "b") == [("a", "b"), ("a", "h")]
    assert similarity.calibration(g.emb).first()["pairs"] == 3
    events = list(walk.beam_events(g.with_(edges=spark.createDataFrame([("a", "d", 1.0, None), ("a", "b", 1.0, None)], EDGE)), [1.0, 0.0], [("a", 1.0)]))
    assert [(i, round(s, 3)) for _, i, s, _ in events] == [("a", 1.0), ("b", 0.994), ("d", 0.0)]


def test_schema_versions(spark):
    old = spark.createDataFrame([("a", "t", "seed", 0.5)], "id string, content string, node_type string, confidence double")
    n = schema.normalize_nodes(old)
    assert n.columns == list(schema.NODE_COLUMNS) and n.first()["permanent"] == 1


def test_notes(spark, tmp_path):
    (tmp_path / "work").mkdir()
    (tmp_path / "a.md").write_text("First note links to [[b]] with enough text here")
    (tmp_path / "b.md").write_text("Second note without any link but with enough text")
    (tmp_path / "work" / "c.md").write_text("Third note in a folder that has enough text too")
    (tmp_path / "skip.md").write_text("This one is ignored by a pattern in the list")
    found = files.notes(spark, str(tmp_path), ["skip*", "# comment"])
    assert ids(found, "path", "domain") == [("a.md", "default"), ("b.md", "default"), ("work/c.md", "work")]
    assert files.notes(spark, str(tmp_path), ["work/"]).count() == 3
    assert files.notes(spark, str(tmp_path), (), found.select("path", "mtime")).select("path").first()[0] == "skip.md"
    nodes = ingest.new_nodes(files.note_paragraphs(found), graph(spark, [], []).nodes) if False else files.note_paragraphs(found).withColumn("id", tx.content_id("content"))
    assert files.wikilink_edges(found, nodes).count() == 2


def test_archive_and_sessions(spark, tmp_path):
    talk = [{"uuid": "u1", "updated_at": "2", "chat_messages": [{"sender": "human", "text": "plain", "content": [{"type": "text", "text": "a"}, {"type": "tool", "text": "x"}, {"type": "text", "text": "b"}]}, {"sender": "assistant", "text": "only", "content": []}]}]
    (tmp_path / "chat.json").write_text(json.dumps(talk))
    assert ids(files.chat_archive(spark, str(tmp_path / "chat.json")), "ordinal", "text") == [(0, "a\n\nb"), (1, "only")]
    state = spark.createDataFrame([("u1", "2")], "uuid string, updated_at string")
    assert files.chat_archive(spark, str(tmp_path / "chat.json"), state).count() == 0
    (tmp_path / "s").mkdir()
    lines = [{"role": "user", "content": "x" * 60}, {"role": "user", "content": "x" * 60}, {"role": "system", "content": "y" * 60}]
    (tmp_path / "s" / "one.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    assert files.session_lines(spark, str(tmp_path / "s")).count() == 3
    for _ in range(2):
        streaming.ingest(streaming.session_stream(spark, str(tmp_path / "s")), str(tmp_path / "nodes"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "nodes")).count() == 1


def test_export_and_snapshot(spark, tmp_path, lines):
    files.export_json(lines, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "edges")).count() == 6
    files.snapshot(lines, str(tmp_path), "2024-01-01")
    assert files.restored(spark, str(tmp_path), "2024-01-01").edges.count() == 6
    assert files.expired(["b", "a", "c"], 2) == ["a"]


def test_access_and_pins(spark, lines):
    hit = lines.nodes.where("id = 'seed1'").select("id")
    assert lifecycle.touched(lines.nodes, hit, F.lit(NOW)).where("access_count = 1").count() == 1
    assert lifecycle.pinned(lines.nodes, ["seed1"]).where("permanent = 2").count() == 1


@pytest.mark.parametrize("block", [2048, 7])
def test_cosine_pairs_meet_once(spark, block):
    r = random.Random(5)
    vectors = [(f"n{i}", [r.gauss(0, 1) for _ in range(4)]) for i in range(40)] + [("zero", [0.0] * 4)]
    emb = spark.createDataFrame(vectors, "node_id string, vector array<double>")
    size = lambda v: sum(x * x for x in v) ** 0.5 or 1.0
    sims = {(a, b): sum(x * y for x, y in zip(v, w, strict=True)) / size(v) / size(w) for a, v in vectors for b, w in vectors if a < b}
    want = sorted((a, b, round(s, 6)) for (a, b), s in sims.items() if 0.2 <= s < 0.9)
    assert sorted((x.a, x.b, round(x.sim, 6)) for x in similarity.cosine_pairs(emb, 0.2, 0.9, block=block).collect()) == want


def test_metadata_of_a_cluster_is_merged_with_the_keeper_last(spark):
    rows = [("c", "a", "b", '{"x": 1, "y": {"z": [1, "q"]}, "a\\"b": null}'), ("c", "b", "b", '{"x": "own", "n": true}'), ("c", "d", "b", '{"y": 2, "n": false}'), ("c", "e", "b", "no json"), ("c", "f", "b", "[1]"), ("d", "g", "g", None)]
    got = {r["cluster"]: json.loads(r["metadata"]) for r in consolidate.merged_metadata(spark.createDataFrame(rows, "cluster string, id string, keeper string, metadata string")).collect()}
    assert got == {"c": {"x": "own", "y": 2, "n": True, 'a"b': None}, "d": {}}


def test_moods_and_edges_that_are_left_out(spark):
    g = graph(spark, [{"id": i, "content": i} for i in "abc"], [("a", "b", 1.0), ("b", "b", 1.0), ("c", "b", 1.0), ("b", "a", 1.0)])
    g = g.with_(nodes=g.nodes.withColumn("mood_state", F.when(F.col("id") != "c", "calm")))
    clusters = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "c")], "cluster string, id string")
    assert consolidate.cluster_properties(g, clusters).first()["mood_state"] == "calm"
    assert ids(stats.degrees_without(g.edges), "parent_id", "child_id", "rest") == [("a", "b", 3), ("b", "a", 1), ("b", "b", 3), ("c", "b", 3)]
    assert stats.embedding_overview(g).first()["coverage_percent"] == 0.0
