"""What SQL has no words for, held against sequential versions on the whole test tables; and patterns on texts that those lack."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom import fixtures, queries, shared
from graphloom.functions import text as tx
from graphloom.operators import consolidate, lineage
from tests.test_operators import graph

SF = "/root/testdata/sf0.01"


def greedy_cliques(pairs):
    """All maximal cliques by Bron and Kerbosch without a pivot; largest first, each takes its free nodes if there are two."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = []

    def grow(r, p, x):
        if not p and not x:
            found.append(sorted(r))
        for v in sorted(p):
            grow(r | {v}, p & near[v], x & near[v])
            p, x = p - {v}, x | {v}

    grow(set(), set(near), set())
    used, out = set(), []
    for c in sorted(found, key=lambda c: (-len(c), "\x01".join(c))):
        left = [v for v in c if v not in used]
        if len(left) >= 2:
            used |= set(left)
            out += [(left[0], v) for v in left]
    return sorted(out)


@pytest.mark.parametrize(("name", "least"), [("dedup_clusters", 0.45), ("link_clusters", 0.35)])
def test_clusters_of_the_query(spark, name, least):
    g = fixtures.graph(spark, SF)
    alive = {r["id"] for r in g.nodes.where("coalesce(decayed, 0) = 0").select("id").collect()}
    rows = [r for r in g.emb.collect() if r["node_id"] in alive]
    m = np.array([r["vector"] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(m @ m.T >= least, 1))
    want = greedy_cliques([(rows[a]["node_id"], rows[b]["node_id"]) for a, b in zip(i, j)])
    assert want and sorted(map(tuple, queries.QUERIES[name](spark, SF).collect())) == want


@pytest.mark.parametrize("seed", range(3))
def test_cliques_of_dense_graphs(spark, seed):
    r = random.Random(seed)
    names = [f"v{i:02d}" for i in range(14)]
    pairs = [p for p in itertools.combinations(names, 2) if r.random() < 0.6]
    found = consolidate.cliques(spark.createDataFrame(pairs, "a string, b string")).collect()
    assert sorted(map(tuple, found)) == greedy_cliques(pairs)


def test_beam_of_the_query(spark):
    """The walk from the five nearest nodes, step by step, over the whole graph."""
    g = fixtures.graph(spark, SF)
    q = np.array(fixtures.query_vector(spark, SF))
    cos = {r["node_id"]: float(np.dot(r["vector"], q) / np.linalg.norm(r["vector"]) / np.linalg.norm(q)) for r in g.emb.collect()}
    info = {r["id"]: r for r in g.nodes.collect()}
    live = {i for i, r in info.items() if not r["decayed"]}
    near = {}
    for e in g.edges.collect():
        near.setdefault(e["parent_id"], set()).add(e["child_id"])
        near.setdefault(e["child_id"], set()).add(e["parent_id"])
    seeds = sorted((i for i in cos if i in live), key=lambda i: (-cos[i], i))[:5]
    level, frontier = dict.fromkeys(seeds, 0), seeds
    for depth in (1, 2, 3):
        chosen = []
        for n in frontier:
            for i in sorted((x for x in near.get(n, ()) if x not in level), key=lambda x: (-cos.get(x, 0.0), x))[:3]:
                level[i] = depth
                chosen.append(i)
        frontier = chosen
    ranked = sorted(level, key=lambda i: (-cos.get(i, 0.0), i))[:30]
    kept = [i for i in ranked if i in live]
    want = sorted(((i, info[i]["node_type"], level[i], round(cos.get(i, 0.0), 6)) for i in kept), key=lambda r: (-r[3], r[0]))[:10]
    assert sorted(map(tuple, queries.QUERIES["beam_bfs"](spark, SF).collect())) == sorted(want)


TEXTS = [
    "We will ship the parser soon. I decided to stay here and plan to überprüfen was möglich ist",
    "They are going to visit Łódź next week; my opinion is that it seems like a good idea to go",
    "I think, or believe so. Probably it will rain_2 tomorrow morning and Likely stay wet. The Committee met on Tuesday in Paris.",
    "Am 3 März; on March 3, 2024 or 12 may, in June 2021, 2024-01-05 and 1/2/24, last Friday, two days ago, in 5 weeks, couple of years ago",
    "",
    "x. Short. A sentence without capital is here but Word is not.",
]


def plain_extract(text):
    out = []
    for p in (r"will\s+(\w+(?:\s+\w+){1,8})", r"decided\s+to\s+(\w+(?:\s+\w+){1,8})", r"plan\s+to\s+(\w+(?:\s+\w+){1,8})", r"going\s+to\s+(\w+(?:\s+\w+){1,8})"):
        out += [(f"Decision: {m[1].strip()}", "decision") for m in re.finditer(p, text, re.I)]
    for p in (r"(think|believe|seems\s+like|probably|likely)\s+(\w+(?:\s+\w+){1,10})", r"my\s+opinion\s+is\s+(\w+(?:\s+\w+){1,10})"):
        out += [(f"Belief: {m[m.lastindex].strip()}", "belief") for m in re.finditer(p, text, re.I)]
    out += [(f"Observation: {s}", "observation") for s in map(str.strip, text.split(".")) if 20 < len(s) < 100 and re.search("[A-Z][a-z]+", s)]
    return out[:5]


def test_statements_in_any_script(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    found = {r["i"]: [tuple(x) for x in r["x"]] for r in rows.select("i", tx.extracted(F.col("t")).alias("x")).collect()}
    assert found == {i: plain_extract(t) for i, t in enumerate(TEXTS)}
    assert ("Decision: ship the parser soon", "decision") in found[0] and ("Decision: überprüfen was möglich ist", "decision") in found[0]


def test_anchors_in_any_script(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    found = {r["i"]: set(r["x"]) for r in rows.select("i", tx.anchors(F.col("t")).alias("x")).collect()}
    assert {"march 3, 2024", "12 may", "june 2021", "2024-01-05", "1/2/24", "friday", "last friday", "two days ago", "in 5 weeks", "couple of years ago", "2024", "2021"} <= found[3] and found[4] == set()
    hit = rows.select(tx.has_anchor(F.col("t"), F.array(F.lit("last friday"))).alias("x")).collect()
    assert [r["x"] for r in hit] == [False, False, False, True, False, False]


@pytest.mark.parametrize("seed", range(3))
def test_cycles_by_components(spark, seed):
    """Nodes on a cycle and one path for each back edge, on random graphs with rings, loops and branches."""
    r = random.Random(seed)
    names = [f"n{i:02d}" for i in range(16)]
    edges = sorted({(r.choice(names), r.choice(names)) for _ in range(20)} | {("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("loop", "loop"), ("r2", "tail")})
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)

    def reach(a):
        met, todo = set(), [a]
        while todo:
            for b in near.get(todo.pop(), ()):
                if b not in met:
                    met.add(b)
                    todo.append(b)
        return met

    g = graph(spark, [], [(a, b, 1.0) for a, b in edges])
    want = sorted(n for n in {x for e in edges for x in e} if n in reach(n))
    assert sorted(x["id"] for x in lineage.cyclic(g).collect()) == want
    paths = [r["cycle"] for r in lineage.cycle_lists(g).collect()]
    assert all(p[0] == p[-1] and len(set(p[1:])) == len(p) - 1 and all((a, b) in edges for a, b in zip(p, p[1:])) for p in paths)
    assert ["r2", "r0", "r1", "r2"] in paths and ["loop", "loop"] in paths and {x for p in paths for x in p} <= set(want)
    assert len({tuple(p) for p in paths}) == len(paths)
    # the same closing edges from breadth-first trees, one component after another
    component = {a: max(b for b in reach(a) if a in reach(b)) for a in want if any(a != b and a in reach(b) for b in reach(a))}
    closing = {(a, a) for a, b in edges if a == b}
    for leader in set(component.values()):
        above, layer, seen = {leader: ()}, [leader], {leader}
        while layer:
            new = {}
            for a in sorted(layer):
                for b in near[a]:
                    if component.get(b) == leader and b not in seen:
                        new.setdefault(b, a)
            for b, a in new.items():
                above[b] = (*above[a], a)
            seen |= set(new)
            layer = list(new)
        closing |= {(a, b) for a in above for b in near[a] if a != b and b in above[a]}
    assert {(p[-2], p[-1]) for p in paths} == closing


def test_cliques_around_a_hub(spark):
    """A node that all others are linked with, and every maximal clique by the plain rule."""
    r = random.Random(4)
    edges = {("hub", f"n{i:03}") for i in range(120)} | {tuple(sorted((f"n{r.randrange(40):03}", f"n{r.randrange(40):03}"))) for _ in range(220)}
    edges = {(a, b) for a, b in edges if a != b} | {("x", "y")}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, todo = set(), [(frozenset(), frozenset(near), frozenset())]
    while todo:
        chosen, may, out = todo.pop()
        if not may and not out:
            want.add(chosen)
        while may:
            v = min(may)
            todo.append((chosen | {v}, may & near[v], out & near[v]))
            may, out = may - {v}, out | {v}
    got = consolidate.maximal_cliques(spark.createDataFrame(sorted(edges), "a string, b string")).collect()
    assert len(got) == len(want) and {frozenset(x["members"]) for x in got} == want and all(x["size"] == len(x["members"]) for x in got)


def test_cliques_of_near_copies_move_no_triangles(spark):
    """Two large groups of copies with a few links more: 85,000 triangles, but only lists of neighbours are moved, each at most once a group of nodes."""
    r = random.Random(6)
    names = [f"c{i}" for i in range(140)]
    pairs = {tuple(sorted(p)) for p in itertools.combinations(names[:80], 2)} | {tuple(sorted(p)) for p in itertools.combinations(names[75:130], 2)}
    pairs |= {tuple(sorted(r.sample(names, 2))) for _ in range(60)}
    links = spark.createDataFrame(sorted(pairs), "a string, b string")
    numbers, small = consolidate._numbers(links)
    assert [x["id"] for x in numbers.orderBy("k").collect()] == sorted({x for p in pairs for x in p})
    found = consolidate._cliques_by_first(small)
    moved = [str(x) for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x]
    assert len(moved) == 1 and not [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "FlatMapGroups" in x]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    best, todo = [], [(frozenset(), frozenset(near), frozenset())]
    while todo:
        chosen, may, out = todo.pop()
        if not may and not out:
            best.append(sorted(chosen))
            continue
        pivot = max(may | out, key=lambda v: len(near[v] & may), default=None)
        for v in sorted(may - near[pivot]) if may else ():
            todo.append((chosen | {v}, may & near[v], out & near[v]))
            may, out = may - {v}, out | {v}
    used, want = set(), []
    for c in sorted(best, key=lambda c: (-len(c), "\x01".join(c))):
        left = [v for v in c if v not in used]
        if len(left) >= 2:
            used |= set(left)
            want += [(left[0], v) for v in left]
    assert sorted(map(tuple, consolidate.cliques(links).collect())) == sorted(want)
    assert sorted(sorted(x["members"]) for x in consolidate.maximal_cliques(links).collect()) == sorted(best)


@pytest.mark.parametrize(("band", "room"), [(400, 1 << 12), (1 << 22, 1 << 27)])
def test_clusters_of_vectors_keep_cliques_packed(spark, monkeypatch, band, room):
    """Overlapping cliques, band by band and in more groups; what is written for them are blocks, neither pairs nor rounds of a row for each member."""
    rng = np.random.default_rng(7)
    middles = rng.standard_normal((3, 12))
    m = np.concatenate([rng.standard_normal((120, 12)), *[c + 0.75 * rng.standard_normal((9, 12)) for c in middles]])
    names = [f"n{i * 7919 % 997:03}" for i in range(len(m))]
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.35, 1))
    pairs = [tuple(sorted((names[a], names[b]))) for a, b in zip(i, j)]
    rows = [(n, v.tolist()) for n, v in zip(names, m)] + [(names[0], m[0].tolist()), (None, m[1].tolist()), ("odd", [0.0] * 12)]
    monkeypatch.setattr(consolidate, "BAND", band)
    monkeypatch.setattr(consolidate, "GROUP_BYTES", room)
    written = []
    monkeypatch.setattr(consolidate, "cut", lambda df: written.append(df.schema.names) or shared.cut(df))
    vectors = spark.createDataFrame(rows, "node_id string, vector array<double>")
    assert sorted(map(tuple, consolidate.cosine_cliques(vectors, 0.35, 12).collect())) == greedy_cliques(pairs)
    assert ["size", "members"] in written and not [names for names in written if {"a", "b"} <= set(names) or names == ["c", "members"]]
    assert sorted(map(tuple, consolidate.cliques(spark.createDataFrame(pairs, "a string, b string")).collect())) == greedy_cliques(pairs)


def test_sorted_lists_as_gaps():
    """Also lists of one number, parts of a batch, and gaps of more than two bytes."""
    near, far = [[5], [1, 2, 70_000 - 5_000], [9, 65_544]], [[1, 1 << 30], [7, 8]]
    for lists, wide in ((near, False), (far, True), (near + far, True)):
        whole = pa.array([[3, 4], *lists], pa.list_(pa.int32())).slice(1)
        v = pa.array(range(len(lists)), pa.int32())
        (got,) = consolidate._gaps([pa.RecordBatch.from_arrays([v, whole, whole], names=["v", "ws", "gs"])])
        rows = zip(got.column("first").to_pylist(), got.column("wide").to_pylist(), got.column("gaps").to_pylist(), strict=True)
        assert [list(itertools.accumulate(np.frombuffer(g, np.uint32 if w else np.uint16).tolist(), initial=f)) for f, w, g in rows] == lists
        assert set(got.column("wide").to_pylist()) == {wide}
