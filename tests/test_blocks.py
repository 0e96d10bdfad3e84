"""Blocks that lie apart do not meet, and nothing is lost by it."""

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest

from graphloom.config import Profile
from graphloom.operators import consolidate, similarity
from graphloom.schema import Graph


def clustered_rows(n=600, dim=12, groups=15, spread=0.15, seed=2):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((groups, dim))
    return [(f"n{i:04}", (middles[i % groups if i % 3 else 0] + spread * rng.standard_normal(dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("least", [0.5, 0.9, 0.97])
def test_pairs_are_those_of_all_blocks_and_fewer_blocks_meet(spark, least):
    rows = clustered_rows()
    emb = spark.createDataFrame(rows, "node_id string, vector array<double>")
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sims = m @ m.T
    got = {(r["a"], r["b"]) for r in similarity.cosine_pairs(emb, least, block=40).collect()}
    assert got == {(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(np.triu(sims >= least, 1)), strict=True)}
    assert similarity.pair_count(emb, least, block=40).first()["n"] == int(np.triu(sims > least, 1).sum())
    packed, balls = similarity.near_blocks(emb, 15, 40)
    assert sum(len(r["ids"]) for r in packed.select("ids").collect()) == 600 and max(len(r["ids"]) for r in packed.select("ids").collect()) < 80
    met = similarity.may_meet(balls, least)
    share = sum(map(len, met.values())) / len(met) ** 2
    print("blocks", len(met), "share of pairs that meet", share)
    assert least < 0.9 or share < 0.6


def test_vectors_without_structure_all_meet(spark):
    rng = np.random.default_rng(0)
    rows = [(f"n{i}", rng.standard_normal(6).tolist()) for i in range(120)]
    emb = spark.createDataFrame(rows, "node_id string, vector array<double>")
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    assert similarity.cosine_pairs(emb, 0.3, block=16).count() == int(np.triu(m @ m.T >= 0.3, 1).sum())


def counted(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many blocks a tile gets."""
    yield pa.RecordBatch.from_arrays([pa.array([sum(b.num_rows for b in batches)], pa.int64())], names=["n"])


@pytest.mark.parametrize("least", [-2.0, 0.0])
def test_copies_of_a_block_do_not_grow_with_the_blocks(spark, least):
    emb = spark.createDataFrame(clustered_rows(), "node_id string, vector array<double>")
    once = similarity._met_once(emb, 10, counted, "n long", least=least).agg({"n": "sum"}).first()[0]
    both = similarity._met(emb, emb, 10, counted, "n long").agg({"n": "sum"}).first()[0]
    assert 60 <= once <= 2 * 60 * (similarity.SIDE + 1) and both <= 2 * 60 * similarity.SIDE


def test_best_of_many_sides(spark):
    """Copies of vectors, where the last id counts, and an id that is there twice."""
    rows = clustered_rows(300)
    rows += [(f"x{i:04}", v) for i, (_, v) in enumerate(rows[:40])] + [rows[7]]
    emb = spark.createDataFrame(rows, "node_id string, vector array<double>")
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    names = np.array([i for i, _ in rows])
    sims = np.where(names[:, None] == names[None, :], -2.0, m @ m.T)
    got = {r["a"]: (r["b"], r["sim"]) for r in similarity.best_at_least(emb, emb, -1.5, others=True, block=9).collect()}
    assert set(got) == set(names)
    for i, name in enumerate(names):
        assert got[name][1] == pytest.approx(sims[i].max(), abs=1e-12) and got[name][0] in names[sims[i] >= sims[i].max() - 1e-12]
    top = {(r["a"], r["b"]) for r in similarity.top_each(emb.where("node_id like 'x%'"), emb, 3, 0.2, block=9).collect()}
    for name in names[300:340]:
        own = sims[list(names).index(name)]
        assert {b for a, b in top if a == name} <= set(names[own >= np.partition(np.unique(own), -4)[-4] - 1e-9])


@pytest.mark.parametrize("least", [0.5, 0.9])
def test_components_from_few_links(spark, least):
    rows = clustered_rows()
    emb = spark.createDataFrame(rows, "node_id string, vector array<double>")
    pairs, links = similarity.cosine_pairs(emb, least, block=10), similarity.link_forest(emb, least, block=10)
    want = sorted(map(tuple, consolidate.components(pairs).collect()))
    assert want and sorted(map(tuple, consolidate.components(links).collect())) == want
    assert links.count() <= 600 * (similarity.SIDE + 1) < pairs.count() or least == 0.9
    known = {(r["a"], r["b"]) for r in pairs.collect()}
    assert known
    assert sorted(map(tuple, consolidate.linked_components(emb, least).collect())) == want


def linked_graph(spark):
    """Sources that are equal, empty or null, and edges in both directions among the pairs of a band."""
    rows = clustered_rows(200)
    source = lambda i: (None, "", "one", "two", "three")[i // 7 % 5]
    nodes = spark.createDataFrame([(n, source(i), 0, 0) for i, (n, _) in enumerate(rows)], "id string, source_file string, decayed int, permanent int")
    r = random.Random(1)
    edges = [(rows[r.randrange(200)][0], rows[r.randrange(200)][0], 0.5, "x") for _ in range(3000)]
    edges = spark.createDataFrame(edges, "parent_id string, child_id string, weight double, reasoning string")
    return Graph(nodes, edges, spark.createDataFrame(rows, "node_id string, vector array<double>"), None), rows


@pytest.mark.parametrize("few", [0, 10**6])
def test_new_links_stay_where_they_are_found(spark, monkeypatch, few):
    g, rows = linked_graph(spark)
    p = Profile("any", 12, 0.5, 0.8, 0.8)
    monkeypatch.setattr(consolidate, "FEW", few)
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sims = m @ m.T
    source = {r["id"]: r["source_file"] or "" for r in g.nodes.collect()}
    known = {frozenset((r["parent_id"], r["child_id"])) for r in g.edges.collect()}
    band = {(rows[i][0], rows[j][0]): sims[i, j] for i, j in zip(*np.nonzero(np.triu((sims >= 0.5) & (sims < 0.8), 1)), strict=True)}
    want = {k for k in band if frozenset(k) not in known}
    apart = {(a, b) for a, b in want if not source[a] or source[a] != source[b]}
    assert set() < apart < want < set(band)
    found = consolidate.new_links(g, p)
    assert {(r["a"], r["b"]) for r in found.collect()} == want
    assert {(r["a"], r["b"]) for r in consolidate.new_links(g, p, True).collect()} == apart
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not few or ("BroadcastHashJoin" in plan and "SortMergeJoin" not in plan)
    best = max(((a, b) for a, b in apart if source[a] and source[b]), key=lambda k: band[k])
    assert [(r["a"], r["b"]) for r in consolidate.dream_link(g, p).collect()] == [best] == [(r["a"], r["b"]) for r in consolidate.dream_pair(g, found).collect()]
    both = consolidate.linked(g, found).edges
    assert both.count() == g.edges.count() + 2 * len(want) and {(r["parent_id"], r["child_id"]) for r in both.where("reasoning <> 'x'").collect()} == want | {(b, a) for a, b in want}
