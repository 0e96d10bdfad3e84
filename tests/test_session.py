"""Embedding and session plans with fakes in place of models."""

import datetime as dt

import numpy as np

from graphloom.operators import embed
from graphloom.plans import session
from tests.test_operators import graph, ids

NOW = dt.datetime(2024, 3, 31)


def test_embedding(spark):
    g = graph(spark, [{"id": "a", "content": "some words"}, {"id": "b", "content": " "}, {"id": "c", "content": "other words", "decayed": 1}, {"id": "d", "content": "some words"}], [], [("d", [0, 0]), ("z", [1, 0])])
    encoder = embed.hashing_encoder(8)
    assert ids(embed.embed_missing(g, encoder, "h").emb, "node_id") == ["a", "d", "z"]
    fixed = {r["node_id"]: r["vector"] for r in embed.repaired(g, encoder, "h").emb.collect()}
    assert sorted(fixed) == ["a", "d"] and np.isclose(np.linalg.norm(fixed["d"]), 1) and fixed["a"] == fixed["d"]
    empty = spark.createDataFrame([], "model string, hash string, vector array<double>")
    got, new = embed.through_cache(g.nodes, empty, encoder, "h")
    assert got.count() == 4 and new.count() == 3
    assert embed.through_cache(g.nodes, new, encoder, "h")[1].count() == 0
    assert ids(embed.re_embedded(g, encoder, "h").emb, "node_id") == ["a", "d"]


def test_extract_and_think(spark):
    g = graph(spark, [{"id": f"n{i}", "access": i} for i in range(6)], [("n0", "n1", 0.5)])
    assert session.extract(g, "short", NOW)[1] == 0
    answer = 'Sure:\n```json\n[{"content": "a new fact", "type": "fact"}, {"content": "dropped", "keep": false}, {"content": "odd", "type": "?"}]\n```'
    after, n = session.extract(g, "a conversation that is long enough", NOW, lambda _: answer)
    assert n == 2 and ids(after.nodes.where("source_file = 'session'"), "content", "node_type") == [("a new fact", "fact"), ("odd", "observation")]
    assert session.extract(after, "a conversation that is long enough", NOW, lambda _: answer)[1] == 0
    assert session.extract(g, "We are going to rewrite the parser soon.", NOW)[1] >= 1
    assert session.salvaged("no array here") == [] and session.salvaged("[not json]") == []
    thought, n = session.think(g, lambda _: '[{"content": "it follows"}]', NOW)
    assert n == 1 and thought.edges.count() == 6
    assert session.thinking_sample(g, 5).count() == 5
