"""What a review found to be less than the whole job, in the graph operators."""

import dataclasses

import numpy as np

from graphloom import fixtures, queries
from graphloom.operators import lineage
from graphloom.schema import live

SF = "/root/testdata/sf0.001"


def test_novelty_of_every_embedding(spark):
    g = fixtures.graph(spark, SF)
    rows = g.emb.select("node_id", "vector").collect()
    alive = {r["id"] for r in live(g.nodes).select("id").collect()}
    m = np.array([r["vector"] for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sims = (m @ m[[i for i, r in enumerate(rows) if r["node_id"] in alive]].T).max(1).clip(0)
    found = {r["cand_id"]: r for r in queries.QUERIES["novelty_check"](spark, SF).collect()}
    assert len(found) == len(rows) and set(found) == {r["node_id"] for r in rows}
    for r, s in zip(rows, sims):
        assert abs(found[r["node_id"]]["max_sim"] - s) < 1e-5 and found[r["node_id"]]["is_novel"] == (s < queries.P.novelty)


def test_long_cycles_are_found(spark):
    g = fixtures.graph(spark, SF)
    ring = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 53}") for i in range(53)], "parent_id string, child_id string")
    assert lineage.cyclic(dataclasses.replace(g, edges=ring)).count() == 53
