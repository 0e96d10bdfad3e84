"""The inverted-file index: exact with all cells, recall with a few, backfill that touches only what changed."""

import glob
import os

import numpy as np
import pytest

from graphloom import fixtures as fx
from graphloom.operators import vector_index as vi
from graphloom.schema import Graph


def brute(rows, queries, k):
    sound = [(i, np.array(v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) >= 1e-6 and len(v) == 8]
    out = {}
    for q, v in queries:
        sims = [(-(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)).round(9), i) for i, w in sound if i != q]
        out[q] = [i for _, i in sorted(sims)[:k]]
    return out


def by_query(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (-round(r["sim"], 9), r["node_id"])):
        out.setdefault(r["q"], []).append(r["node_id"])
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((9, 8)) * 3
    made = [(f"n{i:04}", (centres[i % 9 if i % 3 else 0] + rng.standard_normal(8)).tolist()) for i in range(600)]  # a third of all near one centre
    return made + [("same1", made[5][1]), ("same2", made[5][1]), ("null", None), ("empty", []), ("zero", [0.0] * 8), ("nan", [float("nan")] * 8), ("short", [1.0, 2.0]), ("gap", [1.0, None] + [0.5] * 6)]


SCHEMA = "node_id string, vector array<double>"


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    return vi.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path_factory.mktemp("index") / "ivf"), cells=12, dim=8)


def test_all_cells_are_the_exact_search_in_blocks_of_any_size(spark, rows, index):
    asked = [r for r in rows if r[0] in ("n0000", "n0005", "same1", "n0333")]
    frame = spark.createDataFrame(asked + [("odd", None), ("short", [1.0, 2.0])], SCHEMA)
    for block in (7, 4096):
        assert by_query(vi.search(index, frame, 5, 0, block)) == brute(rows, asked, 5)
    assert vi.opened(spark, index.folder).probes == index.probes and (vi.opened(spark, index.folder).centres == index.centres).all()


def test_one_query_reads_its_cells_alone(spark, rows, index):
    nodes = spark.createDataFrame([(i, int(k % 50 == 5)) for k, (i, _) in enumerate(rows)], "id string, decayed int")
    graph = Graph(nodes, None, None)
    query = dict(rows)["n0010"]
    found = vi.top_k(index, graph, query, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and 0 < index.probes <= 12 and len(vi.cells_of(index, query)) == index.probes
    dead = {i for k, (i, _) in enumerate(rows) if k % 50 == 5}
    exact = [i for i in brute(rows, [("", np.array(query))], 700)[""] if i not in dead][:5]
    assert [r["node_id"] for r in vi.top_k(index, graph, query, 5, 0).collect()] == exact and len(set(exact) & {r["node_id"] for r in found.collect()}) >= 4
    assert vi.top_k(index, graph, [1.0], 5).count() == 0


def test_backfill_adds_what_is_missing_and_moves_what_changed(spark, rows, tmp_path):
    index = vi.build(spark.createDataFrame(rows[:500], SCHEMA), str(tmp_path / "ivf"), cells=12, dim=8)
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{index.folder}/rows/*/*.parquet")}
    assert vi.backfill(index, spark.createDataFrame(rows[:500], SCHEMA)) == 0
    moved = [("n0003", (-np.array(rows[3][1])).tolist())]
    before, place = files(), {r["node_id"]: r["cell"] for r in index.rows(spark).collect()}
    now = [r for r in rows if r[0] != "n0003"] + moved
    assert vi.backfill(index, spark.createDataFrame(now, SCHEMA)) == 103
    assert {f for f, t in before.items() if files().get(f) != t} == {f for f in before if f"cell={place['n0003']}/" in f}
    asked = [r for r in now if r[0] in ("n0003", "n0599")]
    assert by_query(vi.search(index, spark.createDataFrame(asked, SCHEMA), 5, 0)) == brute(now, asked, 5)
    assert vi.backfill(index, spark.createDataFrame(now, SCHEMA)) == 0


def test_no_vectors_no_cells(spark, tmp_path):
    none = spark.createDataFrame([("a", None)], SCHEMA)
    index = vi.build(none, str(tmp_path / "ivf"))
    assert vi.search(vi.opened(spark, index.folder), none).count() == 0 and vi.backfill(index, none) == 0
    one = vi.build(spark.createDataFrame([("a", [1.0, 0.0])], SCHEMA), str(tmp_path / "one"))
    assert vi.search(one, spark.createDataFrame([("q", [1.0, 1.0]), ("a", [1.0, 1.0])], SCHEMA)).select("q", "node_id").collect() == [("q", "a")]


def test_recall_of_the_test_vectors(spark, tmp_path):
    """The queries are all ids divisible by 20, the rows all vectors."""
    emb = fx.embeddings(spark, "/root/testdata/sf0.1")
    index = vi.build(emb, str(tmp_path / "ivf"))
    asked = emb.where("cast(substr(node_id, 2) AS INT) % 20 = 0")
    share = vi.recall(vi.search(index, asked), vi.search(index, asked, probes=0))
    print("recall", share, "probes", index.probes, "of", len(index.centres))
    assert share >= 0.9 and index.probes < len(index.centres)
