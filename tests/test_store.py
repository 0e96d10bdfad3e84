"""The log of states: size of what is written, conflicts, crashes at every step, compaction."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from graphloom import shared, store
from graphloom.schema import Graph


def written(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def rows(graph, table, *columns):
    return sorted((tuple(r[c] for c in columns) for r in getattr(graph, table).collect()), key=repr)


@pytest.fixture(scope="module")
def big(spark):
    n = spark.range(20_000).selectExpr("concat('n', id) AS id", "repeat(sha2(cast(id AS string), 256), 3) AS content", "'fact' AS node_type", "cast(id % 7 AS int) AS access_count", "0 AS decayed")
    e = spark.range(1, 20_000).selectExpr("concat('n', id DIV 3) AS parent_id", "concat('n', id) AS child_id", "0.5D AS weight", "'r' AS reasoning")
    v = spark.range(100).selectExpr("concat('n', id) AS node_id", "array(1.0D, cast(id AS double)) AS vector", "'m' AS model")
    return Graph(n, e, v)


@pytest.fixture()
def small(spark):
    n = spark.createDataFrame([(i, f"text {i}", k, 0) for k, i in enumerate("abcde")], "id string, content string, access_count int, decayed int")
    e = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.25), ("c", "d", 0.125)], "parent_id string, child_id string, weight double")
    return Graph(n, e, spark.createDataFrame([("a", [1.0, 2.0])], "node_id string, vector array<double>"))


def test_a_touch_of_one_node_writes_a_delta_of_its_size(spark, big, tmp_path):
    folder = str(tmp_path / "g")
    assert store.save(big, folder) == 1
    whole = written(folder)
    touched = big.nodes.withColumn("access_count", F.when(F.col("id") == "n7", 99).otherwise(F.col("access_count")))
    assert store.save(big.with_(nodes=touched.where("id <> 'n9'"), edges=big.edges.where("child_id <> 'n9'")), folder) == 2
    assert written(folder) - whole < whole / 50
    last = store.entry(spark, folder)
    assert set(last.deltas[0][1]) == {"nodes", "edges"} and store.save(store.load(spark, folder), folder) == 2
    back = store.load(spark, folder)
    assert back.nodes.count() == 19_999 and back.edges.count() == 19_998 and store.node(back, "n7", ["access_count"]) == {"access_count": 99} and store.node(back, "n9") is None
    assert store.load(spark, folder, 1).nodes.count() == 20_000
    plan = back.nodes._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # the base is not shuffled


def test_of_two_writers_of_one_row_one_fails_and_other_rows_go_on_top(spark, small, tmp_path):
    folder = str(tmp_path / "g")
    read = store.save(small, folder)
    change = lambda i, text: {"nodes": spark.createDataFrame([(i, text)], "id string, content string")}
    assert store.commit(spark, folder, read, change("a", "first")) == 2
    with pytest.raises(store.Conflict):
        store.commit(spark, folder, read, change("a", "second"))
    assert store.commit(spark, folder, read, change("b", "other")) == 3
    assert store.commit(spark, folder, read, {}, {"edges": spark.createDataFrame([("a", "b")], "parent_id string, child_id string")}) == 4
    assert [x for x in rows(store.load(spark, folder), "nodes", "id", "content") if x[0] in "ab"] == [("a", "first"), ("b", "other")]
    assert store.compact(spark, folder) == 5 and store.entry(spark, folder).deltas == []
    with pytest.raises(store.Conflict):  # the base has taken the change up, the log still tells
        store.commit(spark, folder, read, change("a", "third"))
    assert store.commit(spark, folder, read, change("c", "late")) == 6
    assert not store.put(spark, folder, store.Entry(6)) and not [f for f in os.listdir(tmp_path / "g" / "log") if f.startswith("_draft")]
    assert rows(store.load(spark, folder), "edges", "parent_id", "child_id") == [("b", "c"), ("c", "d")]


@pytest.mark.parametrize("step", ["delta", "draft", "rename"])
def test_a_crash_leaves_the_old_state_or_the_new_one(spark, small, tmp_path, monkeypatch, step):
    folder = str(tmp_path / "g")
    store.save(small, folder)
    new = small.with_(nodes=small.nodes.withColumn("content", F.lit("new")))

    def crash(*_, **__):
        raise OSError("crash")

    real = store.put
    if step == "delta":  # between the delta and the entry
        monkeypatch.setattr(store, "put", crash)
    elif step == "draft":  # half of the draft is written
        monkeypatch.setattr(store, "written_text", lambda s, path, text, **_: (shared.written_text(s, path, text[:5]), crash()))
    else:  # the entry is in place, its writer does not hear of it
        monkeypatch.setattr(store, "put", lambda *a: (real(*a), crash()))
    with pytest.raises(OSError):
        store.save(new, folder)
    monkeypatch.undo()
    expected = "new" if step == "rename" else None
    for _ in range(2):
        got = {c for (c,) in rows(store.load(spark, folder), "nodes", "content")}
        assert got == ({"new"} if expected else {f"text {i}" for i in "abcde"})
        store.vacuum(spark, folder, hours=0)
    assert store.save(new, folder) == (2 if expected is None else store.numbers(spark, folder)[0])
    assert {c for (c,) in rows(store.load(spark, folder), "nodes", "content")} == {"new"}


def test_many_saves_are_compacted_and_old_folders_go(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST", 3)
    folder = str(tmp_path / "g")
    for k in range(5):
        store.save(small.with_(nodes=small.nodes.withColumn("access_count", F.lit(k))), folder)
    last = store.entry(spark, folder)
    assert len(last.deltas) < 3 and {n for (n,) in rows(store.load(spark, folder), "nodes", "access_count")} == {4}
    store.vacuum(spark, folder, keep=1, hours=0)
    assert {n.split("/")[0] for n in last.folders()} == {n for n in os.listdir(folder) if "-" in n}
    with pytest.raises(store.Conflict):
        store.commit(spark, folder, 1, {"nodes": small.nodes})


def test_odd_rows_and_the_earlier_format(spark, small, tmp_path):
    folder = str(tmp_path / "g")
    twice = small.nodes.unionByName(small.nodes).unionByName(spark.createDataFrame([(None, "no id", 0, 0)], small.nodes.schema))
    store.save(small.with_(nodes=twice, metrics=spark.createDataFrame([(1, "t", dt.datetime(2024, 1, 1))], "id long, metric_type string, ts timestamp")), folder)
    assert rows(store.load(spark, folder), "nodes", "id") == [(i,) for i in "abcde"] and store.load(spark, folder).metrics.count() == 1
    assert store.save(small.with_(edges=small.edges.limit(0), metrics=None), folder) == 2 and store.load(spark, folder).metrics.count() == 1 and store.load(spark, folder).edges.count() == 0
    old = tmp_path / "old"
    small.nodes.write.parquet(str(old / "v-1" / "nodes"))
    (old / "current.json").write_text(json.dumps({"current": "v-1", "before": []}))
    assert store.load(spark, str(old)).nodes.count() == 5 and store.load(spark, str(old)).edges.count() == 0
    assert store.save(small, str(old)) == 1 and store.load(spark, str(old)).edges.count() == 3
