"""Formats by name and growing files: what is appended, half-written, restarted or out of order comes once."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.sources import files, readers
from graphloom.sources.registry import Archive, Registry, Sessions, StateFolder
from graphloom.streaming import ingest as streaming
from tests.test_operators import ids


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    readers.register(spark)


def run(stream, out, checkpoint):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_stream_gives_each_line_once(spark, tmp_path):
    folder, out, check = tmp_path / "s", str(tmp_path / "out"), str(tmp_path / "check")
    (folder / "deep").mkdir(parents=True)
    one, two = folder / "one.jsonl", folder / "deep" / "two.jsonl"
    one.write_text('{"n":1}\n{"n":2}\n{"n":')
    lines = lambda: run(spark.readStream.format("session_lines").option("bytes", 11).load(str(folder)), out, check)
    got = lambda: ids(spark.read.parquet(out), "path", "at", "value")
    lines()
    first = [("one.jsonl", 0, '{"n":1}'), ("one.jsonl", 8, '{"n":2}')]
    assert got() == first
    with one.open("a") as f:
        f.write('3}\n\n{"é":"' + "x" * 40 + '"}')  # the half line is completed; the last one is whole, but has no end
    two.write_text("not json\n{")
    lines()
    second = first + [("one.jsonl", 16, '{"n":3}'), ("one.jsonl", 25, '{"é":"' + "x" * 40 + '"}')]
    assert got() == sorted([*second, ("deep/two.jsonl", 0, "not json")])
    with one.open("a") as f:
        f.write('\n{"n":5}\n')
    lines()
    lines()
    assert got() == sorted([*second, ("deep/two.jsonl", 0, "not json"), ("one.jsonl", one.stat().st_size - 8, '{"n":5}')])


def test_lines_are_whole_wherever_a_partition_ends(tmp_path):
    rng = random.Random(3)
    text = "".join("é" * rng.randint(0, 9) + "\n" for _ in range(300))
    (tmp_path / "a.jsonl").write_text(text)
    raw, store = text.encode(), readers.store_of(str(tmp_path))[0]
    expected, at = [], 0
    for line in raw.split(b"\n")[:-1]:
        expected.append((at, line.decode()))
        at += len(line) + 1
    for size in (1, 2, 7, 64, 5000):
        got = []
        for part in readers.cut_up([("a.jsonl", 0, len(raw))], size):
            for p, start, to, end in part.pieces:
                got += readers.lines_of(store, str(tmp_path / p), start, to, end, start == 0)
        assert got == expected


def test_batch_state_waits_for_half_lines(spark, tmp_path):
    line = lambda t: json.dumps({"role": "user", "content": t * 120, "timestamp": "2024-01-01T00:00:00Z"})
    path = tmp_path / "s" / "a.jsonl"
    path.parent.mkdir()
    path.write_text(line("x") + "\n" + line("y")[:50])
    seen = files.session_state(spark, str(path.parent))
    assert files.session_lines(spark, str(path.parent)).count() == 1
    kept = spark.createDataFrame(seen.collect(), seen.schema)
    path.write_text(line("x") + "\n" + line("y") + "\n")
    assert ids(files.session_lines(spark, str(path.parent), kept), "content") == ["y" * 120]


def test_notes_are_packed_and_filtered_before_they_are_opened(spark, tmp_path):
    (tmp_path / "work" / "old").mkdir(parents=True)
    for name in ("a.md", "b.md", "work/c.md", "work/old/d.md", "skip.txt"):
        (tmp_path / name).write_text(f"note {name} " + "x" * 100)
    os.utime(tmp_path / "a.md", (1_600_000_000, 1_600_000_000))
    read = lambda **o: spark.read.format("notes").options(**o).load(str(tmp_path))
    assert ids(read(), "path", "domain") == [("a.md", "default"), ("b.md", "default"), ("work/c.md", "work"), ("work/old/d.md", "work")]
    assert ids(read(ignore="work/\n# no"), "path") == ["a.md", "b.md"] and ids(read(ignore="[ab].md"), "path") == ["work/c.md", "work/old/d.md"]
    assert read(bytes=150).rdd.getNumPartitions() == 4 and read(bytes=250).rdd.getNumPartitions() == 2 and read().rdd.getNumPartitions() == 1
    os.chmod(tmp_path / "b.md", 0)
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    old = read().where((F.col("mtime") < dt.datetime(2021, 1, 1)) & F.col("path").isin("a.md", "b.md"))
    assert ids(old, "path") == ["a.md"] and "mtime" in old._jdf.queryExecution().executedPlan().toString()
    reader = readers.NotesReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([readers.StringStartsWith(("path",), "work/"), readers.GreaterThan(("text",), "a")])) == [readers.GreaterThan(("text",), "a")]
    assert [f.path for f in reader.wanted()] == ["work/c.md", "work/old/d.md"]
    (tmp_path / "none").mkdir()
    assert spark.read.format("notes").load(str(tmp_path / "none")).count() == 0


def test_archives_are_read_piece_by_piece(spark, tmp_path):
    talks = [{"uuid": f"u{i}", "updated_at": str(i), "chat_messages": [{"text": 'brackets } ] \\" in "text" {' * i}]} for i in range(30)]
    (tmp_path / "a.json").write_text(json.dumps(talks, indent=1))
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, talks[:3])) + "\n{broken")
    rows = spark.read.format("chat_archive").load(str(tmp_path))
    assert rows.count() == 33 and all(json.loads(r["conversation"])["uuid"] == r["uuid"] for r in rows.collect())
    assert ids(rows.where("path = 'b.json'"), "uuid") == ["u0", "u1", "u2"]
    with (tmp_path / "a.json").open("rb") as f:
        assert [json.loads(raw) for _, raw in readers.objects(f, 7)] == talks


def test_only_newer_conversations_come_through(spark, tmp_path):
    before, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    before.mkdir()

    def put(name, *talks):
        (before / name).write_text(json.dumps([{"uuid": u, "updated_at": t, "name": n} for u, t, n in talks]))
        run(streaming.changed_conversations(streaming.archive_stream(spark, str(before))), out, check)
        return ids(spark.read.parquet(out), "uuid", "updated_at")

    first = [("u1", "2024-01-02"), ("u2", "2024-01-01")]
    assert put("a.json", ("u1", "2024-01-01", "old"), ("u1", "2024-01-02", "new"), ("u2", "2024-01-01", "x"), (None, "2024-01-01", "x")) == first
    assert put("b.json", ("u1", "2024-01-01", "late"), ("u2", "2024-01-01", "again")) == first
    assert put("c.json", ("u2", "2024-02-01", "y"), ("u3", None, "z"), ("u1", "2024-01-02", "same")) == sorted([*first, ("u2", "2024-02-01"), ("u3", None)], key=repr)
    assert {json.loads(r["conversation"])["name"] for r in spark.read.parquet(out).collect()} == {"new", "x", "y", "z"}


def test_states_are_tables_that_outlive_the_session(spark, tmp_path):
    from tests.test_operators import graph

    (tmp_path / "s").mkdir()
    line = lambda t: json.dumps({"role": "user", "content": t * 120}) + "\n"
    (tmp_path / "s" / "one.jsonl").write_text(line("x") + line("y")[:40])
    states, empty = StateFolder(spark, str(tmp_path / "states")), graph(spark, [], [])
    created = lambda: _run(spark, states, empty, str(tmp_path / "s"))
    assert created() == 1 and list(states) == ["sessions"] and created() == 0
    (tmp_path / "s" / "one.jsonl").write_text(line("x") + line("y") + line("z"))
    assert created() == 2 and created() == 0
    del states["sessions"]
    assert created() == 3 and isinstance(Archive().state(), type(None))


def _run(spark, states, g, path):
    registry = Registry(states)
    registry.register(Sessions())
    report = registry.run("sessions", g, path, dt.datetime(2024, 3, 31))[1]
    assert report["errors"] == []
    return report["created"]
