"""Banding against all pairs, counts inside jobs, the cache by model and bucket, the model path of migration."""

import datetime as dt
import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import Observation, functions as F

from graphloom.operators import lsh, metrics, observed
from graphloom.operators.embed_cache import EmbeddingCache
from graphloom.plans import session
from tests.test_operators import graph, ids

NOW = dt.datetime(2024, 3, 31)


def planted(seed, dim=48, groups=150):
    """Groups of three: pairs of all cosines from about 0.6 to 0.99, and unrelated vectors."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        base = rng.standard_normal(dim)
        rows += [base, base + rng.uniform(0.1, 0.9) * rng.standard_normal(dim), base + rng.uniform(0.1, 0.9) * rng.standard_normal(dim)]
    return np.array(rows + list(rng.standard_normal((900, dim))))


@pytest.mark.parametrize("least", [0.7, 0.82, 0.9])
def test_bands_find_nine_of_ten_pairs_and_no_other(spark, least):
    m = planted(3)
    emb = spark.createDataFrame([(f"n{i:04}", v.tolist()) for i, v in enumerate(m)] + [("odd", None), ("zero", [0.0] * 48)], "node_id string, vector array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    true = {(f"n{i:04}", f"n{j:04}") for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= least, 1)), strict=True)}
    got = [tuple(r) for r in lsh.lsh_pairs(emb, least, block=40).select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) <= true
    print("recall", least, len(got) / len(true), lsh.plan(len(m), least))
    assert len(got) >= 0.9 * len(true)


def test_a_hot_bucket_is_compared_in_blocks(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    rows = [(f"n{i}", (base + 0.001 * rng.standard_normal(16)).tolist()) for i in range(60)]
    got = lsh.lsh_pairs(spark.createDataFrame(rows, "node_id string, vector array<double>"), 0.9, block=7)
    assert got.count() == 60 * 59 // 2 and lsh.lsh_pairs(spark.createDataFrame([], "node_id string, vector array<double>"), 0.9, dim=16).count() == 0


def test_plans_keep_their_recall():
    for n in (10, 10**5, 10**9):
        for least in (0.3, 0.7, 0.9, 0.99):
            bands, bits = lsh.plan(n, least)
            agree = 1 - np.arccos(least) / np.pi
            assert 1 - (1 - agree**bits) ** bands >= 0.95 - 1e-9 and bands <= lsh.MOST_BANDS


def test_counts_come_out_of_the_job_that_writes(spark):
    rows, seen = observed.counted_cut(spark.range(1000).repartition(7), n=F.count(F.lit(1)), odd=F.count_if(F.col("id") % 2 == 1))
    assert seen == {"n": 1000, "odd": 500} and rows.count() == 1000
    assert observed.counted_cut(spark.range(5).where("id > 9"))[1] == {"n": 0}


def test_cache_by_model_and_bucket(spark, tmp_path):
    calls = str(tmp_path / "calls")
    os.mkdir(calls)

    def encoder(texts):
        for t in texts:
            with open(os.path.join(calls, f"{os.getpid()}-{len(os.listdir(calls))}-{abs(hash(t or ''))}"), "w") as f:
                f.write(t or "")
        return np.array([[float(len(t or "")), 1.0] for t in texts])

    cache = EmbeddingCache(spark, str(tmp_path / "cache"), 8)
    rows = spark.createDataFrame([("a", "one"), ("b", "three"), ("c", "one"), ("d", None)], "id string, content string")
    assert ids(cache.through(rows, encoder, "m/1"), "node_id", "vector") == [("a", [3.0, 1.0]), ("b", [5.0, 1.0]), ("c", [3.0, 1.0]), ("d", [0.0, 1.0])]
    first = len(os.listdir(calls))
    assert ids(cache.through(rows.where("id <> 'd'"), encoder, "m/1"), "node_id") == ["a", "b", "c"] and len(os.listdir(calls)) == first
    cache.through(rows.where("id = 'a'"), encoder, "m2")
    known = {r["model"]: r["texts"] for r in cache.size().collect()}
    assert known["m2"] == 1 and known["m/1"] >= 2
    files = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{cache.folder}/model=m2/**/*.parquet", recursive=True)}
    assert cache.invalidate("m/1") and not cache.invalidate("m/1") and {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{cache.folder}/**/*.parquet", recursive=True)} == files
    cache.put(cache.rows("m2").select("hash", "vector"), "m2")
    assert cache.rows("m2").count() == 2 and cache.compact() == 1 and cache.rows("m2").count() == 1 and cache.compact() == 0
    assert EmbeddingCache(spark, str(tmp_path / "none")).size().count() == 0


def test_model_use_is_counted_where_the_rows_are(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i}", "d", None, "text " * i) for i in range(20)], "source_file string, domain string, referent_time string, text string")
    usage = Observation()
    told = session.told_by_model(rows, lambda p: "[fact] a statement that is long enough\n", ("fact",), usage=usage)
    assert told.count() == 20
    got = usage.get
    assert got["calls"] == 20 and got["output_tokens"] == 20 * (len("[fact] a statement that is long enough\n") // 4) and got["input_tokens"] > 20 * 15
    session.usage_row(spark, str(tmp_path / "m"), "extract", 12.5, NOW, got)
    row = metrics.recorded(spark, str(tmp_path / "m")).first()
    assert row["metric_type"] == "token_usage:extract" and json.loads(row["metadata"])["calls"] == 20


def test_migration_by_a_model_has_a_novelty_gate(spark):
    g = graph(spark, [{"id": "a", "content": "known"}], [], [("a", [1.0, 0.0])])
    g = g.with_(nodes=g.nodes.withColumn("source_file", F.lit("x")))
    files = spark.createDataFrame([("one.md", "x" * 120), ("short.md", "x")], "path string, text string")
    encoder = lambda texts: np.array([[1.0, 0.01] if "near" in t else [0.0, 1.0] for t in texts])
    answer = "[fact] a statement that is near to the known one\n[insight] a statement about other things"
    after, report = session.migrated_by_model(g, files, lambda _: answer, NOW, encoder=encoder)
    assert report["nodes"] == 1 and report["known"] == 1 and report["calls"] == 1
    assert ids(after.nodes.where("source_file = 'migration:one.md'"), "content", "node_type") == [("a statement about other things", "insight")] and after.emb.count() == 2
    assert session.migrated_by_model(after, files, lambda _: answer, NOW, encoder=encoder)[1]["calls"] == 0
