"""Importance resampling against plain Python, with ranges and runs of a few rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm import resampling

SOME = "alpha Beta gamma delta 7 été NAÏVE x-ray don't 漢字 zz".split()


def plain(docs, target, longest, buckets, least, percent):
    def features(text):
        w = [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(f for _, x in docs for f in features(x)[1]), Counter(f for x in target for f in features(x)[1])
    a, b = sum(s.values()), sum(t.values())
    gain = {f: math.floor(1000 * math.log((t[f] + 1) * (a + buckets) / ((s[f] + 1) * (b + buckets)))) for f in s}
    out = []
    for doc_id, text in docs:
        n, own = features(text)
        weight = sum(gain[f] for f in own)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n >= least])
    may = sorted((r for r in out if r[5]), key=lambda r: (-r[3], 2**63 if r[0] is None else r[0]))
    for i, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize(("longest", "rows", "percent"), [(1, 7, 10), (1, 1 << 18, 10), (3, 7, 60), (2, 50, 100)])
def test_draw_is_that_of_plain_python(spark, longest, rows, percent):
    rng = random.Random(longest)
    docs = [(i, " ".join(rng.choices(SOME, k=rng.randint(0, 30)))) for i in range(200)]
    docs += [(7, None), (None, "alpha " * 25), (None, "alpha " * 25), (3, "word " * 30_000), (400, ""), *[(500, "the same text " * 9)] * 60]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns({c: F.lit("mine") for c in ("score", "rank", "at", "neg", "weight")})
    target = ["alpha beta 7", None, "", "漢字 and words nobody has"]
    got = resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), longest, 1000, 20, percent, rows=rows)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, target, longest, 1000, 20, percent)


def test_other_columns_and_texts_pass_and_empty_tables_give_nothing(spark):
    docs = spark.createDataFrame([(1, "a " * 40, "x", 5), (2, "b " * 40, "y", 6)], "doc_id long, text string, score string, at int")
    bench = docs.select("text")
    got = resampling.resample(docs, bench, percent=50, columns=["text", "score", "at"])
    assert got.columns == ["doc_id", "text", "score", "at", "n_features", "weight", "score_", "rank"]
    assert {(r["doc_id"], r["score"], r["at"]) for r in got.collect()} == {(1, "x", 5), (2, "y", 6)} and got.where("rank = 1").count() == 1
    assert resampling.resample(docs.limit(0), bench).count() == 0
    assert [r["rank"] for r in resampling.resample(docs, bench.limit(0), percent=100).orderBy("rank").collect()] == [1, 2]


def test_tournament_merges_any_runs():
    rng = random.Random(5)
    for k in (0, 1, 2, 3, 8, 13):
        runs = [sorted(rng.choices(range(50), k=rng.randint(0, 20))) for _ in range(k)]
        assert list(resampling.Tournament(runs)) == sorted(x for r in runs for x in r)
