"""Word sets that are alike, found by prefixes and signatures, against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import similarity


def texts(seed=3):
    """Sets of few and many words of a small and a large vocabulary, each with some near copies, one that is there twice, one without words."""
    r = random.Random(seed)
    out = [("none", ""), ("twice", "w1 w2 w3"), ("twice again", "w3 w2 w1 w1")]
    for i, size in enumerate([1, 2, 3, 5, 8, 20, 40, 80, 150, 300, 900, 2500]):
        base = r.sample([f"w{k}" for k in range(60 + 2 * size)], size)
        for j, changed in enumerate([0, 0.02, 0.05, 0.1, 0.2, 0.4]):
            words = [f"x{i}{j}{k}" if r.random() < changed else w for k, w in enumerate(base)]
            out.append((f"d{i:02}{j}", " ".join(r.sample(words, len(words)))))
    return out


@pytest.mark.parametrize("least", [0.3, 0.82, 1.0])
@pytest.mark.parametrize("few", [0, 10**6])
def test_pairs_are_those_of_all_pairs(spark, monkeypatch, least, few):
    monkeypatch.setattr(similarity, "LOOKED_UP", few)
    monkeypatch.setattr(similarity, "FREQUENT", 50 if few else 0)
    sets = {i: frozenset(t.split()) for i, t in texts() if t}
    names = {}
    for i in sorted(sets):
        names.setdefault(sets[i], i)
    reps = sorted(names.values())
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in reps for b in reps if a < b}
    want = {k: v for k, v in alike.items() if v >= least}
    docs = spark.createDataFrame(texts(), "id string, content string")
    assert {(r["a"], r["b"]): r["sim"] for r in similarity.jaccard_pairs(docs, least).collect()} == pytest.approx(want)


def test_signatures_differ_in_no_more_bits_than_words(spark):
    """And sets that have little in common are told apart by them, so that no pair of these is moved."""
    r = random.Random(1)
    sets = [sorted({r.randrange(-(2**63), 2**63) for _ in range(320)}) for _ in range(6)]
    sets += [sorted({*s[:300], *(r.randrange(2**63) for _ in range(15))}) for s in sets]
    rows = spark.createDataFrame(list(enumerate(sets)), "id long, words array<long>").where(F.size("words") > 0)
    none = spark.sparkContext.broadcast((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    found = {x["id"]: x for x in rows.mapInArrow(similarity._signed(0.82, none), "id long, n int, prefix array<long>, short array<long>, long array<long>").collect()}
    for a in range(12):
        for b in range(a):
            words = len(set(sets[a]) ^ set(sets[b]))
            most = (len(sets[a]) + len(sets[b])) * 0.18 / 1.82
            for kind in ("short", "long"):
                bits = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(found[a][kind], found[b][kind], strict=True))
                assert bits <= words and (a == b + 6 or bits > most)
    assert all(len(found[i]["prefix"]) == len(s) - int(np.ceil(len(s) * 0.82)) + 1 and set(found[i]["prefix"]) <= set(s) for i, s in enumerate(sets))
