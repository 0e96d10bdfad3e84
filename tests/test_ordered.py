"""Row numbers, running totals and exact quantiles against plain Python."""

import itertools
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import lineage, ordered, similarity
from graphloom.schema import Graph


@pytest.mark.parametrize("kind", ["even", "heavy", "ties", "one", "two", "wide"])
def test_quantiles_are_those_of_all_values(spark, kind):
    rng = np.random.default_rng(5)
    made = {"even": rng.random(3000), "heavy": rng.lognormal(0, 8, 3000), "ties": rng.integers(0, 3, 3000) / 7, "one": [0.25], "two": [-1.0, 3.0], "wide": [-1.7e308, 1.7e308, *rng.random(2000)]}[kind]
    rows = [(float(x),) for x in made] + [(None,), (float("nan"),)]
    at = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = ordered.exact_quantiles(spark.createDataFrame(rows, "x double").repartition(4), "x", at, ranges=16, few=5)
    assert got == pytest.approx([float(np.quantile(made, q)) for q in at], rel=1e-12)


def test_no_values_no_quantiles(spark):
    assert ordered.exact_quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5, 1.0]) == [None, None]


def test_numbers_and_totals_go_on_from_range_to_range(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 99), rng.choice([None, *range(5)])) for i in range(2000)]
    frame = spark.createDataFrame(rows, "id int, o int, v long").repartition(5)
    expected = sorted(rows, key=lambda r: (-r[1], r[0]))
    order = (F.desc("o"), "id")
    assert [(r["id"], r["k"]) for r in ordered.numbered(frame, *order).orderBy("k").collect()] == [(r[0], i + 1) for i, r in enumerate(expected)]
    totals = list(itertools.accumulate(r[2] or 0 for r in expected))
    got = {r["id"]: r["total"] for r in ordered.running_total(frame, "v", *order).collect()}
    assert got == {r[0]: t for r, t in zip(expected, totals, strict=True)}
    assert ordered.numbered(frame.limit(0), "id").count() == 0 and ordered.running_total(frame.limit(0), "v", "id").count() == 0


def test_calibration_takes_all_nodes(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((90, 6))
    emb = spark.createDataFrame([(f"n{i}", v.tolist()) for i, v in enumerate(vectors)] + [("odd", [0.0] * 6)], "node_id string, vector array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = unit @ unit.T
    row = similarity.calibration(emb, pairs=None).first()
    upper = sims[np.triu_indices(90, 1)]
    np.fill_diagonal(sims, -2)
    assert row["pairs"] == 90 * 89 // 2 and row["p95"] == pytest.approx(np.quantile(upper, 0.95), abs=6e-4) and row["nn_p50"] == pytest.approx(np.quantile(sims.max(1), 0.5), abs=6e-4)
    some = similarity.calibration(emb, pairs=3000).first()
    assert some["pairs"] == 3000 and some["nn_p50"] == row["nn_p50"] and some["p50"] == pytest.approx(row["p50"], abs=0.05)
    none = similarity.calibration(emb.where("node_id = 'odd'"), dim=6).first()
    assert none["pairs"] == 0 and none["p50"] is None and none["cross_link"] is None


def test_weak_chains_do_not_hang_on_the_order_of_sums(spark):
    """Many means of exactly the limit, and of a half at the seventh place, whose sums of doubles are often a little off; weights that are no decimals."""
    r = random.Random(5)
    weights = {"low": [0.49], "nan": [float("nan"), 0.1], "huge": [1e300, 1.0], "minus": [float("-inf")], "none": [None]}
    for i in range(40):
        some = [r.randrange(100) for _ in range(15)]
        weights[f"even{i}"] = [w / 100 for w in some] + [(100 - w) / 100 for w in some]
        low = [r.randrange(45) for _ in range(31)]
        weights[f"tie{i}"] = [w / 100 for w in [*low, 2 - sum(low) % 2 + 1]]
    edges = [(f"{n}-{i}", n, w) for n, ws in weights.items() for i, w in enumerate(ws)]
    r.shuffle(edges)
    g = Graph(None, spark.createDataFrame(edges, "parent_id string, child_id string, weight double"), None, None)
    ties = {n: sum(Decimal(str(w)) for w in ws) / 32 for n, ws in weights.items() if n.startswith("tie")}
    assert all((m * 10**6) % 1 == Decimal("0.5") for m in ties.values())
    got = {tuple(r) for r in lineage.weak_chains(g).collect()}
    assert got == {(n, float(round(m + Decimal("1e-9"), 6))) for n, m in ties.items()} | {("low", 0.49), ("minus", float("-inf"))}
