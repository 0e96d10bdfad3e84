"""Sorted projection passes against all pairs."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import vectorpasses


def plain(rows, limit):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    sound = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    group = defaultdict(list)
    for i, (_, v, label) in enumerate(rows):
        if label is not None and sound(v):
            group[label, len(v)].append(i)
    near = defaultdict(set)
    for own in group.values():
        m = np.array([rows[i][1] for i in own], np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(m @ m.T >= limit), strict=True):
            if a != b:
                near[own[a]].add(own[b])
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((vec_id, len(near[i]), component, vec_id == component))
    return sorted(out, key=repr)


def planted(n, dim, seed, groups):
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for size, spread in groups:
        base = rng.standard_normal(dim)
        rows += [base + spread * rng.standard_normal(dim) for _ in range(size)]
    rows += list(rng.standard_normal((n, dim)))
    labels = rng.integers(0, 3, len(rows))
    return [(i, r.astype(np.float32).tolist(), int(x)) for i, (r, x) in enumerate(zip(rows, labels, strict=True))]


ODD = [
    (1, None, 1), (2, [], 1), (3, [0.0] * 4, 1), (4, [1.0, None, 0.0, 0.0], 1), (5, [1.0, math.nan, 0.0, 0.0], 1), (6, [math.inf, 0.0, 0.0, 0.0], 1),
    (7, [1.0, 0.0, 0.0, 0.0], None), (8, [1.0, 0.0, 0.0, 0.0], 1), (8, [1.0, 0.0, 0.0, 0.0], 1), (9, [2.0, 0.0, 0.0, 0.0], 1), (10, [1.0, 0.0, 0.0, 0.0], 2),
    (None, [1.0, 0.1, 0.0, 0.0], 1), (None, [0.0, 0.0, 3.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [-1.0, 0.0, 0.0, 0.0], 1), (13, [1e30, 1e29, 0.0, 0.0], 1), (14, [0.0, 1e-30, 0.0, 0.0], 1), (15, [-0.0, 1e-30, 0.0, 0.0], 1),
]


def got(spark, rows, **how):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("mine") for c in ("c", "pass", "n", "dim", "h1", "v", "root")})
    out = vectorpasses.near_duplicates(frame, **how)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_odd_rows_and_small_groups_are_those_of_all_pairs(spark):
    assert got(spark, ODD) == plain(ODD, vectorpasses.LIMIT)
    rows = planted(150, 16, 3, [(40, 0.1), (20, 0.2), (5, 0.05)])
    assert got(spark, rows) == plain(rows, vectorpasses.LIMIT)
    assert got(spark, []) == []


def test_windows_of_a_few_rows_count_each_link_once_and_find_nine_of_ten(spark):
    """A dense group of many windows is compared whole; no link is false or counted twice."""
    rows = planted(400, 24, 4, [(150, 0.02), (30, 0.1), (30, 0.2), *[(2, 0.15)] * 60])
    rows = [(i, v, 0) for i, v, _ in rows] + [(10_000 + i, rows[3][1], 0) for i in range(40)]
    random.Random(1).shuffle(rows)
    exact = {r[0]: r for r in plain(rows, vectorpasses.LIMIT)}
    found = got(spark, rows, window=16)
    assert len(found) == len(rows)
    assert all(r[1] <= exact[r[0]][1] and r[2] >= exact[r[0]][2] for r in found)
    assert sum(r[1] for r in found) >= 0.95 * sum(r[1] for r in exact.values())
    assert sum(r[2] == exact[r[0]][2] for r in found) >= 0.97 * len(rows)


def test_keys_agree_as_often_as_planned():
    p = vectorpasses.chance(0.93, 64)
    assert 0.6 < p < 0.72
    passes, hashes = vectorpasses.plan(2048 * 32**2, 0.93, 64)
    assert hashes == 2 and 1 - (1 - p**2) ** passes >= vectorpasses.RECALL
