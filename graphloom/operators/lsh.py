"""Cosine pairs by random hyperplanes: a prefilter for the all-pairs joins of similarity.py, which stay the exact way.

A vector's bits say on which side of random hyperplanes it lies; `bits` of them make a band's key, and two vectors that share a band's
key are compared by their exact cosine. `plan` takes the fewest bands that find a pair of just the least cosine with a chance of `recall`, with as
many bits as leave a bucket of unrelated vectors about BUCKET large; closer pairs are found more surely. No pair under the
least cosine comes out.

Buckets over BLOCK vectors are taken apart into blocks that meet two by two, so none is dropped and no task holds a whole one. A
vector carries its keys of all bands, so a pair that an earlier band has found is seen where it is met again and comes out once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.vector import sound, usual_dim
from ..shared import cut
from .similarity import PAIRS

RECALL, BUCKET, BLOCK, MOST_BITS, MOST_BANDS = 0.95, 256, 2048, 30, 64


def plan(n: int, least: float, recall: float = RECALL) -> tuple[int, int]:
    """(bands, bits): bits halve a bucket each; a pair of this cosine agrees in a bit with chance 1 - angle / pi."""
    agree = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    for bits in range(max(1, min(MOST_BITS, math.ceil(math.log2(max(2, n / BUCKET))))), 0, -1):
        missed = 1 - agree**bits
        bands = 1 if missed <= 0 else math.ceil(math.log(1 - recall) / math.log(missed))
        if bands <= MOST_BANDS:
            return bands, bits
    return 1, 0  # no bands find enough: one bucket of all


def _keyed(rows: DataFrame, dim: int, bands: int, bits: int, seed: int) -> DataFrame:
    def each(batches):
        planes = np.random.default_rng([seed, dim]).standard_normal((dim, bands * max(bits, 1)))
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            m = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            keys = ((m @ planes > 0).reshape(len(m), bands, -1)[:, :, :bits] * powers).sum(2) if bits else np.zeros((len(m), bands), np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("node_id"), batch.column("vector"), flat], names=["node_id", "vector", "keys"])

    return rows.select("node_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(each, "node_id string, vector array<double>, keys array<long>")


def _verified(least: float, below: float, dim: int):
    def each(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        band, i, j = key[0].as_py(), key[2].as_py(), key[3].as_py()
        table = table.sort_by("node_id").combine_chunks()
        m = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        sims = m @ m.T
        keep = np.triu((sims >= least) & (sims < below), 1)
        block = table.column("b").to_numpy()
        if i != j:
            keep &= block[:, None] != block[None, :]
        x, y = np.nonzero(keep)
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(m), -1)[:, :band]
        new = ~(keys[x] == keys[y]).any(1)
        ids = table.column("node_id").combine_chunks()
        return pa.table({"a": ids.take(pa.array(x[new])), "b": ids.take(pa.array(y[new])), "sim": pa.array(sims[x[new], y[new]])})

    return each


def lsh_pairs(emb: DataFrame, least: float, below: float = 2.0, dim: int | None = None, recall: float = RECALL, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(a, b, sim) for a < b with least <= cosine < below, all but about 1 - recall of them. Each id is one vector; of odd vectors none."""
    dim = usual_dim(emb) if dim is None else dim
    rows = cut(sound(emb, dim).select("node_id", "vector"))
    bands, bits = plan(rows.count(), least, recall)
    keyed = cut(_keyed(rows, dim, bands, bits, seed))
    long = keyed.select("node_id", "vector", "keys", F.posexplode("keys").alias("band", "key"))
    sizes = cut(keyed.select(F.posexplode("keys").alias("band", "key")).groupBy("band", "key").agg(F.ceil(F.count("*") / block).cast("int").alias("n")).where("n > 1"))
    long = long.join(sizes, ["band", "key"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    long = long.withColumn("b", F.pmod(F.xxhash64("node_id"), F.col("n")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = long.select("band", "key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "node_id", "vector", "keys")
    return dealt.groupBy("band", "key", "i", "j").applyInArrow(_verified(least, below, dim), PAIRS)
