"""Embedding of texts by a pluggable encoder, with a cache keyed by model and text hash."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.vector import norm
from ..schema import Graph, live

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = 64) -> Encoder:
    """A deterministic encoder that needs no model: signed counts of words in `dim` places, of unit length; blank text is zero."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                out[i, int.from_bytes(h[:4], "little") % dim] += 1 if h[4] & 1 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0)

    return encode


def encoded(rows: DataFrame, encoder: Encoder, model: str) -> DataFrame:
    """(node_id, vector, model) for (id, content)."""

    def each(parts):
        for p in parts:
            vectors = encoder([c or "" for c in p["content"]])
            yield pd.DataFrame({"node_id": p["id"], "vector": [v.tolist() for v in vectors], "model": model})

    return rows.select("id", "content").mapInPandas(each, "node_id string, vector array<double>, model string")


def unembedded(graph: Graph) -> DataFrame:
    """Live nodes with text and without a vector."""
    return live(graph.nodes).where("content is not null and trim(content) <> ''").join(graph.emb.select(F.col("node_id").alias("id")), "id", "left_anti")


def embed_missing(graph: Graph, encoder: Encoder, model: str) -> Graph:
    return graph.with_(emb=graph.emb.select("node_id", "vector", "model").unionByName(encoded(unembedded(graph), encoder, model)))


def re_embedded(graph: Graph, encoder: Encoder, model: str) -> Graph:
    """All vectors anew, as after a change of model."""
    return graph.with_(emb=encoded(live(graph.nodes).where("trim(content) <> ''"), encoder, model))


def repaired(graph: Graph, encoder: Encoder, model: str) -> Graph:
    """Empty or zero vectors anew where the node is live; vectors without a node go."""
    good = graph.emb.where("vector is not null and size(vector) > 0").where(norm("vector") > 0).join(graph.nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return embed_missing(graph.with_(emb=good), encoder, model)


def cache_key(model: str) -> list:
    return [F.lit(model).alias("model"), F.sha2("content", 256).alias("hash")]


def through_cache(rows: DataFrame, cache: DataFrame, encoder: Encoder, model: str) -> tuple[DataFrame, DataFrame]:
    """(node_id, vector, model) of (id, content), and the rows (model, hash, vector) to add to the cache."""
    asked = rows.select("id", "content", *cache_key(model))
    missing = asked.join(cache.select("model", "hash"), ["model", "hash"], "left_anti").dropDuplicates(["hash"])
    new = encoded(missing.select(F.col("hash").alias("id"), "content"), encoder, model).select("model", F.col("node_id").alias("hash"), "vector")
    every = cache.select("model", "hash", "vector").unionByName(new)
    return asked.join(every, ["model", "hash"]).select(F.col("id").alias("node_id"), "vector", "model"), new
