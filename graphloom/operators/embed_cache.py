"""A cache of vectors by text hash, kept in a folder by model and bucket of the hash.

A lookup reads one model's folders, and of them only the buckets that are asked for; a put appends; invalidating a model removes its folders
and touches no other file. Of rows with one hash, which two writers can make, one counts, and compact() rewrites just the buckets
that have such rows, by dynamic partition overwrite.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import cut, file_system
from .embed import Encoder, encoded

BUCKETS = 64
SCHEMA = "hash string, vector array<double>, model string, bucket int"


def text_hash(column: str = "content"):
    return F.sha2(F.coalesce(column, F.lit("")), 256)


def bucket_of(hash_: str = "hash", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(hash_), F.lit(buckets)).cast("int")


class EmbeddingCache:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _there(self) -> bool:
        made, store = file_system(self.spark, self.folder)
        return store.exists(made)

    def rows(self, model: str | None = None) -> DataFrame:
        """(hash, vector, model, bucket), also as often as it was put."""
        if not self._there():
            return self.spark.createDataFrame([], SCHEMA)
        every = self.spark.read.schema(SCHEMA).parquet(self.folder)
        return every if model is None else every.where(F.col("model") == model)

    def get(self, texts: DataFrame, model: str) -> DataFrame:
        """(hash, vector) of the hashes (hash) that are known."""
        asked = texts.select("hash").distinct().withColumn("bucket", bucket_of(buckets=self.buckets))
        touched = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most as many as there are buckets
        known = self.rows(model).where(F.col("bucket").isin(touched)) if touched else self.rows(model).limit(0)
        return known.join(asked, ["hash", "bucket"], "left_semi").groupBy("hash").agg(F.first("vector").alias("vector"))

    def put(self, rows: DataFrame, model: str) -> None:
        """Adds (hash, vector)."""
        some = rows.select("hash", "vector", F.lit(model).alias("model"), bucket_of(buckets=self.buckets).alias("bucket"))
        some.repartition("bucket").write.mode("append").partitionBy("model", "bucket").parquet(self.folder)

    def size(self) -> DataFrame:
        """(model, texts): how many different texts each model has."""
        return self.rows().select("model", "hash").distinct().groupBy("model").agg(F.count("*").alias("texts"))

    def invalidate(self, model: str) -> bool:
        """Removes a model's rows; whether there were any."""
        made, store = file_system(self.spark, f"{self.folder}/model={quote(model, safe='-_.~ ')}")
        return store.delete(made, True) if store.exists(made) else False

    def compact(self) -> int:
        """Rewrites the buckets in which a hash is more than once; how many those are."""
        twice = self.rows().groupBy("model", "bucket", "hash").agg(F.count("*").alias("n")).where("n > 1").select("model", "bucket").distinct()
        twice = cut(twice)
        n = twice.count()
        if n:
            kept = cut(self.rows().join(twice, ["model", "bucket"], "left_semi").dropDuplicates(["model", "bucket", "hash"]).select("hash", "vector", "model", "bucket"))
            kept.repartition("model", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "bucket").parquet(self.folder)
        return n

    def through(self, rows: DataFrame, encoder: Encoder, model: str) -> DataFrame:
        """(node_id, vector, model) of (id, content): only texts that are not known are encoded, each once, and are known from then on."""
        asked = cut(rows.select("id", "content", text_hash().alias("hash")))
        known = cut(self.get(asked, model))
        missing = asked.join(known.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])
        new = cut(encoded(missing.select(F.col("hash").alias("id"), "content"), encoder, model).select(F.col("node_id").alias("hash"), "vector"))
        if new.take(1):
            self.put(new, model)
        return asked.join(known.unionByName(new), "hash").select(F.col("id").alias("node_id"), "vector", F.lit(model).alias("model"))
