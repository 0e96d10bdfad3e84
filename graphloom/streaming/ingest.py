"""Incremental ingestion as streams: sessions that grow, conversations that change, exact-content deduplication, windowed metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.text import content_id
from ..operators.ingest import relevant_turns
from ..sources import readers
from ..sources.files import ARCHIVE, MESSAGE


def session_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of JSON line files as they are written, by the rule of the batch source; the checkpoint has how much of each file was read, so
    a line that is appended comes once, also after a restart.
    """
    readers.register(spark)
    raw = spark.readStream.format("session_lines").load(folder).select("path", "at", F.from_json("value", MESSAGE).alias("m")).select("path", "at", "m.*")
    return relevant_turns(raw, text="content")


class _Newest(StatefulProcessor):
    """Keeps each key's newest stamp and lets the newest row through, if it is newer than that."""

    def init(self, handle) -> None:
        self.newest = handle.getValueState("newest", "updated_at string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, before = None, self.newest.get()[0] if self.newest.exists() else None
        for some in rows:
            some = some.assign(_stamp=some["updated_at"].fillna("")).sort_values(["_stamp", "conversation"], kind="stable")
            if len(some) and (best is None or tuple(some.iloc[-1][["_stamp", "conversation"]]) > tuple(best.iloc[0][["_stamp", "conversation"]])):
                best = some.iloc[-1:]
        if best is not None and (before is None or best.iloc[0]["_stamp"] > before):
            self.newest.update((best.iloc[0]["_stamp"],))
            yield best[["uuid", "updated_at", "conversation"]]

    def close(self) -> None:
        pass


def changed_conversations(stream: DataFrame) -> DataFrame:
    """Of a stream of (uuid, updated_at, conversation) the rows that are newer than all before of their uuid, each micro-batch's newest.

    The stamps are keyed state in RocksDB, on the executors; stamps are compared as texts (ISO times). Rows that come late with an
    older stamp, or again with the same one, are dropped; one without a stamp is older than any. Rows without a uuid are left out.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    some = stream.where("uuid is not null").select("uuid", "updated_at", "conversation")
    return some.groupBy("uuid").transformWithStateInPandas(_Newest(), "uuid string, updated_at string, conversation string", "Append", "None")


def archive_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(uuid, updated_at, conversation) of archives that are put into a folder, one JSON array or one object a line to a file."""
    raw = spark.readStream.schema(ARCHIVE).option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder)
    return raw.select("uuid", "updated_at", F.to_json(F.struct("*")).alias("conversation"))


def ingest(stream: DataFrame, nodes_path: str, checkpoint: str, buckets: int = 256):
    """Appends contents that no node has, in folders by the first bits of their ids; a batch looks only into those that its own ids
    are in, and one that runs again adds nothing.
    """
    schema = "id string, content string, bucket int"

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select("content").distinct().withColumn("id", content_id("content")).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
        fresh = fresh.persist()
        try:
            touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
            known = spark.read.schema(schema).parquet(nodes_path).where(F.col("bucket").isin(touched)).select("id", "bucket")
            fresh.join(known, ["id", "bucket"], "left_anti").select("id", "content", "bucket").write.mode("append").partitionBy("bucket").parquet(nodes_path)
        finally:
            fresh.unpersist()

    spark = stream.sparkSession
    spark.createDataFrame([], schema).write.mode("append").partitionBy("bucket").parquet(nodes_path)  # the folder is there from now on
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_metrics(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by type and window of event time; rows later than `late` are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "metric_type").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms")).select("window.start", "metric_type", "n", "total_ms")
