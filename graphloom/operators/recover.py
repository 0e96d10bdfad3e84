"""Event times found again: from metadata, or from a date in the source's name. Only rows without a time get one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import recovered_time


def recovered(nodes: DataFrame) -> DataFrame:
    """(id, time, origin) of every node without an event time; `none` where nothing can be found."""
    time, origin = recovered_time(F.col("metadata"), F.col("source_file"))
    return nodes.where("referent_ts is null").select("id", time.alias("time"), origin.alias("origin"))


def recoverability(nodes: DataFrame) -> DataFrame:
    return recovered(nodes).groupBy("origin").agg(F.count("*").alias("n"))


def backfilled(nodes: DataFrame) -> DataFrame:
    """The nodes with the times that can be found."""
    time, _ = recovered_time(F.col("metadata"), F.col("source_file"))
    return nodes.withColumn("referent_ts", F.coalesce("referent_ts", time))
