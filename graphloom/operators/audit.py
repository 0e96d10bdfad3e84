"""The log of what decayed and why: rows, retention, what was last, and the rollup with its anomaly flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import summary
from ..schema import Graph

#: The reasons that a row may have.
REASONS = ("direct", "cascade", "gc_fitness", "dedup_merge")


def rows(graph: Graph, log: DataFrame, as_of) -> DataFrame:
    """The log's rows for (id, reason); another reason is an error."""
    known = F.when(F.col("reason").isin(*REASONS), F.col("reason")).otherwise(F.raise_error(F.concat(F.lit("not a reason: "), F.coalesce("reason", F.lit("null")))))
    n = graph.nodes.join(log.select("id", "reason"), "id")
    return n.select(
        F.col("id").alias("node_id"), summary("content").alias("content_summary"), known.alias("decay_reason"), F.col("access_count").alias("access_count_at_decay"),
        "source_file", "domain", "node_type", F.lit(as_of).cast("timestamp").alias("decay_timestamp"), "metadata",
    )


def kept(audit: DataFrame, as_of, days: int = 7) -> DataFrame:
    """The rows that retention leaves."""
    return audit.where(F.col("decay_timestamp") >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def recent(audit: DataFrame, k: int = 20) -> DataFrame:
    return audit.orderBy(F.desc("decay_timestamp"), "node_id").limit(k)


def rollup(audit: DataFrame, as_of, days: int = 7) -> DataFrame:
    """(measure, key, n) of the last days: rows by reason, by type and by source (the five most frequent), the total, today's, the daily mean
    and whether today has over twice that (with five rows or more). One pass counts; what is left are sums by key.
    """
    some = kept(audit, as_of, days).withColumn("today", F.to_date("decay_timestamp") == F.to_date(as_of))
    each = some.select("today", F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.coalesce(c, F.lit("(none)")).alias("key")) for m, c in (("reason", F.col("decay_reason")), ("node_type", F.col("node_type")), ("source_file", F.col("source_file")))
    ])).alias("x")).select("today", "x.*")
    counts = each.groupBy("measure", "key").agg(F.count("*").cast("double").alias("n"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("measure").orderBy(F.desc("n"), "key"))
    tops = counts.withColumn("place", place).where("place <= 5 or measure = 'reason'").select("measure", "key", "n")
    one = some.agg(F.count("*").cast("double").alias("total"), F.coalesce(F.count_if("today"), F.lit(0)).cast("double").alias("today"))
    mean = F.col("total") / days
    odd = ((F.col("today") > 2 * mean) & (F.col("total") >= 5)).cast("double")
    totals = one.select(F.explode(F.array(*[F.struct(F.lit("total").alias("measure"), F.lit(k).alias("key"), v.alias("n")) for k, v in (("events", F.col("total")), ("today", F.col("today")), ("daily_mean", F.round(mean, 2)), ("anomaly", odd))])).alias("x")).select("x.*")
    return tops.unionByName(totals)
