"""Metrics: recording, clearing, export, a timing decorator, and the summaries that a dashboard shows."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.clock import age_days
from ..schema import Graph, live

SCHEMA = "metric_type string, ts timestamp, duration_ms double, metadata string"
#: The fields of a retrieval's metadata that are averaged, and the names of their means.
RETRIEVAL_FIELDS = {
    "embed_time_ms": "avg_embed_time", "search_time_ms": "avg_search_time", "bfs_time_ms": "avg_bfs_time", "seeds_found": "avg_seeds_found",
    "bfs_explored": "avg_bfs_explored", "results_returned": "avg_results_returned", "overlap_ratio": "avg_overlap_ratio",
}


def within(metrics: DataFrame, as_of, hours: int) -> DataFrame:
    return metrics.where(F.col("ts") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))


def record(spark: SparkSession, path: str, metric_type: str, duration_ms: float, as_of, **about) -> None:
    """Appends one row."""
    kind = F.lit(metric_type).alias("metric_type")
    extra = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(about.items())])) if about else F.lit("{}")
    spark.range(1).select(kind, F.lit(as_of).cast("timestamp").alias("ts"), F.lit(float(duration_ms)).alias("duration_ms"), extra.alias("metadata")).write.mode("append").parquet(path)


def recorded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def cleared(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(path)


def exported(metrics: DataFrame, folder: str) -> None:
    """All rows as JSON lines, oldest first within each file."""
    metrics.sortWithinPartitions("ts").write.mode("overwrite").json(folder)


def timed(put: Callable[[str, float], None], metric_type: str, enabled: bool = True):
    """A decorator that hands `put` the type and the milliseconds of each call, also of one that fails."""

    def around(f):
        @functools.wraps(f)
        def run(*args, **named):
            if not enabled:
                return f(*args, **named)
            began = time.perf_counter()
            try:
                return f(*args, **named)
            finally:
                put(metric_type, (time.perf_counter() - began) * 1000)

        return run

    return around


def by_type(metrics: DataFrame, as_of=None, hours: int | None = None) -> DataFrame:
    rows = metrics if hours is None else within(metrics, as_of, hours)
    r = lambda f: F.round(F.coalesce(f("duration_ms"), F.lit(0.0)), 2)
    return rows.groupBy("metric_type").agg(F.count("*").alias("n"), r(F.avg).alias("mean_ms"), r(F.min).alias("low_ms"), r(F.max).alias("high_ms"))


def summary(graph: Graph, as_of, hours: int = 24) -> DataFrame:
    """One row: queries, mean retrieval time and last hour's retrievals, and the state of the graph (nodes, edges, share with a vector)."""
    rows, kind = within(graph.metrics, as_of, hours), F.col("metric_type") == "retrieval"
    m = rows.agg(
        F.count("*").alias("total_queries"),
        F.coalesce(F.round(F.avg(F.when(kind, F.col("duration_ms"))), 2), F.lit(0.0)).alias("avg_retrieval_time"),
        F.coalesce(F.count_if(kind & (age_days("ts", as_of) <= 1 / 24)), F.lit(0)).alias("recent_queries_1h"),
    )
    n = live(graph.nodes).agg(F.count("*").alias("node_count"))
    e = graph.edges.agg(F.count("*").alias("edge_count"))
    v = graph.emb.agg(F.count("*").alias("vectors"))
    ratio = F.round(F.col("vectors") / F.greatest(F.lit(1), "node_count"), 2)
    return m.join(n).join(e).join(v).withColumn("vec_sync_ratio", ratio).drop("vectors")  # four single rows


def series(metrics: DataFrame, kind: str, as_of, hours: int = 24) -> DataFrame:
    """(ts, duration_ms, metadata) of a type, to be shown oldest first."""
    return within(metrics, as_of, hours).where(F.col("metric_type") == kind).select("ts", "duration_ms", "metadata")


def hourly(metrics: DataFrame, kind: str, hours: int = 1) -> DataFrame:
    start = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / (3600 * hours)) * (3600 * hours))
    return metrics.where(F.col("metric_type") == kind).groupBy(start.alias("start")).agg(F.count("*").alias("n"), F.round(F.sum("duration_ms"), 4).alias("total_ms"))


def daily_history(metrics: DataFrame) -> DataFrame:
    """(ts and the four series of TRENDS) of each day: means over retrievals, and failed searches as what is not linked."""
    kind = F.col("metric_type") == "retrieval"
    mean = lambda f: F.round(F.avg(F.when(kind, f)), 6)
    return metrics.groupBy(F.date_trunc("day", "ts").alias("ts")).agg(
        mean(_number("results_returned")).alias("avg_nodes"), mean(_number("input_tokens")).alias("avg_tokens"), mean(F.col("duration_ms")).alias("avg_latency_ms"),
        F.count_if(F.col("metric_type") == "search").cast("double").alias("orphan_count"),
    )


def _number(field: str) -> F.Column:
    return F.get_json_object("metadata", f"$.{field}").cast("double")


def retrieval_breakdown(metrics: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """One row: each field's mean over the rows that have it, and the mean of what the walk added to the seeds, over rows with both."""
    rows = within(metrics, as_of, hours).where(F.col("metric_type") == "retrieval")
    means = [F.round(F.coalesce(F.avg(_number(f)), F.lit(0.0)), 2).alias(n) for f, n in RETRIEVAL_FIELDS.items()]
    e, s = _number("bfs_explored"), _number("seeds_found")
    bonus = F.avg(F.when((e != 0) & (s != 0), F.greatest(F.lit(0.0), e - s)))
    return rows.agg(*means, F.round(F.coalesce(bonus, F.lit(0.0)), 2).alias("bfs_bonus"))


def token_usage(metrics: DataFrame, fields: tuple[str, ...] = ("input_tokens", "output_tokens")) -> DataFrame:
    """(metric_type, calls and the sum of each field) of the rows that count tokens."""
    rows = metrics.where(F.col("metric_type").startswith("token_usage:"))
    return rows.groupBy("metric_type").agg(F.count("*").alias("calls"), *[F.coalesce(F.sum(F.get_json_object("metadata", f"$.{f}").cast("long")), F.lit(0)).alias(f) for f in fields])


def run_rollup(runs: DataFrame) -> DataFrame:
    """One row of query runs (success, nodes, tokens, latency_ms): how many succeeded, and their means and longest time."""
    good = F.col("success")
    mean = lambda c: F.coalesce(F.round(F.avg(F.when(good, F.col(c))), 6), F.lit(0.0))
    return runs.agg(
        F.count("*").alias("runs"), F.coalesce(F.count_if(good), F.lit(0)).alias("succeeded"), mean("nodes").alias("avg_nodes"), mean("tokens").alias("avg_tokens"),
        mean("latency_ms").alias("avg_latency_ms"), F.coalesce(F.max(F.when(good, F.col("latency_ms"))), F.lit(0.0)).alias("max_latency_ms"),
    )


#: Series of the history, the change that is an anomaly (either way), and the one that is a concern.
TRENDS = {"avg_nodes": (0.3, -0.15), "avg_tokens": (None, None), "avg_latency_ms": (0.5, 0.3), "orphan_count": (0.3, 0.2)}


def trends(history: DataFrame, as_of, days: int = 7) -> DataFrame:
    """(series, points, first, last, change_pct, anomaly, concern) of a history (ts and the four series); no rows with fewer than two points."""
    rows = history.where(F.col("ts") > as_of - F.expr(f"INTERVAL {days} DAYS"))
    named = F.explode(F.array(*[F.struct(F.lit(s).alias("series"), F.col(s).cast("double").alias("value")) for s in TRENDS]))
    each = rows.select("ts", named.alias("x")).select("ts", "x.*")
    out = each.groupBy("series").agg(F.count("*").alias("points"), F.min_by("value", "ts").alias("first"), F.max_by("value", "ts").alias("last")).where("points >= 2")
    change = F.when(F.col("first") != 0, (F.col("last") - F.col("first")) / F.col("first")).otherwise(0.0)
    anomaly, concern = F.lit(False), F.lit(False)
    for s, (odd, bad) in TRENDS.items():
        if odd is not None:
            anomaly = F.when(F.col("series") == s, F.abs(change) > odd).otherwise(anomaly)
            concern = F.when(F.col("series") == s, change < bad if bad < 0 else change > bad).otherwise(concern)
    return out.select("series", "points", "first", "last", F.round(change * 100, 1).alias("change_pct"), anomaly.alias("anomaly"), concern.alias("concern"))
