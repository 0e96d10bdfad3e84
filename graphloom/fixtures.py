"""The test tables as a graph, in Spark and as SQL; both give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .schema import Graph

AS_OF_TEXT = "2024-03-31 00:00:00"
TYPES = ("fact", "observation", "insight", "decision", "commitment", "belief")
REASONS = ("extracted_from - session similarity", "cross_link - similarity=0.900", "contradicts - earlier statement", "derived_from - synthesis", "summarizes - parent")
EVENTS = {"view": "retrieval", "click": "search", "purchase": "extraction", "signup": "embed", "error": "token_usage:think"}


def as_of() -> F.Column:
    return F.lit(AS_OF_TEXT).cast("timestamp")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return d.select(
        F.expr("concat('d', doc_id)").alias("id"),
        F.col("text").alias("content"),
        F.expr(f"CASE WHEN doc_id % 97 = 0 THEN 'core_memory' ELSE element_at(array{TYPES}, cast(doc_id % 6 AS INT) + 1) END").alias("node_type"),
        F.expr("CASE WHEN doc_id % 11 <> 0 THEN lang END").alias("domain"),
        F.expr(f"timestamp'{AS_OF_TEXT}' - make_dt_interval(cast(doc_id % 90 AS INT))").alias("ts"),
        F.expr(f"CASE WHEN doc_id % 3 = 0 THEN timestamp'{AS_OF_TEXT}' - make_dt_interval(cast(doc_id % 700 AS INT)) END").alias("referent_ts"),
        F.expr("cast((doc_id * 7) % 13 AS INT)").alias("access_count"),
        F.expr(f"CASE WHEN doc_id % 4 <> 0 THEN timestamp'{AS_OF_TEXT}' - make_dt_interval(cast(doc_id % 60 AS INT)) END").alias("last_accessed"),
        F.expr("CASE doc_id % 10 WHEN 0 THEN 'system_generated' WHEN 1 THEN concat('think_cycle:', source) ELSE concat('extractor:', source) END").alias("source_file"),
        F.expr("CASE WHEN toxic = 1 THEN 1 WHEN doc_id % 5 = 0 THEN NULL ELSE 0 END").alias("decayed"),
        F.expr("CASE WHEN doc_id % 89 = 0 THEN 2 WHEN (doc_id * 7) % 13 >= 12 AND quality = 1 THEN 1 ELSE 0 END").alias("permanent"),
        F.expr("CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN concat(source, ',', lang, ',vault:private') ELSE concat(source, ',', lang) END").alias("tags"),
        F.expr("""concat('{"domain":"', lang, '","n":', n_chars, '}')""").alias("metadata"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("c"))
    pairs = d.where("c >= 1 AND c % 19 <> 0").selectExpr("c DIV 3 AS p", "c").union(d.where("c >= 1 AND c % 4 = 0").selectExpr("c DIV 2 AS p", "c")).distinct()
    pairs = pairs.where("p <> c AND p % 23 <> 0 AND c % 23 <> 0")
    return pairs.selectExpr("concat('d', p) AS parent_id", "concat('d', c) AS child_id", "cast(((p * 31 + c * 17) % 100) / 100.0 AS DOUBLE) AS weight", f"element_at(array{REASONS}, cast(c % 5 AS INT) + 1) AS reasoning")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").selectExpr("concat('d', vec_id) AS node_id", "cast(embedding AS ARRAY<DOUBLE>) AS vector", "'test-64' AS model")


#: fields of a metric's metadata, from the number k of its event; a null field is not there
FIELDS = {
    "k": "k", "embed_time_ms": "CASE WHEN k % 2 = 0 THEN k + 0.5 END", "search_time_ms": "k % 17 + 0.25", "bfs_time_ms": "CASE WHEN k % 5 <> 0 THEN k % 9 + 0.75 END", "seeds_found": "k % 6",
    "bfs_explored": "CASE WHEN k % 7 <> 0 THEN k % 20 END", "results_returned": "k % 10", "overlap_ratio": "CASE WHEN k % 3 = 0 THEN (k % 10) * 0.125 END", "input_tokens": "k * 3", "output_tokens": "k + 5",
}
METRICS_AS_OF_TEXT = "2024-01-30 12:00:00"


def metrics_as_of() -> F.Column:
    return F.lit(METRICS_AS_OF_TEXT).cast("timestamp")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in EVENTS.items() for x in pair])
    rows = _table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    about = F.to_json(F.struct(*[F.expr(e).alias(n) for n, e in FIELDS.items()]))
    return rows.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), kind[F.col("event_type")].alias("metric_type"), F.col("value").alias("duration_ms"), about.alias("metadata"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of the decayed nodes, a reason and a time by their number."""
    from .operators.audit import REASONS

    n = nodes(spark, sf_dir).where("decayed = 1").withColumn("n", F.expr("cast(substr(id, 2) AS INT)"))
    return n.select(F.col("id").alias("node_id"), F.expr(f"element_at(array{REASONS}, n % 4 + 1)").alias("decay_reason"), "node_type", F.expr("CASE WHEN n % 5 <> 0 THEN source_file END").alias("source_file"), F.expr(f"timestamp'{AS_OF_TEXT}' - make_dt_interval(n % 9, n % 24)").alias("decay_timestamp"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir), embeddings(spark, sf_dir), metrics(spark, sf_dir))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of vec_id 0: one row."""
    row = _table(spark, sf_dir, "embeddings").where("vec_id = 0").first()
    return [float(x) for x in row["embedding"]]


SQL = f"""nodes AS (SELECT 'd' || doc_id AS id, text AS content,
  CASE WHEN doc_id % 97 = 0 THEN 'core_memory' ELSE {list(TYPES)}[CAST(doc_id % 6 AS INT) + 1] END AS node_type,
  CASE WHEN doc_id % 11 <> 0 THEN lang END AS domain,
  TIMESTAMP '{AS_OF_TEXT}' - to_days(CAST(doc_id % 90 AS INT)) AS ts,
  CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '{AS_OF_TEXT}' - to_days(CAST(doc_id % 700 AS INT)) END AS referent_ts,
  CAST((doc_id * 7) % 13 AS INT) AS access_count,
  CASE WHEN doc_id % 4 <> 0 THEN TIMESTAMP '{AS_OF_TEXT}' - to_days(CAST(doc_id % 60 AS INT)) END AS last_accessed,
  CASE doc_id % 10 WHEN 0 THEN 'system_generated' WHEN 1 THEN 'think_cycle:' || source ELSE 'extractor:' || source END AS source_file,
  CASE WHEN toxic = 1 THEN 1 WHEN doc_id % 5 = 0 THEN NULL ELSE 0 END AS decayed,
  CASE WHEN doc_id % 89 = 0 THEN 2 WHEN (doc_id * 7) % 13 >= 12 AND quality = 1 THEN 1 ELSE 0 END AS permanent,
  CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN source || ',' || lang || ',vault:private' ELSE source || ',' || lang END AS tags,
  lang AS meta_domain
  FROM documents LEFT JOIN labels USING (doc_id)),
live AS (SELECT * FROM nodes WHERE coalesce(decayed, 0) = 0),
edges AS (SELECT 'd' || p AS parent_id, 'd' || c AS child_id, CAST(((p * 31 + c * 17) % 100) / 100.0 AS DOUBLE) AS weight,
  {list(REASONS)}[CAST(c % 5 AS INT) + 1] AS reasoning
  FROM (SELECT doc_id // 3 AS p, doc_id AS c FROM documents WHERE doc_id >= 1 AND doc_id % 19 <> 0
        UNION SELECT doc_id // 2, doc_id FROM documents WHERE doc_id >= 1 AND doc_id % 4 = 0)
  WHERE p <> c AND p % 23 <> 0 AND c % 23 <> 0),
emb AS (SELECT 'd' || vec_id AS node_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
q AS (SELECT vector AS qv FROM emb WHERE node_id = 'd0'),
sym AS (SELECT parent_id AS a, child_id AS b FROM edges UNION SELECT child_id, parent_id FROM edges),
metrics AS (SELECT event_id AS id, ts, value AS duration_ms, {', '.join(f'{e} AS {n}' for n, e in FIELDS.items())},
  CASE event_type WHEN 'view' THEN 'retrieval' WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'extraction' WHEN 'signup' THEN 'embed' WHEN 'error' THEN 'token_usage:think' END AS metric_type FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
audit AS (SELECT id AS node_id, ['direct', 'cascade', 'gc_fitness', 'dedup_merge'][n % 4 + 1] AS decay_reason, node_type, CASE WHEN n % 5 <> 0 THEN source_file END AS source_file,
  TIMESTAMP '{AS_OF_TEXT}' - to_days(n % 9) - to_hours(n % 24) AS decay_timestamp FROM (SELECT *, CAST(substr(id, 2) AS INT) AS n FROM nodes WHERE decayed = 1))"""
