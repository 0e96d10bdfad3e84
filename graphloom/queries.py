"""The catalogue: each operator over the test tables, and DuckDB's SQL for the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import fixtures as fx
from .config import profile
from .functions import text as tx
from .operators import audit, consolidate, embed, ingest, lifecycle, lineage, metrics, recover, search, similarity, stats, vector_index, walk
from .plans import retrieve
from .schema import domain_of, live
from .shared import new_folder

P = profile("test-64")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False, raw: bool = False):
    """Registers a function of a graph under its name; raw ones get (spark, sf_dir)."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir) if raw else f(fx.graph(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{fx.SQL}{'' if sql.lstrip().startswith(',') else ' '}{sql}"
        return f

    return put


# Statistics


@query("""SELECT active_nodes, total_nodes, think_node_count, permanent_nodes, auto_permanent, manually_pinned, edges, embedded_nodes, orphan_count,
 total_nodes - active_nodes AS decayed_nodes, round(edges / greatest(1, active_nodes), 2) AS edge_node_ratio, round(embedded_nodes / greatest(1, active_nodes), 4) AS embedding_coverage,
 round(orphan_count / greatest(1, active_nodes) * 100, 1) AS orphan_pct, round(permanent_nodes / greatest(1, active_nodes), 4) AS permanent_ratio
 FROM (SELECT (SELECT count(*) FROM live) AS active_nodes, (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM nodes WHERE source_file = 'system_generated') AS think_node_count,
 (SELECT count(*) FROM live WHERE permanent > 0) AS permanent_nodes, (SELECT count(*) FROM live WHERE permanent = 1) AS auto_permanent, (SELECT count(*) FROM live WHERE permanent = 2) AS manually_pinned,
 (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM emb WHERE node_id IN (SELECT id FROM live)) AS embedded_nodes, (SELECT count(*) FROM live WHERE id NOT IN (SELECT a FROM sym)) AS orphan_count)""")
def graph_summary(g):
    return stats.graph_summary(g)


@query("SELECT (SELECT count(*) FROM emb WHERE node_id IN (SELECT id FROM live)) AS embedded, (SELECT count(*) FROM live WHERE trim(content) <> '') AS embeddable")
def embedding_coverage(g):
    return stats.embedding_coverage(g)


@query("SELECT id FROM live WHERE id NOT IN (SELECT a FROM sym)")
def orphan_nodes(g):
    return stats.orphans(g).select("id")


@query("SELECT coalesce(domain, 'unknown') AS domain, count(*) AS n FROM live GROUP BY 1")
def domain_counts(g):
    return stats.domain_counts(g)


@query("SELECT node_type, count(*) AS n FROM live GROUP BY 1 ORDER BY n DESC, node_type LIMIT 5")
def node_type_top(g):
    return stats.node_type_top(g)


@query("SELECT CASE WHEN permanent > 0 THEN 'permanent' ELSE 'other' END AS kind, count(*) AS n, min(access_count) AS low, round(avg(access_count), 6) AS mean, max(access_count) AS high FROM nodes GROUP BY 1")
def permanence_by_access(g):
    return stats.permanence_by_access(g)


@query("SELECT coalesce(greatest(list_sort(list(access_count))[CAST(floor(count(*) * 0.75) AS INT) + 1], 5), 10) AS threshold FROM live WHERE access_count > 0")
def recommended_threshold(g):
    return stats.recommended_threshold(g)


@query("""SELECT state, count(*) AS n FROM (SELECT CASE WHEN len(vector) <> 64 THEN 'wrong_dim' WHEN list_sum(list_transform(vector, lambda x: x * x)) < 1e-12 THEN 'zero_norm' ELSE 'sound' END AS state FROM emb
 UNION ALL SELECT 'without_node' FROM emb WHERE node_id NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'without_embedding' FROM live WHERE id NOT IN (SELECT node_id FROM emb)) GROUP BY 1""")
def integrity_report(g):
    return stats.integrity(g, 64)


@query("SELECT count(*) FILTER (permanent > 0 AND decayed = 1) AS permanent_decayed, count(*) FILTER (permanent NOT IN (0, 1, 2)) AS odd_value, count(*) FILTER (permanent = 1 AND access_count < 10) AS permanent_low_access FROM nodes")
def permanence_integrity(g):
    return stats.permanence_integrity(g)


@query("SELECT 'test-64' AS model, count(*) AS n, min(len(vector)) AS dim_low, max(len(vector)) AS dim_high FROM emb")
def embedding_stats(g):
    return stats.embedding_stats(g)


_DEGREES = """, deg AS (SELECT id, (SELECT count(*) FROM edges WHERE parent_id = id) AS o, (SELECT count(*) FROM edges WHERE child_id = id) AS i FROM nodes) """


@query(_DEGREES + "SELECT round(avg(o), 6) AS mean_out_degree, max(o) AS most_out_degree, round(avg(i), 6) AS mean_in_degree, max(i) AS most_in_degree FROM deg")
def degree_stats(g):
    return stats.degree_stats(g)


@query(_DEGREES + "SELECT id, o + i AS degree FROM deg WHERE o + i >= 3 ORDER BY degree DESC, id LIMIT 10")
def hub_nodes(g):
    return stats.hubs(g)


@query(_DEGREES + "SELECT id, o AS out_degree, i AS in_degree FROM deg")
def node_degrees(g):
    return stats.degrees(g)


@query("""SELECT CASE WHEN reasoning LIKE '%summariz%' THEN 'summarizes' WHEN reasoning LIKE '%cross%' THEN 'cross_link' WHEN reasoning LIKE '%contradict%' OR reasoning LIKE '%conflict%' THEN 'contradicts' ELSE 'other' END AS bucket,
 count(*) AS n, round(avg(weight), 6) AS mean_weight FROM edges GROUP BY 1""")
def reasoning_buckets(g):
    return stats.reasoning_buckets(g)


@query("SELECT source_file, node_type, count(*) AS size, min(id) AS first_id FROM nodes GROUP BY 1, 2")
def source_clusters(g):
    return stats.source_clusters(g)


@query("SELECT tag, count(*) AS n FROM (SELECT trim(unnest(string_split(tags, ','))) AS tag FROM nodes) WHERE tag <> '' GROUP BY 1")
def tag_counts(g):
    return stats.tag_counts(g)


@query("SELECT id, node_type, ts FROM live ORDER BY ts DESC, id LIMIT 3")
def recent_activity(g):
    return stats.recent_activity(g)


@query(f"""SELECT coalesce(domain, 'unknown') AS domain, count(*) AS n FROM live WHERE (source_file LIKE 'system_generated%' OR source_file LIKE 'extractor%')
 AND ts >= TIMESTAMP '{fx.AS_OF_TEXT}' - to_days(30) GROUP BY 1 ORDER BY n, domain LIMIT 3""")
def underrepresented_domains(g):
    return stats.underrepresented_domains(g, fx.as_of())


@query(f"SELECT count(*) AS n FROM nodes WHERE ts > TIMESTAMP '{fx.AS_OF_TEXT}' - to_days(7)")
def recent_count(g):
    return stats.recent_count(g, fx.as_of())


# Metrics

_MAS = f"TIMESTAMP '{fx.METRICS_AS_OF_TEXT}'"
_AS = f"TIMESTAMP '{fx.AS_OF_TEXT}'"


@query("SELECT metric_type, count(*) AS n, round(avg(duration_ms), 2) AS mean_ms, round(min(duration_ms), 2) AS low_ms, round(max(duration_ms), 2) AS high_ms FROM metrics GROUP BY 1")
def metrics_by_type(g):
    return metrics.by_type(g.metrics)


@query(f"SELECT metric_type, count(*) AS n, round(avg(duration_ms), 2) AS mean_ms, round(min(duration_ms), 2) AS low_ms, round(max(duration_ms), 2) AS high_ms FROM metrics WHERE ts >= {_MAS} - to_hours(72) GROUP BY 1")
def metrics_by_type_recent(g):
    return metrics.by_type(g.metrics, fx.metrics_as_of(), 72)


@query(f"""SELECT total_queries, avg_retrieval_time, recent_queries_1h, node_count, edge_count, round(v / greatest(1, node_count), 2) AS vec_sync_ratio FROM
 (SELECT count(*) AS total_queries, coalesce(round(avg(duration_ms) FILTER (metric_type = 'retrieval'), 2), 0) AS avg_retrieval_time, count(*) FILTER (metric_type = 'retrieval' AND ts >= {_MAS} - to_hours(1)) AS recent_queries_1h
  FROM metrics WHERE ts >= {_MAS} - to_hours(48)), (SELECT count(*) AS node_count FROM live), (SELECT count(*) AS edge_count FROM edges), (SELECT count(*) AS v FROM emb)""")
def metrics_summary(g):
    return metrics.summary(g, fx.metrics_as_of(), 48)


@query("SELECT date_trunc('hour', ts) AS start, count(*) AS n, round(sum(duration_ms), 4) AS total_ms FROM metrics WHERE metric_type = 'retrieval' GROUP BY 1")
def metrics_timeseries(g):
    return metrics.hourly(g.metrics, "retrieval")


@query(f"SELECT ts, duration_ms FROM metrics WHERE metric_type = 'search' AND ts >= {_MAS} - to_hours(24)")
def metrics_points(g):
    return metrics.series(g.metrics, "search", fx.metrics_as_of(), 24).select("ts", "duration_ms")


@query(f"""SELECT {', '.join(f"round(coalesce(avg({f}), 0)::DOUBLE, 2) AS {n}" for f, n in metrics.RETRIEVAL_FIELDS.items())},
 round(coalesce(avg(greatest(0, bfs_explored - seeds_found)) FILTER (bfs_explored <> 0 AND seeds_found <> 0), 0)::DOUBLE, 2) AS bfs_bonus FROM metrics WHERE metric_type = 'retrieval' AND ts >= {_MAS} - to_hours(240)""")
def retrieval_stats(g):
    return metrics.retrieval_breakdown(g.metrics, fx.metrics_as_of(), 240)


@query("SELECT metric_type, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM metrics WHERE metric_type LIKE 'token_usage:%' GROUP BY 1")
def token_usage(g):
    return metrics.token_usage(g.metrics)


_DAYS = """, h AS (SELECT date_trunc('day', ts) AS ts, round(avg(results_returned) FILTER (metric_type = 'retrieval'), 6) AS avg_nodes, round(avg(input_tokens) FILTER (metric_type = 'retrieval'), 6) AS avg_tokens,
 round(avg(duration_ms) FILTER (metric_type = 'retrieval'), 6) AS avg_latency_ms, count(*) FILTER (metric_type = 'search')::DOUBLE AS orphan_count FROM metrics GROUP BY 1) """


@query(_DAYS + f"""SELECT series, points, "first", "last", round(change * 100, 1) AS change_pct,
 CASE series WHEN 'avg_nodes' THEN abs(change) > 0.3 WHEN 'avg_latency_ms' THEN abs(change) > 0.5 WHEN 'orphan_count' THEN abs(change) > 0.3 ELSE false END AS anomaly,
 CASE series WHEN 'avg_nodes' THEN change < -0.15 WHEN 'avg_latency_ms' THEN change > 0.3 WHEN 'orphan_count' THEN change > 0.2 ELSE false END AS concern
 FROM (SELECT series, count(*) AS points, arg_min(value, ts) AS "first", arg_max(value, ts) AS "last", CASE WHEN arg_min(value, ts) <> 0 THEN (arg_max(value, ts) - arg_min(value, ts)) / arg_min(value, ts) ELSE 0 END AS change
  FROM (UNPIVOT (SELECT * FROM h WHERE ts > {_MAS} - to_days(7)) ON avg_nodes, avg_tokens, avg_latency_ms, orphan_count INTO NAME series VALUE value) GROUP BY 1 HAVING count(*) >= 2)""")
def trends(g):
    return metrics.trends(metrics.daily_history(g.metrics), fx.metrics_as_of(), 7)


@query(_DAYS + """SELECT count(*) AS runs, count(*) FILTER (ok) AS succeeded, coalesce(round(avg(avg_nodes) FILTER (ok), 6), 0) AS avg_nodes, coalesce(round(avg(avg_tokens) FILTER (ok), 6), 0) AS avg_tokens,
 coalesce(round(avg(avg_latency_ms) FILTER (ok), 6), 0) AS avg_latency_ms, coalesce(max(avg_latency_ms) FILTER (ok), 0) AS max_latency_ms FROM (SELECT *, orphan_count < 60 AS ok FROM h)""")
def query_runs(g):
    runs = metrics.daily_history(g.metrics).select((F.col("orphan_count") < 60).alias("success"), F.col("avg_nodes").alias("nodes"), F.col("avg_tokens").alias("tokens"), F.col("avg_latency_ms").alias("latency_ms"))
    return metrics.run_rollup(runs)


@query("SELECT id, metric_type, duration_ms FROM metrics ORDER BY id DESC LIMIT 20")
def recent_metrics(g):
    return g.metrics.select("id", "metric_type", "duration_ms").orderBy(F.desc("id")).limit(20)


# The log of what decayed

_LOG = f", log AS (SELECT *, decay_timestamp::DATE = {_AS}::DATE AS today FROM audit WHERE decay_timestamp >= {_AS} - to_days(7)) "


@query(_LOG + """, c AS (SELECT 'reason' AS measure, coalesce(decay_reason, '(none)') AS key, count(*)::DOUBLE AS n FROM log GROUP BY 2
 UNION ALL SELECT 'node_type', coalesce(node_type, '(none)'), count(*) FROM log GROUP BY 2 UNION ALL SELECT 'source_file', coalesce(source_file, '(none)'), count(*) FROM log GROUP BY 2),
 t AS (SELECT count(*) AS total, count(*) FILTER (today) AS today FROM log)
 SELECT measure, key, n FROM c QUALIFY row_number() OVER (PARTITION BY measure ORDER BY n DESC, key) <= 5 OR measure = 'reason'
 UNION ALL SELECT 'total', 'events', total FROM t UNION ALL SELECT 'total', 'today', today FROM t UNION ALL SELECT 'total', 'daily_mean', round(total / 7, 2) FROM t
 UNION ALL SELECT 'total', 'anomaly', (today > 2 * total / 7 AND total >= 5)::INT FROM t""", raw=True)
def decay_audit_rollup(spark, sf_dir):
    return audit.rollup(fx.audit(spark, sf_dir), fx.as_of(), 7)


@query(f"SELECT node_id, decay_reason FROM audit WHERE decay_timestamp >= {_AS} - to_days(3)", raw=True)
def decay_audit_retained(spark, sf_dir):
    return audit.kept(fx.audit(spark, sf_dir), fx.as_of(), 3).select("node_id", "decay_reason")


@query("SELECT node_id, decay_reason, decay_timestamp FROM audit ORDER BY decay_timestamp DESC, node_id LIMIT 20", raw=True)
def decay_audit_recent(spark, sf_dir):
    return audit.recent(fx.audit(spark, sf_dir)).select("node_id", "decay_reason", "decay_timestamp")


@query(f"""SELECT id AS node_id, substr(replace(trim(content), chr(10), ' '), 1, 80) AS content_summary, 'direct' AS decay_reason, access_count AS access_count_at_decay, coalesce(domain, '-') AS domain FROM live
 WHERE permanent = 0 AND access_count = 0 AND ts < {_AS} - to_days(14) AND id NOT IN (SELECT a FROM sym WHERE b IN (SELECT id FROM live))""")
def decay_audit_rows(g):
    log = lifecycle.decay_candidates(g, fx.as_of()).withColumn("reason", F.lit("direct"))
    return audit.rows(g, log, fx.as_of()).select("node_id", "content_summary", "decay_reason", "access_count_at_decay", F.coalesce("domain", F.lit("-")).alias("domain"))


# Search


@query("SELECT node_id, round(list_cosine_similarity(vector, qv), 6) AS sim FROM emb, q ORDER BY list_cosine_similarity(vector, qv) DESC, node_id LIMIT 10", raw=True)
def vector_topk(spark, sf_dir):
    return search.top_k(fx.graph(spark, sf_dir), fx.query_vector(spark, sf_dir), 10, True).select("node_id", F.round("sim", 6).alias("sim"))


@query("SELECT node_id, round(list_cosine_similarity(vector, qv), 6) AS sim FROM emb, q WHERE node_id IN (SELECT id FROM live) ORDER BY list_cosine_similarity(vector, qv) DESC, node_id LIMIT 10", raw=True)
def vector_topk_live(spark, sf_dir):
    return search.top_k(fx.graph(spark, sf_dir), fx.query_vector(spark, sf_dir), 10).select("node_id", F.round("sim", 6).alias("sim"))


_SIMS = ", sims AS (SELECT a.node_id AS a, b.node_id AS b, list_cosine_similarity(a.vector, b.vector) AS sim FROM emb a JOIN emb b ON a.node_id < b.node_id) , lsims AS (SELECT * FROM sims WHERE a IN (SELECT id FROM live) AND b IN (SELECT id FROM live)) "


@query("""SELECT cand_id, round(greatest(max(s), 0), 6) AS max_sim, greatest(max(s), 0) < 0.45 AS is_novel FROM
 (SELECT c.node_id AS cand_id, list_cosine_similarity(c.vector, e.vector) AS s FROM emb c JOIN emb e ON e.node_id IN (SELECT id FROM live)) GROUP BY 1""")
def novelty_check(g):
    cand = g.emb.select(F.col("node_id").alias("cand_id"), "vector")
    return search.novelty(g, cand, P.novelty, P.dim).select("cand_id", F.round("max_sim", 6).alias("max_sim"), "is_novel")


_ASKED = """, asked AS (SELECT a.node_id AS a, b.node_id AS b, list_cosine_similarity(a.vector, b.vector) AS sim FROM emb a JOIN emb b ON a.node_id <> b.node_id
 WHERE CAST(substr(a.node_id, 2) AS INT) % 20 = 0 AND b.node_id IN (SELECT id FROM live)) """


def _queries(g):
    """The rows that a search is asked with: ids divisible by 20."""
    return g.emb.where("cast(substr(node_id, 2) AS INT) % 20 = 0")


@query(_ASKED + "SELECT a, b, round(sim, 6) AS sim FROM asked WHERE sim >= 0.3 QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 3")
def extraction_links(g):
    return search.similar_links(g, _queries(g), dim=P.dim).select("a", "b", F.round("sim", 6).alias("sim"))


def _index(g):
    return vector_index.build(g.emb, new_folder(g.emb.sparkSession, "vector-index"), dim=P.dim)


@query()
def indexed_topk(g):
    """A few cells of the index; its recall against the next query is measured by a test."""
    return vector_index.search(_index(g), _queries(g)).withColumn("sim", F.round("sim", 6))


@query(""", found AS (SELECT a.node_id AS q, b.node_id AS node_id, list_cosine_similarity(a.vector, b.vector) AS sim FROM emb a JOIN emb b ON a.node_id <> b.node_id
 WHERE CAST(substr(a.node_id, 2) AS INT) % 20 = 0) SELECT q, node_id, round(sim, 6) AS sim FROM found QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, node_id) <= 10""")
def indexed_topk_exact(g):
    return vector_index.search(_index(g), _queries(g), probes=0).withColumn("sim", F.round("sim", 6))


@query(_ASKED + "SELECT a AS cand_id FROM asked GROUP BY 1 HAVING max(sim) <= 0.38")
def diversity_gate(g):
    return search.diverse(g, _queries(g).select(F.col("node_id").alias("cand_id"), "vector"), 0.38).select("cand_id")


@query(_SIMS + "SELECT node_id, round(max(sim), 6) AS max_sim FROM (SELECT a AS node_id, sim FROM sims UNION ALL SELECT b, sim FROM sims) GROUP BY 1")
def nn_per_node(g):
    return search.nearest(g.emb, P.dim).select("node_id", F.round("max_sim", 6).alias("max_sim"))


@query("SELECT id, 1.0::DOUBLE AS score FROM live WHERE content ILIKE '%the %' ORDER BY id LIMIT 10")
def content_like(g):
    return search.content_like(g, "the ", 10)


_KEY = ["tion", "the", "ing", "and", "queue"]


@query("""SELECT id, score FROM (SELECT id, round(least(1.0, (list_contains(w, 'tion')::INT + list_contains(w, 'ing')::INT + list_contains(w, 'queue')::INT) / 3.0
 + (contains(lower(content), 'tion')::INT + contains(lower(content), 'ing')::INT + contains(lower(content), 'queue')::INT) * 0.1), 6)::DOUBLE AS score
 FROM (SELECT id, content, regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+') AS w FROM live)) WHERE score > 0.1 ORDER BY score DESC, id LIMIT 5""")
def keyword_retrieve(g):
    return search.keyword_top(g, "The tion and ing queue")


@query("SELECT id FROM live WHERE tags ILIKE '%SRC1%'")
def tag_filter(g):
    return live(g.nodes).where(tx.tag_any(["SRC1"])).select("id")


@query("SELECT id FROM live WHERE tags IS NULL OR tags NOT ILIKE '%private%'")
def tag_exclude(g):
    return live(g.nodes).where(tx.tag_none(["private"])).select("id")


@query("SELECT id FROM live WHERE domain = 'de'")
def domain_filter(g):
    return live(g.nodes).where(F.col("domain") == "de").select("id")


@query("""SELECT * FROM (SELECT child_id AS id, weight, 'out' AS direction FROM edges WHERE parent_id = 'd5' UNION ALL SELECT parent_id, weight, 'in' FROM edges WHERE child_id = 'd5')
 WHERE id IN (SELECT id FROM live) ORDER BY weight DESC, id, direction LIMIT 10""")
def related_nodes(g):
    return search.related(g, "d5")


@query("SELECT parent_id, weight, reasoning, node_type FROM edges JOIN nodes ON parent_id = id WHERE child_id = 'd100'")
def parents_ranked(g):
    return search.parents_ranked(g, "d100")


_LSYM = ", lsym AS (SELECT a, b FROM sym WHERE a IN (SELECT id FROM live) AND b IN (SELECT id FROM live)) "


@query(_LSYM + """, w AS (SELECT id, 0 AS hops FROM live WHERE id IN ('d1', 'd7', 'd20') UNION SELECT b, hops + 1 FROM w JOIN lsym ON a = id WHERE hops < 3)
 SELECT id, CAST(min(hops) AS INT) AS hops FROM w GROUP BY 1""", recursive=True)
def khop_neighbors(g):
    return walk.khop(g, g.nodes.where(F.col("id").isin("d1", "d7", "d20")), 3)


@query(_LSYM + f""", hits AS (SELECT node_id, list_cosine_similarity(vector, qv) AS sim FROM emb, q WHERE node_id IN (SELECT id FROM live) ORDER BY sim DESC, node_id LIMIT 20),
 w AS (SELECT node_id AS id, 0 AS hops FROM hits UNION SELECT b, hops + 1 FROM w JOIN lsym ON a = id WHERE hops < 2), m AS (SELECT id, min(hops) AS hops FROM w GROUP BY 1)
 SELECT id, node_type, coalesce(domain, 'unknown') AS domain, CAST(hops AS INT) AS hops, round(coalesce(sim, 0), 6) AS sim,
 round((0.5 * coalesce(sim, 0) + 0.5 / (hops + 1)) * CASE WHEN age > 0 THEN 0.5 + 0.5 * exp(-age / 365.0) ELSE 1.0 END, 6) AS score
 FROM (SELECT *, epoch(TIMESTAMP '{fx.AS_OF_TEXT}' - coalesce(referent_ts, ts)) / 86400.0 AS age FROM live) JOIN m USING (id) LEFT JOIN hits ON node_id = id ORDER BY score DESC, id LIMIT 10""", recursive=True, raw=True)
def hybrid_retrieve(spark, sf_dir):
    return retrieve.hybrid(fx.graph(spark, sf_dir), fx.query_vector(spark, sf_dir), fx.as_of())


@query(raw=True)
def hybrid_indexed(spark, sf_dir):
    """The same with seeds from the vector index, all of whose cells are probed."""
    g = fx.graph(spark, sf_dir)
    return retrieve.hybrid(g, fx.query_vector(spark, sf_dir), fx.as_of(), index=_index(g), probes=0)


ORACLES["hybrid_indexed"] = ORACLES["hybrid_retrieve"]


@query(raw=True)
def beam_bfs(spark, sf_dir):
    return retrieve.beam(fx.graph(spark, sf_dir), fx.query_vector(spark, sf_dir))


@query(""", d AS (SELECT * FROM nodes WHERE id IN ('d3', 'd40', 'd41', 'd77', 'd9999999')) SELECT id, node_type, coalesce(domain, 'unknown') AS domain FROM d WHERE coalesce(decayed, 0) = 0 AND (tags IS NULL OR tags NOT ILIKE '%private%')""")
def node_details(g):
    return retrieve.details(g, ["d3", "d40", "d41", "d77", "d9999999"], exclude_tags=["private"]).select("id", "node_type", "domain")


@query(f"SELECT id, ts FROM live WHERE tags ILIKE '%vault:private%' AND ts < {_AS} - to_days(30)")
def private_candidates(g):
    return search.private_candidates(g, fx.as_of(), 30).select("id", "ts")


@query(f"SELECT id, content FROM live WHERE source_file = 'system_generated' AND ts > {_AS} - to_days(14)")
def saturated_themes(g):
    return search.saturated_themes(g, fx.as_of()).select("id", "content")


# Lineage


_ANC = ", up AS (SELECT child_id AS id, parent_id AS anc FROM edges UNION SELECT u.id, e.parent_id FROM up u JOIN edges e ON e.child_id = u.anc) "


@query(""", w AS (SELECT parent_id AS ancestor, 1 AS hops FROM edges WHERE child_id = 'd800' UNION SELECT parent_id, hops + 1 FROM w JOIN edges ON child_id = ancestor WHERE hops < 50)
 SELECT ancestor, CAST(min(hops) AS INT) AS hops, ancestor NOT IN (SELECT child_id FROM edges) AS is_root FROM w GROUP BY 1""", recursive=True)
def why_closure(g):
    return lineage.why(g, "d800")


@query("SELECT id FROM nodes WHERE id NOT IN (SELECT child_id FROM edges)")
def roots(g):
    return lineage.roots(g)


@query("SELECT id FROM nodes WHERE id NOT IN (SELECT a FROM sym)")
def audit_orphans(g):
    return lineage.audit_orphans(g)


@query(_ANC + """, ins AS (SELECT id, anc AS c FROM up UNION SELECT child_id, child_id FROM edges)
 SELECT id, round(m, 6) AS mean_weight FROM (SELECT i.id, avg(weight) AS m FROM ins i JOIN edges e ON e.child_id = i.c GROUP BY 1) WHERE m < 0.5""", recursive=True)
def weak_chains(g):
    return lineage.weak_chains(g)


@query("SELECT parent_id, child_id, weight FROM edges WHERE regexp_matches(lower(reasoning), 'contradict|conflict|oppose')")
def contradictions(g):
    return lineage.contradictions(g)


@query(""", w AS (SELECT id, 0 AS depth FROM nodes WHERE id NOT IN (SELECT child_id FROM edges) UNION SELECT child_id, depth + 1 FROM w JOIN edges ON parent_id = id WHERE depth < 20)
 SELECT id, CAST(max(depth) AS INT) AS depth FROM w GROUP BY 1""", recursive=True)
def derivation_depth(g):
    return lineage.depth(g)


@query(""", w AS (SELECT 'd17' AS id, 0 AS hops UNION SELECT b, hops + 1 FROM w JOIN sym ON a = id WHERE hops < 8)
 SELECT CAST(min(hops) AS INT) AS hops FROM w WHERE id = 'd40' HAVING count(*) > 0""", recursive=True)
def shortest_path(g):
    return walk.distance(g, "d17", "d40", 8)


@query(""", h AS (SELECT child_id, parent_id FROM edges QUALIFY row_number() OVER (PARTITION BY child_id ORDER BY weight DESC, parent_id) = 1)
 SELECT child_id AS id, 1 AS step, parent_id AS ancestor FROM h UNION ALL SELECT a.child_id, 2, b.parent_id FROM h a JOIN h b ON a.parent_id = b.child_id
 UNION ALL SELECT a.child_id, 3, c.parent_id FROM h a JOIN h b ON a.parent_id = b.child_id JOIN h c ON b.parent_id = c.child_id""")
def parent_chain(g):
    return lineage.parent_chain(g)


_ROUND = ", up AS (SELECT child_id AS id, parent_id AS anc FROM ring UNION SELECT u.id, e.parent_id FROM up u JOIN ring e ON e.child_id = u.anc) "


@query(", ring AS (SELECT parent_id, child_id FROM edges UNION ALL VALUES ('d9', 'd1'), ('d40', 'd4'))" + _ROUND + "SELECT DISTINCT id FROM up WHERE id = anc", recursive=True)
def cycles(g):
    extra = g.nodes.sparkSession.createDataFrame([("d9", "d1"), ("d40", "d4")], "parent_id string, child_id string")
    return lineage.cyclic(g.with_(edges=g.edges.unionByName(extra, allowMissingColumns=True)))


@query()
def cycle_lists(g):
    """The cycles as lists; tests/test_oracles.py has them from sequential trees."""
    extra = g.nodes.sparkSession.createDataFrame([("d9", "d1"), ("d40", "d4")], "parent_id string, child_id string")
    return lineage.cycle_lists(g.with_(edges=g.edges.unionByName(extra, allowMissingColumns=True)))


# Similarity


@query(_SIMS + "SELECT a, b, round(sim, 6) AS sim FROM lsims WHERE sim >= 0.35 AND sim < 0.45")
def cross_link_pairs(g):
    return similarity.cosine_pairs(similarity.live_vectors(g), P.cross_link, P.dedup, P.dim).select("a", "b", F.round("sim", 6).alias("sim"))


@query(_SIMS + "SELECT a, b, round(sim, 6) AS sim FROM lsims WHERE sim >= 0.45")
def dedup_pairs(g):
    return similarity.cosine_pairs(similarity.live_vectors(g), P.dedup, dim=P.dim).select("a", "b", F.round("sim", 6).alias("sim"))


@query(_SIMS + "SELECT count(*) AS n FROM lsims WHERE sim > 0.4")
def near_duplicate_count(g):
    return similarity.pair_count(similarity.live_vectors(g), 0.4, P.dim)


@query(_SIMS + "SELECT a, b, CASE WHEN sim >= 0.45 THEN 'merge' ELSE 'link' END AS action FROM lsims WHERE sim >= 0.35")
def labelled_pairs(g):
    return similarity.banded(similarity.cosine_pairs(similarity.live_vectors(g), P.cross_link, dim=P.dim), P.cross_link, P.dedup).select("a", "b", "action")


@query(_SIMS + """SELECT a, b, round(sim, 6) AS sim, round(CASE WHEN x.node_type <> y.node_type THEN 0.05 ELSE 0 END + CASE WHEN x.meta_domain <> y.meta_domain THEN 0.05 ELSE 0 END - abs(sim - 0.5), 6) AS score
 FROM lsims JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b WHERE sim >= 0.30 AND sim <= 0.70 ORDER BY score, a, b LIMIT 10""")
def tension_pairs(g):
    return similarity.tension_pairs(g)


_WORDS = f""", sets AS (SELECT id, list_filter(list_distinct(regexp_split_to_array(lower(content), '\\s+')), lambda w: w <> '' AND NOT list_contains({list(tx.SIMILARITY_STOPWORDS)}, w)) AS w FROM nodes) """


@query(_WORDS + """, reps AS (SELECT min(id) AS id, list_sort(w) AS w FROM sets WHERE len(w) > 0 GROUP BY 2)
 SELECT a, b, round(sim, 6) AS sim FROM (SELECT x.id AS a, y.id AS b, len(list_intersect(x.w, y.w)) AS i, len(x.w) AS m, len(y.w) AS n, i / (m + n - i) AS sim FROM reps x JOIN reps y ON x.id < y.id
 WHERE least(len(x.w), len(y.w)) >= 0.82 * greatest(len(x.w), len(y.w))) WHERE sim >= 0.82""")
def jaccard_pairs(g):
    return similarity.jaccard_pairs(g.nodes, 0.82).select("a", "b", F.round("sim", 6).alias("sim"))


@query(_WORDS + 'SELECT id, min(id) OVER (PARTITION BY list_sort(w)) AS "class" FROM sets WHERE len(w) > 0')
def word_classes(g):
    return similarity.word_classes(g.nodes)


@query(""", o AS (SELECT node_id, vector, row_number() OVER (ORDER BY md5('0' || node_id), node_id) AS k FROM emb),
 ends AS (SELECT CAST('0x' || substr(md5('0:a:' || i), 1, 15) AS BIGINT) % (SELECT count(*) FROM o) + 1 AS a, CAST('0x' || substr(md5('0:b:' || i), 1, 15) AS BIGINT) % (SELECT count(*) FROM o) + 1 AS b FROM range(40000) t(i)),
 s AS (SELECT list_cosine_similarity(x.vector, y.vector) AS sim FROM (SELECT a, CASE WHEN a = b THEN b % (SELECT count(*) FROM o) + 1 ELSE b END AS b FROM ends) e JOIN o x ON x.k = e.a JOIN o y ON y.k = e.b),
 n AS (SELECT a.node_id, max(list_cosine_similarity(a.vector, b.vector)) AS sim FROM o a JOIN o b ON a.node_id <> b.node_id GROUP BY 1),
 r AS (SELECT *, greatest(round(p99 + 0.03, 2), round(p95 + 0.05, 2)) AS cross_link FROM
  (SELECT count(*) AS pairs, round(avg(sim), 3) + 0.0::DOUBLE AS mean, round(quantile_cont(sim, 0.5), 3) + 0.0::DOUBLE AS p50, round(quantile_cont(sim, 0.95), 3) + 0.0::DOUBLE AS p95, round(quantile_cont(sim, 0.99), 3) + 0.0::DOUBLE AS p99 FROM s),
  (SELECT round(quantile_cont(sim, 0.25), 3) + 0.0::DOUBLE AS nn_p25, round(quantile_cont(sim, 0.5), 3) + 0.0::DOUBLE AS nn_p50, round(quantile_cont(sim, 0.9), 3) + 0.0::DOUBLE AS nn_p90, round(quantile_cont(sim, 0.99), 3) + 0.0::DOUBLE AS nn_p99 FROM n))
 SELECT *, round(cross_link + 0.04, 2) AS dedup, round(greatest(round(cross_link + 0.04, 2) + 0.01, nn_p50 + 0.03), 2) AS novelty FROM r""")
def calibration(g):
    return similarity.calibration(g.emb, dim=P.dim)


# Consolidation and lifecycle

_FIT = """, fit AS (SELECT id, coalesce(b, 0) AS branching, coalesce(x, 0) AS cross_links, coalesce(b, 0) + 0.5 * coalesce(x, 0) AS fitness FROM live
 LEFT JOIN (SELECT parent_id AS id, count(*) AS b FROM edges GROUP BY 1) USING (id)
 LEFT JOIN (SELECT id, count(*) AS x FROM (SELECT parent_id AS id FROM edges WHERE reasoning ILIKE '%cross_link%' UNION ALL SELECT child_id FROM edges WHERE reasoning ILIKE '%cross_link%' AND parent_id <> child_id) GROUP BY 1) USING (id)) """


@query(_FIT + "SELECT id, branching, cross_links, CAST(fitness AS DOUBLE) AS fitness FROM fit")
def fitness(g):
    return lifecycle.fitness(g)


@query(_FIT + ", deep AS (" + """WITH RECURSIVE w AS (SELECT id, 0 AS depth FROM nodes WHERE id NOT IN (SELECT child_id FROM edges) UNION SELECT child_id, depth + 1 FROM w JOIN edges ON parent_id = id WHERE depth < 20)
 SELECT id, CAST(max(depth) AS INT) AS depth FROM w GROUP BY 1) SELECT id, branching, cross_links, coalesce(depth, 0) AS depth, round(CAST(fitness AS DOUBLE) + 0.1 * coalesce(depth, 0), 6) AS fitness FROM fit LEFT JOIN deep USING (id)""", recursive=True)
def fitness_with_depth(g):
    return lifecycle.fitness_with_depth(g, lineage.depth(g)).withColumn("fitness", F.round("fitness", 6))


@query(_FIT + f"""SELECT id, CAST(fitness AS DOUBLE) AS fitness, CASE WHEN contains(source_file, 'think_cycle') THEN 0.075::DOUBLE ELSE 0.05::DOUBLE END AS threshold FROM fit JOIN nodes USING (id)
 WHERE permanent = 0 AND (last_accessed IS NULL OR last_accessed <= TIMESTAMP '{fx.AS_OF_TEXT}' - to_days(7))
 AND fitness < CASE WHEN contains(source_file, 'think_cycle') THEN 0.075 ELSE 0.05 END""")
def gc_candidates(g):
    return lifecycle.gc_candidates(g, fx.as_of())


@query(_FIT + """, should AS (SELECT id FROM fit ORDER BY fitness DESC, id LIMIT (SELECT CAST(floor(sqrt(count(*))) AS INT) FROM fit)), has AS (SELECT id FROM live WHERE node_type = 'core_memory')
 SELECT coalesce(s.id, h.id) AS id, CASE WHEN h.id IS NULL THEN 'promote' WHEN s.id IS NULL THEN 'demote' ELSE 'keep' END AS change FROM should s FULL JOIN has h ON s.id = h.id""")
def core_memory(g):
    return lifecycle.core_memory(g)


@query("SELECT id FROM live WHERE permanent = 0 AND access_count >= 10")
def promotion_candidates(g):
    return lifecycle.promotion_candidates(g)


@query(f"""SELECT id FROM live WHERE permanent = 0 AND access_count = 0 AND ts < TIMESTAMP '{fx.AS_OF_TEXT}' - to_days(14) AND id NOT IN (SELECT a FROM sym WHERE b IN (SELECT id FROM live))""")
def decay_candidates(g):
    return lifecycle.decay_candidates(g, fx.as_of())


def _cascade_sql(rounds: int) -> str:
    """The rounds one by one; the last one has to be empty."""
    sql = f""", start AS (SELECT id FROM nodes WHERE coalesce(decayed, 0) <> 0 OR domain = 'en'),
 may AS (SELECT id FROM live WHERE permanent = 0 AND access_count = 0 AND ts <= {_AS} - to_days(30) AND id NOT IN (SELECT id FROM start)), r0 AS (SELECT id FROM start) """
    for n in range(1, rounds + 1):
        gone = " UNION ALL ".join(f"SELECT id FROM r{k}" for k in range(n))
        sql += f""", r{n} AS (SELECT id FROM may WHERE id NOT IN ({gone}) AND id IN (SELECT child_id FROM edges JOIN r{n - 1} ON parent_id = id)
 AND id NOT IN (SELECT child_id FROM edges WHERE parent_id IN (SELECT id FROM nodes) AND parent_id NOT IN ({gone}))) """
    return sql + " UNION ALL ".join(f"SELECT id, {n} AS round FROM r{n}" for n in range(1, rounds + 1))


@query(_cascade_sql(6))
def cascade_decay(g):
    """What goes when, beside the decayed nodes, a whole domain does."""
    return lifecycle.cascade(g, g.nodes.where("coalesce(decayed, 0) <> 0 OR domain = 'en'").select("id"), fx.as_of())


@query("SELECT node_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM nodes WHERE decayed = 1), 6) AS share FROM nodes WHERE decayed = 1 GROUP BY 1")
def decayed_by_type(g):
    return lifecycle.decayed_by_type(g)


@query("SELECT id, node_type, access_count, CASE WHEN permanent = 2 THEN 'pinned' ELSE 'promoted' END AS level FROM live WHERE permanent > 0")
def permanent_nodes(g):
    return lifecycle.permanent_nodes(g.nodes)


@query()
def dedup_clusters(g):
    """Maximal cliques over the merge threshold; tests/test_oracles.py has them from a sequential version."""
    return consolidate.cosine_cliques(similarity.live_vectors(g), P.dedup, P.dim)


@query()
def link_clusters(g):
    """The same over the link threshold, where cliques are larger and overlap."""
    return consolidate.cosine_cliques(similarity.live_vectors(g), P.cross_link, P.dim)


@query(", w AS (SELECT DISTINCT parent_id, child_id FROM (SELECT parent_id, child_id FROM edges UNION ALL SELECT child_id, parent_id FROM edges)) SELECT parent_id, child_id, 0.8::DOUBLE AS weight, 'extracted_from - both ways' AS reasoning FROM w WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.parent_id = w.parent_id AND e.child_id = w.child_id)")
def new_edges(g):
    wanted = g.edges.select("parent_id", "child_id").union(g.edges.select("child_id", "parent_id")).withColumn("reasoning", F.lit("both ways"))
    return ingest.new_edges(wanted, g.edges)


_MAP = ", m AS (SELECT id, 'd' || (CAST(substr(id, 2) AS INT) // 10 * 10) AS keeper FROM nodes WHERE CAST(substr(id, 2) AS INT) % 10 < 3) "


@query(_MAP + """SELECT p AS parent_id, c AS child_id, weight, reasoning FROM (SELECT coalesce(a.keeper, parent_id) AS p, coalesce(b.keeper, child_id) AS c, weight, reasoning, parent_id, child_id
 FROM edges LEFT JOIN m a ON a.id = parent_id LEFT JOIN m b ON b.id = child_id) WHERE p <> c QUALIFY row_number() OVER (PARTITION BY p, c ORDER BY weight DESC, parent_id, child_id) = 1""")
def rewired_edges(g):
    m = g.nodes.where("cast(substr(id, 2) AS INT) % 10 < 3").selectExpr("id", "concat('d', cast(substr(id, 2) AS INT) DIV 10 * 10) AS keeper")
    return consolidate.rewired(g.edges, m)


@query(_SIMS + """SELECT a, b, round(sim, 6) AS sim FROM lsims WHERE sim >= 0.35 AND sim < 0.45 AND NOT EXISTS (SELECT 1 FROM sym WHERE sym.a = lsims.a AND sym.b = lsims.b)""")
def new_cross_links(g):
    return consolidate.new_links(g, P).select("a", "b", F.round("sim", 6).alias("sim"))


# Text and ingestion


@query("SELECT id, substr(sha256(content), 1, 12) AS content_id, length(content) // 3 AS tokens FROM nodes")
def content_ids(g):
    return g.nodes.select("id", tx.content_id("content").alias("content_id"), tx.token_estimate("content").alias("tokens"))


@query("""SELECT id, p FROM (SELECT id, regexp_replace(regexp_replace(p, '\\s+', ' ', 'g'), '\\[([^\\]]+)\\]\\([^\\)]+\\)', '\\1', 'g') AS p FROM
 (SELECT id, trim(unnest(string_split(content, chr(10) || chr(10))), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS p FROM nodes)
 WHERE length(p) >= 20 AND NOT starts_with(p, '#') AND NOT starts_with(p, '```') AND NOT starts_with(p, '---')) WHERE length(p) >= 20""")
def paragraphs(g):
    return g.nodes.select("id", F.explode(tx.paragraphs("content")).alias("p"))


def _re2(pattern: str) -> str:
    return re.sub(r"^\(\?(i?)U\)", lambda m: "(?i)" if m[1] else "", pattern).replace("'", "''")


_FOUND = " UNION ALL ".join(f"SELECT id, trim(lower(unnest(regexp_extract_all(content, '{_re2(p)}')))) AS x FROM nodes" for p in tx.ANCHORS)


@query(f", found AS ({_FOUND}) SELECT id, CAST(count(DISTINCT x) AS INT) AS n FROM nodes LEFT JOIN found USING (id) GROUP BY 1")
def temporal_anchors(g):
    return g.nodes.select("id", F.size(tx.anchors("content")).alias("n"))


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_TOLD = [f"SELECT id, {k} AS p, generate_subscripts(m, 1) AS i, 'Decision: ' || unnest(m) AS content, 'decision' AS node_type FROM (SELECT id, regexp_extract_all(content, '{_re2(x)}', 1) AS m FROM nodes)" for k, x in enumerate(tx.DECISIONS)]
_TOLD += [f"SELECT id, {4 + k}, generate_subscripts(m, 1), 'Belief: ' || unnest(m), 'belief' FROM (SELECT id, regexp_extract_all(content, '{_re2(x)}', {n}) AS m FROM nodes)" for k, (x, n) in enumerate(tx.BELIEFS)]
_TOLD += [f"SELECT id, 6, i, 'Observation: ' || x, 'observation' FROM (SELECT id, generate_subscripts(m, 1) AS i, trim(unnest(m), {_BLANKS}) AS x FROM (SELECT id, string_split(content, '.') AS m FROM nodes)) WHERE length(x) > 20 AND length(x) < 100 AND regexp_matches(x, '[A-Z][a-z]+')"]


@query(f", told AS ({' UNION ALL '.join(_TOLD)}) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY p, i) - 1 AS INT) AS place, content, node_type FROM told QUALIFY row_number() OVER (PARTITION BY id ORDER BY p, i) <= 5")
def heuristic_extract(g):
    return g.nodes.select("id", F.posexplode(tx.extracted("content")).alias("place", "x")).select("id", "place", "x.content", "x.node_type")


def _any_of(marks) -> str:
    return " OR ".join(f"contains(lower(content), '{m}')" for m in marks)


def _kinds_sql(kinds) -> str:
    return "CASE " + " ".join(f"WHEN {_any_of(marks)} THEN '{kind}'" for kind, marks in kinds) + " ELSE 'observation' END"


@query(f"SELECT id, {_kinds_sql(tx.PARAGRAPH_KINDS)} AS kind FROM nodes")
def paragraph_kinds(g):
    return g.nodes.select("id", tx.paragraph_kind(F.col("content")).alias("kind"))


@query(f"SELECT id, CASE WHEN {_any_of(('est', 'est must', *tx.ASSISTANT_SIGNALS))} THEN 'est' ELSE 'user' END AS domain FROM nodes")
def inferred_domains(g):
    return g.nodes.select("id", tx.domain_of_text(F.col("content"), "user", "est").alias("domain"))


@query("SELECT id, CASE domain WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE domain END AS domain FROM nodes")
def mapped_domains(g):
    return g.nodes.select("id", tx.mapped_domain(F.col("domain"), {"en": "english", "de": "german"}).alias("domain"))


@query("SELECT id, array_to_string(list_filter(list_transform(string_split(tags, ','), lambda t: trim(t)), lambda t: t <> '' AND t <> 'vault:private'), ',') AS tags FROM nodes WHERE tags IS NOT NULL")
def declassified(g):
    return g.nodes.where("tags is not null").select("id", tx.without_tag("vault:private").alias("tags"))


@query("SELECT id, source_file, node_type, CASE node_type WHEN 'core_memory' THEN '#FFD93D' WHEN 'belief' THEN '#51CF66' ELSE '#ADB5BD' END AS colour FROM nodes")
def cluster_members(g):
    return stats.cluster_members(g)


_TIMES = ", m AS (SELECT id, CASE WHEN n % 4 = 1 THEN '2023-0' || (n % 9 + 1) || '-1' || (n % 10) || 'T06:00:00' || CASE WHEN n % 8 = 1 THEN '+02:00' ELSE '' END END AS told, CASE WHEN n % 3 = 0 THEN 'notes/2022-1' || (n % 4) || '-0' || (n % 10) || '.md' ELSE 'notes/x.md' END AS source_file FROM (SELECT *, CAST(substr(id, 2) AS INT) AS n FROM nodes WHERE referent_ts IS NULL)) "


@query(_TIMES + """SELECT id, coalesce(t, d) AS time, CASE WHEN t IS NOT NULL THEN 'metadata' WHEN d IS NOT NULL THEN 'source_file_date' ELSE 'none' END AS origin FROM
 (SELECT id, CASE WHEN told LIKE '%+02:00' THEN CAST(CAST(told AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) END AS t, TRY_CAST(nullif(regexp_extract(source_file, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS TIMESTAMP) AS d FROM m)""")
def event_time_recovery(g):
    n = F.expr("cast(substr(id, 2) AS INT)")
    told = F.when(n % 4 == 1, F.concat(F.lit("2023-0"), n % 9 + 1, F.lit("-1"), n % 10, F.lit("T06:00:00"), F.when(n % 8 == 1, "+02:00").otherwise("")))
    file = F.when(n % 3 == 0, F.concat(F.lit("notes/2022-1"), n % 4, F.lit("-0"), n % 10, F.lit(".md"))).otherwise("notes/x.md")
    return recover.recovered(g.nodes.withColumns({"metadata": F.to_json(F.struct(told.alias("occurred_at"))), "source_file": file}))


@query("""SELECT relation, id, content, weight FROM (SELECT 'derived_from' AS relation, parent_id AS id, weight FROM edges WHERE child_id = 'd4' UNION ALL SELECT 'leads_to', child_id, weight FROM edges WHERE parent_id = 'd4') JOIN nodes USING (id)""")
def node_detail(g):
    return stats.node_detail(g, "d4")


@query("SELECT parent_id, child_id, weight FROM edges WHERE parent_id IN (SELECT id FROM live WHERE node_type IN ('fact', 'belief')) AND child_id IN (SELECT id FROM live WHERE node_type IN ('fact', 'belief'))")
def edges_of_types(g):
    return stats.of_types(g, ["fact", "belief"]).edges.select("parent_id", "child_id", "weight")


@query("SELECT source_file, count(*) AS n FROM nodes GROUP BY 1")
def source_counts(g):
    return stats.source_counts(g)


@query(_SIMS + "SELECT (SELECT count(*) FROM live) AS nodes, (SELECT count(*) FROM live WHERE node_type = 'insight') AS hotspots, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM live WHERE id NOT IN (SELECT a FROM sym)) AS orphans, (SELECT count(*) FROM lsims WHERE sim > 0.38) AS near_duplicates, round((SELECT count(*) FROM emb WHERE node_id IN (SELECT id FROM live)) / greatest(1, (SELECT count(*) FROM live)), 4) AS coverage")
def brain_stats(g):
    return stats.brain_stats(g, "insight", 0.38)


@query("SELECT 'without_embedding' AS state, id FROM live WHERE id NOT IN (SELECT node_id FROM emb) UNION ALL SELECT 'without_node', node_id FROM emb WHERE node_id NOT IN (SELECT id FROM nodes)")
def integrity_ids(g):
    return stats.integrity_ids(g, 64)


@query("SELECT id, CASE WHEN contains(lower(content), 'decided') OR contains(lower(content), 'will') OR contains(lower(content), 'going to') OR contains(lower(content), 'plan to') OR contains(lower(content), 'agreed') THEN 'decision' WHEN contains(lower(content), 'learned') OR contains(lower(content), 'realized') OR contains(lower(content), 'discovered') OR contains(lower(content), 'found that') THEN 'insight' WHEN contains(lower(content), 'commit') OR contains(lower(content), 'promise') OR contains(lower(content), 'deadline') OR contains(lower(content), 'due') OR contains(lower(content), 'by') THEN 'commitment' ELSE 'observation' END AS kind FROM nodes")
def statement_kinds(g):
    return g.nodes.select("id", tx.statement_kind(F.col("content")).alias("kind"))


@query("SELECT parent_id, child_id, CASE WHEN reasoning LIKE '%summarizes%' THEN 'summarizes' WHEN reasoning LIKE '%cross_link%' THEN 'cross_link' WHEN reasoning LIKE '%contradicts%' THEN 'contradicts' ELSE 'derived_from' END AS relation FROM edges WHERE parent_id IN (SELECT id FROM live) AND child_id IN (SELECT id FROM live)")
def export_edges(g):
    from .schema import live_edges

    return live_edges(g).select("parent_id", "child_id", tx.relation().alias("relation"))


@query("SELECT conv_id, turn, role || ': ' || text AS content FROM (SELECT conv_id, turn, role, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM conversations) WHERE role IN ('user', 'assistant') AND length(text) >= 100 AND NOT starts_with(text, '{')", raw=True)
def session_turns(spark, sf_dir):
    return ingest.simple_session(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("SELECT conv_id, max(turn) AS last_turn, arg_max(role, turn) AS last_role FROM conversations WHERE text <> '' GROUP BY 1", raw=True)
def session_referent(spark, sf_dir):
    return ingest.last_time(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("SELECT substr(sha256(content), 1, 12) AS id, content FROM (SELECT DISTINCT text AS content FROM documents WHERE doc_id % 2 = 1 AND trim(text) <> '' AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0))", raw=True)
def ingest_dedup(spark, sf_dir):
    n = fx.nodes(spark, sf_dir)
    odd = F.col("id").substr(F.lit(2), F.lit(20)).cast("long") % 2
    return ingest.new_nodes(n.where(odd == 1).select("content"), n.where(odd == 0))


@query("""SELECT id, length(content) // 3 AS tokens, CAST(sum(length(content) // 3) OVER (ORDER BY ts, id) AS BIGINT) AS total FROM live QUALIFY total <= 60000""")
def token_budget_oldest(g):
    """The oldest nodes that fit a budget, out of all nodes: no rank is cut off before."""
    return ingest.within_budget(live(g.nodes), 60_000, "ts", "id").select("id", "tokens", "total")


@query("""SELECT id, tokens, total FROM (SELECT id, length(content) // 3 AS tokens, CAST(sum(length(content) // 3) OVER (ORDER BY rank) AS BIGINT) AS total FROM
 (SELECT id, content, row_number() OVER (ORDER BY ts DESC, id) AS rank FROM live QUALIFY rank <= 50)) WHERE total <= 2000""")
def token_budget_prefix(g):
    top = live(g.nodes).orderBy(F.desc("ts"), "id").limit(50).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ts"), "id")))
    return ingest.within_budget(top, 2000).select("id", "tokens", "total")


@query("SELECT coalesce(domain, 'unknown') AS domain, id FROM live WHERE access_count > 0 OR id IN (SELECT a FROM sym)")
def signal_gate(g):
    ends = stats.endpoints(g.edges).distinct().withColumn("linked", F.lit(True))
    return live(g.nodes).join(ends, "id", "left").where("access_count > 0 OR linked").select(domain_of().alias("domain"), "id")


# States after a change, and small columns


@query("SELECT id FROM live WHERE trim(content) <> '' AND id NOT IN (SELECT node_id FROM emb)")
def unembedded_nodes(g):
    return embed.unembedded(g).select("id")


@query("SELECT id, access_count + CASE WHEN domain = 'de' THEN 1 ELSE 0 END AS access_count FROM nodes")
def access_tracking(g):
    return lifecycle.touched(g.nodes, g.nodes.where("domain = 'de'").select("id"), fx.as_of()).select("id", "access_count")


@query("SELECT id, CASE WHEN id IN ('d1', 'd2') THEN 2 ELSE permanent END AS permanent FROM nodes")
def pinned_nodes(g):
    return lifecycle.pinned(g.nodes, ["d1", "d2"]).select("id", "permanent")


@query("SELECT id, array_to_string(list_sort(list_distinct(list_concat(['aa', 'zz'], list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda t: trim(t)), lambda t: t <> '')))), ',') AS tags FROM nodes")
def merged_tags(g):
    return g.nodes.select("id", tx.merged_tags("tags", F.lit("zz, aa")).alias("tags"))


@query(_SIMS + """, l AS (SELECT a, b, round(sim, 6) AS weight FROM lsims WHERE sim >= 0.35 AND sim < 0.45 AND NOT EXISTS (SELECT 1 FROM sym WHERE sym.a = lsims.a AND sym.b = lsims.b))
 SELECT parent_id, child_id, weight FROM edges UNION ALL SELECT a, b, weight FROM l UNION ALL SELECT b, a, weight FROM l""")
def linked_state(g):
    return consolidate.linked(g, consolidate.new_links(g, P).withColumn("sim", F.round("sim", 6))).edges.select("parent_id", "child_id", "weight")


_GC = _FIT + f""", gone AS (SELECT id FROM fit JOIN nodes USING (id) WHERE permanent = 0 AND (last_accessed IS NULL OR last_accessed <= {_AS} - to_days(7))
 AND fitness < CASE WHEN contains(source_file, 'think_cycle') THEN 0.075 ELSE 0.05 END) """


@query(_GC + "SELECT id, CASE WHEN id IN (SELECT id FROM gone) THEN 1 ELSE coalesce(decayed, 0) END AS decayed FROM nodes")
def soft_collected(g):
    return lifecycle.collected(g, lifecycle.gc_candidates(g, fx.as_of())).nodes.select("id", F.coalesce("decayed", F.lit(0)).alias("decayed"))


@query(_GC + "SELECT parent_id, child_id FROM edges WHERE parent_id NOT IN (SELECT id FROM gone) AND child_id NOT IN (SELECT id FROM gone)")
def hard_collected(g):
    return lifecycle.collected(g, lifecycle.gc_candidates(g, fx.as_of()), "hard").edges.select("parent_id", "child_id")


@query(_FIT + """, should AS (SELECT id FROM fit ORDER BY fitness DESC, id LIMIT (SELECT CAST(floor(sqrt(count(*))) AS INT) FROM fit))
 SELECT id, CASE WHEN coalesce(decayed, 0) <> 0 THEN node_type WHEN id IN (SELECT id FROM should) THEN 'core_memory' WHEN node_type = 'core_memory' THEN 'derived' ELSE node_type END AS node_type,
 CASE WHEN coalesce(decayed, 0) = 0 AND node_type <> 'core_memory' AND permanent = 0 AND id IN (SELECT id FROM should) THEN 1 ELSE permanent END AS permanent FROM nodes""")
def core_memory_state(g):
    return lifecycle.with_core_memories(g.nodes, lifecycle.core_memory(g)).select("id", "node_type", "permanent")


@query("SELECT id, substr(replace(trim(content), chr(10), ' '), 1, 80) AS summary FROM nodes")
def summaries(g):
    return g.nodes.select("id", tx.summary("content").alias("summary"))


@query(f"""SELECT id, CASE WHEN id LIKE '%3' THEN 'insight' ELSE {_kinds_sql(tx.STATEMENT_KINDS)} END AS kind FROM nodes""")
def typed_lines(g):
    line = F.when(F.col("id").endswith("3"), F.concat(F.lit("[Insight] "), F.regexp_replace("content", "\\n", " "))).otherwise(F.col("content"))
    return g.nodes.select("id", tx.typed_statement(line, ("fact", "insight"), tx.statement_kind)[0].alias("kind"))


@query("SELECT conv_id, turn, 'talk (' || CASE role WHEN 'user' THEN 'human' ELSE 'assistant' END || '): ' || substr(t, 1, 500) AS content FROM (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM conversations WHERE role IN ('user', 'assistant')) WHERE length(t) >= 50", raw=True)
def archive_turns(spark, sf_dir):
    """Every third turn with a mark that a tool's block left."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role in ('user', 'assistant')")
    text = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(tx.TOOL_MARKS[1]))).otherwise(F.col("text"))
    turns = c.select(F.col("conv_id").alias("uuid"), F.col("turn").alias("ordinal"), F.lit("talk").alias("name"), F.when(F.col("role") == "user", "human").otherwise("assistant").alias("sender"), text.alias("text"))
    return ingest.simple_archive(turns).select(F.col("uuid").alias("conv_id"), F.col("ordinal").alias("turn"), "content")


@query("SELECT * FROM (VALUES (0, 'd0'), (1, 'd1'), (2, 'd3'), (3, 'd9')) AS p(distance, id) JOIN (SELECT id, node_type FROM nodes) USING (id)")
def how_path(g):
    """A path that the edges c -> c div 3 fix: d0, d1, d3, d9."""
    return walk.how(g.with_(edges=g.edges.where("child_id in ('d1', 'd3', 'd9')").unionByName(g.nodes.sparkSession.createDataFrame([("d0", "d1")], "parent_id string, child_id string"), allowMissingColumns=True)), "d0", "d9").select("distance", "id", "node_type")


from . import state_queries  # noqa: E402, F401  the rest of the catalogue
