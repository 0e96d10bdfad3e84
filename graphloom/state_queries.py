"""More of the catalogue: states after a change, and what decides them. Clusters are groups of three ids of ten, a rule that SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as fx, store
from .functions import clock, text as tx
from .operators import consolidate, ingest, lifecycle, lsh, recover, similarity, stats, vector_index, walk
from .plans import sleep
from .queries import _AS, _SIMS, P, _cascade_sql, _queries, query
from .schema import normalize_nodes
from .shared import new_folder
from .sources import files

_N = "CAST(substr(id, 2) AS INT)"
_CLUSTERS = f", c AS (SELECT 'c' || ({_N} // 10) AS cluster, id FROM nodes WHERE {_N} % 10 < 3) "
_KEEPERS = _CLUSTERS + ", k AS (SELECT cluster, id, first_value(id) OVER (PARTITION BY cluster ORDER BY access_count DESC, ts ASC NULLS LAST, id) AS keeper FROM c JOIN nodes USING (id)) "
_MERGED = """ (SELECT p AS parent_id, c AS child_id, weight FROM (SELECT coalesce(a.keeper, parent_id) AS p, coalesce(b.keeper, child_id) AS c, weight, parent_id, child_id
 FROM edges LEFT JOIN k a ON a.id = parent_id LEFT JOIN k b ON b.id = child_id) WHERE p <> c QUALIFY row_number() OVER (PARTITION BY p, c ORDER BY weight DESC, parent_id, child_id) = 1) """


def _clusters(g):
    n = F.expr("cast(substr(id, 2) AS INT)")
    return g.nodes.where(n % 10 < 3).select(F.concat(F.lit("c"), F.expr("cast(substr(id, 2) AS INT) DIV 10")).alias("cluster"), "id")


# Merges


@query(_KEEPERS + "SELECT id, keeper FROM k")
def cluster_keepers(g):
    return consolidate.keepers(g, _clusters(g))


@query(_KEEPERS + "SELECT id, CASE WHEN permanent = 0 AND id IN (SELECT id FROM k WHERE id <> keeper) THEN 1 ELSE coalesce(decayed, 0) END AS decayed FROM nodes")
def soft_merged_nodes(g):
    return consolidate.merged(g, consolidate.keepers(g, _clusters(g)))[0].nodes.select("id", F.coalesce("decayed", F.lit(0)).alias("decayed"))


@query(_KEEPERS + "SELECT * FROM" + _MERGED)
def soft_merged_edges(g):
    return consolidate.merged(g, consolidate.keepers(g, _clusters(g)))[0].edges.select("parent_id", "child_id", "weight")


_VALUES = _KEEPERS + """, kinds AS (SELECT cluster, node_type, count(*) AS n FROM c JOIN nodes USING (id) GROUP BY 1, 2),
 kind AS (SELECT cluster, CASE WHEN count(*) = 1 THEN min(node_type) ELSE 'derived' END AS node_type FROM kinds WHERE (cluster, n) IN (SELECT (cluster, max(n)) FROM kinds GROUP BY cluster) GROUP BY 1),
 tag AS (SELECT cluster, string_agg(t, ',' ORDER BY t) AS tags FROM (SELECT DISTINCT cluster, unnest(string_split(tags, ',')) AS t FROM c JOIN nodes USING (id)) GROUP BY 1),
 src AS (SELECT cluster, string_agg(t, ';' ORDER BY t) AS source_file FROM (SELECT DISTINCT cluster, unnest(string_split(source_file, ';')) AS t FROM c JOIN nodes USING (id)) GROUP BY 1),
 v AS (SELECT cluster, CAST(sum(access_count) AS BIGINT) AS access_count, min(ts) AS ts, max(permanent) AS permanent, max(last_accessed) AS last_accessed,
  arg_max(content, (length(content), id)) AS content, max(CASE WHEN id = keeper THEN domain END) AS domain FROM k JOIN nodes USING (id) GROUP BY 1) """


@query(_VALUES + "SELECT cluster, access_count, ts, permanent, last_accessed, source_file, coalesce(tags, '') AS tags, sha256(content) AS content, domain, node_type FROM v JOIN kind USING (cluster) JOIN src USING (cluster) LEFT JOIN tag USING (cluster)")
def cluster_values(g):
    return consolidate.cluster_properties(g, _clusters(g)).select("cluster", "access_count", "ts", "permanent", "last_accessed", "source_file", "tags", F.sha2("content", 256).alias("content"), "domain", "node_type")


@query(_KEEPERS + """SELECT cluster, '{"domain":"' || meta_domain || '"}' AS metadata FROM k JOIN nodes USING (id) WHERE id = keeper""")
def cluster_metadata(g):
    """Of the metadata's one key that all have, the keeper's value."""
    n = g.nodes.join(_clusters(g), "id").join(consolidate.keepers(g, _clusters(g)), "id").withColumn("metadata", F.to_json(F.struct(F.get_json_object("metadata", "$.domain").alias("domain"))))
    return consolidate.merged_metadata(n)


_HARD = _VALUES + ", h AS (SELECT cluster, substr(sha256('merged:' || content), 1, 12) AS keeper FROM v) "


@query(_HARD + "SELECT id, access_count FROM (SELECT id, CAST(access_count AS BIGINT) AS access_count FROM nodes WHERE id NOT IN (SELECT id FROM c)) UNION ALL SELECT h.keeper, access_count FROM v JOIN h USING (cluster)")
def hard_merged_nodes(g):
    return consolidate.hard_merged(g, _clusters(g), fx.as_of())[0].nodes.select("id", F.col("access_count").cast("long").alias("access_count"))


@query(_HARD.replace(", k AS (", ", k0 AS (").replace("FROM k JOIN", "FROM k0 JOIN") + ", k AS (SELECT id, keeper FROM c JOIN h USING (cluster)) SELECT * FROM" + _MERGED)
def hard_merged_edges(g):
    return consolidate.hard_merged(g, _clusters(g), fx.as_of())[0].edges.select("parent_id", "child_id", "weight")


@query("SELECT node_id FROM emb WHERE node_id NOT IN (SELECT id FROM nodes WHERE CAST(substr(id, 2) AS INT) % 10 < 3)")
def hard_merged_vectors(g):
    return consolidate.hard_merged(g, _clusters(g), fx.as_of())[0].emb.select("node_id")


# Links


_LINKS = _SIMS + ", l AS (SELECT a, b, sim FROM lsims WHERE sim >= 0.35 AND sim < 0.45 AND NOT EXISTS (SELECT 1 FROM sym WHERE sym.a = lsims.a AND sym.b = lsims.b)) "


@query(_LINKS + "SELECT a, b, round(sim, 6) AS sim FROM l JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b WHERE x.source_file <> y.source_file")
def cross_source_links(g):
    return consolidate.new_links(g, P, True).select("a", "b", F.round("sim", 6).alias("sim"))


@query(_LINKS + "SELECT a, b, round(sim, 6) AS sim FROM l ORDER BY a, b LIMIT 25")
def capped_links(g):
    return consolidate.new_links(g, P, most=25).select("a", "b", F.round("sim", 6).alias("sim"))


@query(_LINKS + "SELECT a, b, round(sim, 6) AS sim FROM l JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b WHERE x.source_file <> y.source_file ORDER BY l.sim DESC, a, b LIMIT 1")
def dream_pair(g):
    return consolidate.dream_link(g, P).select("a", "b", F.round("sim", 6).alias("sim"))


@query()
def lsh_pairs(g):
    """dedup_pairs by random hyperplanes; a test has its recall."""
    return lsh.lsh_pairs(similarity.live_vectors(g), P.dedup, dim=P.dim).select("a", "b", F.round("sim", 6).alias("sim"))


@query("SELECT id AS node_id FROM live JOIN emb ON node_id = id ORDER BY ts, id LIMIT 100")
def oldest_vectors(g):
    return consolidate.oldest_vectors(g, 100).select("node_id")


@query(_SIMS + """, l AS (SELECT a, b FROM lsims WHERE sim >= 0.35 UNION SELECT b, a FROM lsims WHERE sim >= 0.35), r AS (SELECT a AS id, a AS y FROM l UNION SELECT id, b FROM r JOIN l ON a = y)
 SELECT id, min(y) AS component FROM r GROUP BY 1""", recursive=True)
def link_components(g):
    return consolidate.linked_components(similarity.live_vectors(g), P.cross_link, P.dim)


# Decay


_DIRECT = f"SELECT id FROM live WHERE permanent = 0 AND access_count = 0 AND ts < {_AS} - to_days(14) AND id NOT IN (SELECT a FROM sym WHERE b IN (SELECT id FROM live))"
_DECAY = _cascade_sql(6).replace("OR domain = 'en')", f"OR id IN ({_DIRECT}))", 1)
_DECAY = _DECAY[: _DECAY.index("SELECT id, 1 AS round")]
_ALL = "SELECT id, 'direct' AS reason FROM (" + _DIRECT + ") UNION ALL " + " UNION ALL ".join(f"SELECT id, 'cascade' FROM r{n}" for n in range(1, 7))


@query(_DECAY + _ALL)
def auto_decay_log(g):
    return lifecycle.auto_decay(g, fx.as_of())[1]


@query(_DECAY + f", log AS ({_ALL}) SELECT id, CASE WHEN id IN (SELECT id FROM log) THEN 1 ELSE coalesce(decayed, 0) END AS decayed FROM nodes")
def auto_decayed(g):
    return lifecycle.auto_decay(g, fx.as_of())[0].nodes.select("id", F.coalesce("decayed", F.lit(0)).alias("decayed"))


@query(""", d AS (SELECT id, count(*) AS n FROM (SELECT parent_id AS id FROM edges UNION ALL SELECT child_id FROM edges WHERE child_id <> parent_id) GROUP BY 1)
 SELECT parent_id, child_id, n - 1 AS rest FROM edges JOIN d ON d.id = child_id""")
def degrees_without_edge(g):
    return stats.degrees_without(g.edges)


@query("SELECT decay_reason AS event, count(*) AS n FROM audit GROUP BY 1", raw=True)
def event_counts(spark, sf_dir):
    return sleep.event_counts(fx.audit(spark, sf_dir).select(F.col("decay_reason").alias("event")))


# The store, the index, the cache


def _stored(g):
    """The graph in a store of its own, after a commit that touches a domain's nodes and takes away its edges."""
    spark, folder = g.nodes.sparkSession, new_folder(g.nodes.sparkSession, "store")
    slim = g.with_(nodes=g.nodes.withColumn("content", F.lit(None).cast("string")), metrics=None)
    read = store.save(slim, folder)
    touched = slim.nodes.where("domain = 'de'")
    gone = g.edges.join(touched.select(F.col("id").alias("child_id")), "child_id", "left_semi")
    store.commit(spark, folder, read, {"nodes": touched.withColumn("access_count", F.col("access_count") + 1)}, {"edges": gone})
    return store.load(spark, folder)


@query("SELECT id, access_count + CASE WHEN domain = 'de' THEN 1 ELSE 0 END AS access_count FROM nodes")
def stored_nodes(g):
    """Merge-on-read after a commit of changed rows."""
    return _stored(g).nodes.select("id", "access_count")


@query("SELECT parent_id, child_id, weight FROM edges WHERE child_id NOT IN (SELECT id FROM nodes WHERE domain = 'de')")
def stored_edges(g):
    """Merge-on-read after a commit of tombstones."""
    return _stored(g).edges.select("parent_id", "child_id", "weight")


@query(""", found AS (SELECT a.node_id AS q, b.node_id AS node_id, list_cosine_similarity(a.vector, b.vector) AS sim FROM emb a JOIN emb b ON a.node_id <> b.node_id
 WHERE CAST(substr(a.node_id, 2) AS INT) % 20 = 0) SELECT q, node_id, round(sim, 6) AS sim FROM found QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, node_id) <= 10""")
def indexed_topk_backfilled(g):
    """The exact search of an index that was built from half of the vectors and got the rest later."""
    index = vector_index.build(g.emb.where("cast(substr(node_id, 2) AS INT) % 2 = 0"), new_folder(g.emb.sparkSession, "vector-index"), dim=P.dim)
    vector_index.backfill(index, g.emb)
    return vector_index.search(index, _queries(g), probes=0).withColumn("sim", F.round("sim", 6))


@query("SELECT 'test-64' AS model, CAST(len(vector) AS INT) AS dim, count(*) AS n FROM emb GROUP BY 1, 2")
def vector_dimensions(g):
    return store.dimensions(g)


@query("SELECT nodes, embedded, nodes - embedded AS missing, round(embedded * 100 / greatest(nodes, 1), 4) AS coverage_percent FROM (SELECT count(*) AS nodes, count(*) FILTER (WHERE id IN (SELECT node_id FROM emb)) AS embedded FROM live WHERE trim(content) <> '')")
def embedding_overview(g):
    return stats.embedding_overview(g).drop("last_updated")


# Walks


@query(""", w AS (SELECT 'd17' AS id, 0 AS d UNION SELECT b, d + 1 FROM w JOIN sym ON a = id WHERE d < 8), far AS (SELECT id, min(d) AS d FROM w GROUP BY 1),
 up AS (SELECT x.id AS id, min(y.id) AS parent FROM far x JOIN sym ON a = x.id JOIN far y ON y.id = b AND y.d = x.d - 1 GROUP BY 1),
 path AS (SELECT id, CAST(d AS INT) AS distance FROM far WHERE id = 'd40' UNION ALL SELECT parent, distance - 1 FROM path JOIN up USING (id))
 SELECT distance, id, node_type FROM path JOIN nodes USING (id)""", recursive=True)
def how_route(g):
    """A shortest path over all edges."""
    return walk.how(g, "d17", "d40", 8).select("distance", "id", "node_type")


# Sources and columns


_LATER = f", s AS (SELECT id, ts AS told FROM nodes WHERE {_N} % 3 = 0 UNION ALL SELECT id, ts - to_days(1) FROM nodes WHERE {_N} % 3 = 1) "


@query(_LATER + "SELECT n.id FROM nodes n LEFT JOIN s USING (id) WHERE told IS NULL OR ts > told")
def changed_rows(g):
    """Rows that a state does not have (ids 3k + 2) or has in an older version (3k + 1)."""
    n = F.expr("cast(substr(id, 2) AS INT)") % 3
    state = g.nodes.where(n < 2).select("id", F.when(n == 0, F.col("ts")).otherwise(F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("ts"))
    return ingest.changed_since(g.nodes, state, "id", "ts").select("id")


@query(f""", f AS (SELECT 'extractor:n' || {_N} || '.md' AS source_file, id, {_N} AS n FROM nodes), l AS (SELECT x.id AS p, y.id AS c FROM f x JOIN f y ON y.n = x.n // 2 WHERE x.id <> y.id)
 SELECT p AS parent_id, c AS child_id, 'Wikilink' AS reasoning FROM l UNION SELECT c, p, 'Wikilink' FROM l""")
def vault_edges(g):
    """Notes n<k>.md that link to [[n<k div 2>]]."""
    name = F.concat(F.lit("n"), F.expr("cast(substr(id, 2) AS INT)"))
    found = g.nodes.select(F.concat(name, F.lit(".md")).alias("path"), F.concat(F.lit("see [["), F.lit("n"), F.expr("cast(substr(id, 2) AS INT) DIV 2"), F.lit("|so]] there")).alias("text"))
    nodes = g.nodes.select("id", F.concat(F.lit("extractor:"), name, F.lit(".md")).alias("source_file"))
    return files.wikilink_edges(found, nodes).select("parent_id", "child_id", "reasoning")


_PATH = "regexp_replace(url, '^[a-z]+://[^/]*/?', '')"


@query(f"SELECT page_id FROM (SELECT page_id, {_PATH} AS p FROM pages) WHERE regexp_matches(p, '(^|/)[^/]*7$') OR starts_with(p, 'doc/')", raw=True)
def ignored_paths(spark, sf_dir):
    """Pages whose path an ignore list would leave out."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*/?", "").alias("p"))
    return p.where(files.ignored(F.col("p"), ["*7", "# a comment", "doc/"])).select("page_id")


@query("SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INT) AS place, x AS line FROM (SELECT id, generate_subscripts(m, 1) AS i, trim(unnest(m), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM (SELECT id, string_split(content, chr(10)) AS m FROM nodes)) WHERE x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '---')")
def statement_lines(g):
    return g.nodes.select("id", F.posexplode(tx.statement_lines(F.col("content"))).alias("place", "line"))


@query(f"SELECT id, CASE WHEN {_N} % 4 = 0 THEN CAST('2024-02-0' || ({_N} % 9 + 1) || ' 10:00:00' AS TIMESTAMP) WHEN {_N} % 4 = 1 THEN TIMESTAMP '2024-02-01 08:00:00' END AS time FROM nodes")
def event_times(g):
    """Times with an offset are read, others are refused."""
    n = F.expr("cast(substr(id, 2) AS INT)")
    good = F.concat(F.lit("2024-02-0"), n % 9 + 1, F.lit("T10:00:00Z"))
    told = F.when(n % 4 == 0, good).when(n % 4 == 1, " 2024-02-01T10:00:00+02:00 ").when(n % 4 == 2, "2024-02-01T10:00:00").otherwise("yesterday")
    return g.nodes.select("id", clock.event_time(told).alias("time"))


@query("SELECT id, CASE WHEN node_type IN ('seed', 'core_memory') THEN 1 END AS permanent FROM nodes")
def migrated_schema(g):
    """Nodes of an older schema in the present one."""
    return normalize_nodes(g.nodes.drop("permanent", "metadata", "last_accessed")).select("id", "permanent")


@query("SELECT origin, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(file, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'source_file_date' ELSE 'none' END AS origin FROM " + f"(SELECT CASE WHEN {_N} % 3 = 0 THEN 'a/2023-05-0' || ({_N} % 9 + 1) || '.md' ELSE 'x.md' END AS file FROM nodes WHERE referent_ts IS NULL OR {_N} % 6 = 0)) GROUP BY 1")
def recoverability(g):
    return recover.recoverability(_dated(g))


@query(f"SELECT id, coalesce(CASE WHEN {_N} % 6 <> 0 THEN referent_ts END, CASE WHEN {_N} % 3 = 0 THEN CAST('2023-05-0' || ({_N} % 9 + 1) AS TIMESTAMP) END) AS referent_ts FROM nodes")
def backfilled_times(g):
    return recover.backfilled(_dated(g)).select("id", "referent_ts")


def _dated(g):
    n = F.expr("cast(substr(id, 2) AS INT)")
    return g.nodes.withColumns({"referent_ts": F.when(n % 6 != 0, F.col("referent_ts")), "source_file": F.when(n % 3 == 0, F.concat(F.lit("a/2023-05-0"), n % 9 + 1, F.lit(".md"))).otherwise("x.md"), "metadata": F.lit("{}")})
